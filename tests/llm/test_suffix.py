"""Operator 7 against every window of every text."""

import hashlib
import random
from collections import Counter

import numpy as np

from tallygrove.llm import registry, suffix


def plain(texts, length=200):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[k : k + length] for r in raws for k in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = dict(zip([r.doc_id for r in rows], plain([r.text for r in rows]), strict=True))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in registry.op7_suffix(spark, sf).collect()}
    assert got == want and sum(v[1] for v in got.values()) > 0


def test_suffix_order():
    rnd = random.Random(7)
    for n, letters in ((1, "a"), (50, "ab"), (300, "abc"), (400, "a"), (500, "abcdefgh"), (300, "aab")):
        s = np.array([ord(rnd.choice(letters)) for _ in range(n)] + [0], dtype=np.uint8)
        raw = s.tobytes()
        assert suffix.suffix_order(s, 600).tolist() == sorted(range(n + 1), key=lambda k: raw[k:])


def odd_texts():
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    common, other = word(230), word(400)
    texts = [None, "", "short", "a" * 1500, "ab" * 500, common, common, "x" * 199, "y" * 201, word(60) * 8]
    texts += [word(rnd.randrange(60)) + common + word(rnd.randrange(60)) for _ in range(12)]
    texts += [word(50) + other[k : k + 300] + word(50) for k in range(0, 100, 9)]
    texts += ["日本語" * 100, "z" + "日本語" * 100]
    return texts


def test_odd_rows(spark, monkeypatch):
    texts = odd_texts()
    rows = [(k if k % 7 else None, x, "c") for k, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    want = sorted(zip([r[0] or -1 for r in rows], plain(texts), strict=True))
    told = lambda d: sorted((-1 if r.doc_id is None else r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in d.collect())
    assert told(suffix.counts(df)) == want
    monkeypatch.setattr(suffix, "MANY", 3)
    monkeypatch.setattr(suffix, "SHARD_BYTES", 1000)
    assert told(suffix.counts(df)) == want
    assert suffix.counts(df.limit(0)).count() == 0
    left = suffix.remove_repeats(df)
    assert left.columns == df.columns and left.count() == len(rows)
    assert {r.text for r in left.where("doc_id in (5, 6)").collect()} == {""}


def test_clashing_columns_and_broken_characters(spark):
    common = "repeated words " * 20
    texts = ["é�" + common + "�é" + "x" * 30, "other é" + common, "no cut �", "日" + "本語" * 150, "月" + "本語" * 150]
    names = ["_raw", "_k1", "_k2", "_kept", "_row", "_text", "n_removed", "kept", "a.b"]
    df = spark.createDataFrame([(k, x, *[f"{k}{n}" for n in names]) for k, x in enumerate(texts)], ["doc_id", "text", *names])
    left = {r.doc_id: r for r in suffix.remove_repeats(df).collect()}
    assert all(r.asDict()[n] == f"{k}{n}" for k, r in left.items() for n in names)
    whole = plain(texts)
    assert left[0].text.startswith("é�") and left[0].text.endswith("�é" + "x" * 30) and left[2].text == texts[2]
    assert len(left[0].text.encode()) == whole[0][0] - whole[0][1]
    assert all(len(left[k].text.encode()) <= whole[k][0] - whole[k][1] for k in left) and left[3].text[:1] == "日"
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("texts_")]
