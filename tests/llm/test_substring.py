"""Operator 13 against every window of every text."""

import hashlib
import random
from collections import Counter

from tallygrove.llm import registry, substring


def plain(texts, length=35):
    """(n_words, n_removed, kept_sha256, kept) of each text."""
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[k : k + length]) for w in words for k in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                gone[k : k + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = dict(zip([r.doc_id for r in rows], [x[:3] for x in plain([r.text for r in rows])], strict=True))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in registry.op13_substring(spark, sf).collect()}
    assert got == want and sum(v[1] for v in got.values()) > 0


def odd_texts():
    rnd = random.Random(9)
    some = lambda n, of=900: " ".join(f"w{rnd.randrange(of)}" for _ in range(n))
    a, b, c, d = some(34), some(35), some(36), some(300)
    words = d.split()
    texts = [None, "", " \t\n", "one", a, a, b, b + " x", "y " + c + " z", "q  \n" + c.replace(" ", "\t"), "same " * 500, "same " * 34, "ab cd " * 40]
    texts += [some(k) + " " + " ".join(words[k : k + 50 + 3 * k]) + " " + some(k % 7) for k in range(0, 60, 5)]
    texts += [some(200, 2) for _ in range(5)] + [d] * 9 + ["wörter mit anderen " * 30, "wörter mit anderen " * 40]
    return texts + [some(5000) + " " + d + " " + some(3000)]


def test_odd_rows(spark):
    texts = odd_texts()
    rows = [(k if k % 7 else None, x, f"d{k}", "t") for k, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _doc string, batch string").repartition(5)
    want = plain(texts)
    told = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.counts(df).collect())
    assert told == sorted((-1 if not k % 7 else k, *w[:3]) for k, w in enumerate(want))
    left = {r._doc: r.text for r in substring.remove_repeats(df).collect()}
    assert left == {f"d{k}": w[3] if w[1] else x for k, (x, w) in enumerate(zip(texts, want, strict=True))}
    assert substring.remove_repeats(df).schema == df.schema
    assert substring.counts(df.limit(0)).count() == 0


def test_other_lengths_and_runs(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("abc") for _ in range(rnd.randrange(40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, said string")
    for length in (1, 2, 5, 8):
        want = plain(texts, length)
        got = {r.doc_id: r[1:] for r in substring.counts(df, "id", "said", length).collect()}
        assert got == {k: w[:3] for k, w in enumerate(want)}
    runs = substring.repeats(df, "id", "said", 8).collect()
    by = Counter()
    for r in runs:
        assert texts[r.doc_id].split()[r.begin : r.end] == r.words.split()
        by[r.doc_id] += r.end - r.begin
    assert by == {k: w[1] for k, w in enumerate(want) if w[1]}
    around = {(r.doc_id, r.begin - 1) for r in runs} | {(r.doc_id, r.end) for r in runs}
    assert not around & {(r.doc_id, k) for r in runs for k in range(r.begin, r.end)}
