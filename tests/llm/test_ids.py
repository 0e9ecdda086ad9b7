"""Operators 4, 6 and 10 against the tokenizers library itself."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallygrove.llm import bpe, grammar, packing, registry
from tallygrove.llm.tokens import default_path, library_encoder, tokenizer

ODD = ["", " ", "  a", "a  b", "a \n b", "<|endoftext|>", "a<|endoftext|> b", "a <|endoftext|>b c", "\x1c a", "it's  I'm", "日本 語", " a ", "aa" * 700, "x  y", "same", "same"]
SCHEMA = "doc_id long, text string, ids string, part int"


def library(text, end=()):
    return [*tokenizer(default_path()).encode(text or "", add_special_tokens=False).ids, *end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, x, "clash", 1) for k, x in enumerate(ODD)] + [(100, None, None, None), (None, "no id", "x", 0), (3, "again an id", "x", 0)]
    return spark.createDataFrame(rows, SCHEMA)


def texts(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def test_piecewise_ids_equal_the_library():
    rnd = random.Random(3)
    found = ODD + ["".join(rnd.choice("aeinrst hTd \n0'é日<|>") for _ in range(rnd.randrange(40))) for _ in range(500)]
    got = library_encoder(default_path()).encode(found)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library(x) for x in found]


def test_backtracking_equals_the_library():
    rnd = random.Random(4)
    found = ODD + ["".join(rnd.choice("aeinrsthd") for _ in range(rnd.randrange(60))) for _ in range(500)]
    got = bpe.codec(default_path()).encode(found)
    assert [np.frombuffer(b"".join(y[0] for y in x), "<u4").tolist() for x in got] == [library(x) for x in found]


def test_bpe_round_trip(spark, sf, docs):
    r = {x.doc_id: x for x in registry.op10_bpe(spark, sf).collect()}
    for k, text in texts(spark, sf):
        ids = library(text)
        assert r[k].n_tokens == len(ids)
        assert r[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r[k].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, out="ids"), out="decoded")
    assert all(x.decoded == (x.text or "") for x in back.collect()) and back.count() == docs.count()
    assert bpe.encode(docs.limit(0)).count() == 0


def test_repair_files(spark, sf, docs, tmp_path):
    got = {x.doc_id: x for x in registry.op4_repair_ids(spark, sf).collect()}
    start = 0
    for k, text in sorted(texts(spark, sf)):
        ids = library(text, [2])
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    grammar.write(docs, str(tmp_path / "a"), parts=3)
    rows = grammar.read(spark, str(tmp_path / "a")).orderBy("start").collect()
    want = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    assert [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows] == [(k, library(t, [2])) for k, t in want]
    for k in (3, 8, 100):
        one = grammar.read_document(spark, str(tmp_path / "a"), k).collect()
        assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in one) == sorted(library(t, [2]) for d, t in want if d == k)
    assert grammar.read_document(spark, str(tmp_path / "a"), 55).count() == 0
    grammar.write(docs.limit(0), str(tmp_path / "b"))
    assert grammar.read(spark, str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("top", [300, 70000])
def test_repair_compresses_and_decodes_one_document(top):
    rnd = np.random.default_rng(1)
    words = [rnd.integers(0, top, 6) for _ in range(40)]
    docs = [np.concatenate([words[k] for k in rnd.integers(0, 40, n)]) for n in rnd.integers(1, 60, 200)] + [np.full(999, 7)]
    lengths = np.array([len(x) for x in docs])
    seq, at, rules, base = grammar.compress(np.concatenate(docs).astype(np.uint32), np.cumsum(lengths) - lengths)
    row = {"base": base, "width": seq.itemsize, "symbols": seq.tobytes(), "rules": rules.tobytes(), "lengths": grammar.expansions(rules, base).astype(np.uint32).tobytes()}
    row |= {"doc_ids": np.arange(len(docs)).tobytes(), "doc_null": bytes(len(docs)), "doc_symbols": at.tobytes(), "doc_lengths": lengths.tobytes()}
    shard = grammar.Shard(row)
    assert len(seq) < lengths.sum() / 2
    borders = set(at.tolist())
    left = Counter((a, b) for k, (a, b) in enumerate(zip(seq.tolist(), seq[1:].tolist())) if k + 1 not in borders)  # noqa: B905 - neighbours
    assert max(left.values()) < grammar.LEAST_COUNT
    for k in (0, 1, 77, 200):
        assert shard.document(k).tolist() == docs[k].tolist()


def check_packing(rows, texts, size=1024):
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    padding = 0
    for x in sequences.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at and length > 0
            at += length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    for k, text in texts:
        ids, at = library(text, [0]), 0
        for r in sorted(pieces[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    return padding / sum(r.length for r in rows)


def test_packing(spark, sf):
    assert check_packing(registry.op6_packing(spark, sf).collect(), texts(spark, sf)) < 0.02


def test_packing_of_odd_rows(spark, docs):
    from pyspark.sql import functions as F

    good = docs.where("doc_id is not null and text <> 'again an id' or text is null and doc_id is not null")
    rows = packing.pack(good, size=16, windows=2).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in good.collect()], 16)
    assert packing.pack(docs).groupBy().sum("length").first()[0] == sum(len(library(r.text, [0])) for r in docs.collect())
    assert packing.pack(docs.limit(0)).count() == 0
