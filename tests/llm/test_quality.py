"""Operator 9 against plain Python counts, multinomials and threshold."""

import math
import re
import struct
from collections import Counter

import xxhash

from tallygrove.llm import quality, registry


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    three = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    often = Counter(three)
    covered = {j for k, x in enumerate(three) if often[x] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def grams(text):
    one = [xxhash.xxh64_intdigest(x.encode(), 42) for x in re.findall(r"[^\x20\x09-\x0D]+", text)]
    chain = lambda h, x: xxhash.xxh64_intdigest(struct.pack("<Q", x), h)
    two = [chain(chain(42, a), b) for a, b in zip(one, one[1:])]  # noqa: B905
    return [signed(h) % quality.BUCKETS for h in one + two]


def test_whole_table(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality == 1}
    found = {k: grams(t) for k, t in texts.items()}
    raw, target = Counter(), Counter()
    for k, g in found.items():
        raw.update(g)
        target.update(g if k in good else ())
    n, m = sum(raw.values()), sum(target.values())
    weight = lambda b: round(1e6 * (math.log((target[b] + 1) / (m + quality.BUCKETS)) - math.log((raw[b] + 1) / (n + quality.BUCKETS))))
    score = {k: math.floor(sum(map(weight, g)) * quality.STEPS / (max(1, len(g)) * 1e6)) for k, g in found.items()}
    failed = {k: (c := counts(t))[0] < 50 or 100 * c[4] > 50 * c[0] for k, t in texts.items()}
    ordered = sorted(score[k] for k in good if k in texts and not failed[k])
    least = ordered[math.floor(quality.SHARE * len(ordered))] - round(quality.MARGIN * quality.STEPS)
    got = {r.doc_id: r for r in registry.op9_quality(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for k, r in got.items():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(texts[k])
        assert r.base_failed == failed[k] and r.llr == score[k] / quality.STEPS
        assert r.kept == (not failed[k] and score[k] >= least)
    assert 0 < sum(r.kept for r in got.values()) < len(got)


def test_odd_rows(spark):
    long = "many words in a very long text " * 30000
    rows = [(1, None, 0), (2, "", 0), (3, "a b c a b c", 0), (3, "a b c a b c", 0), (None, "x\n\nx\n \n", 0), (4, long, 0), (5, "<b>|é 日本\x0b*", 0), (6, " ".join(f"w{k}" for k in range(60)), 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    labels = spark.createDataFrame([(6, 1, 0), (6, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.scored(df, labels).collect()
    assert len(got) == len(rows)
    want = sorted((r[0] or 0, *counts(r[1] or "")) for r in rows)
    assert sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert [r.doc_id for r in got if r.kept] == [6]
    assert sorted(r.doc_id or 0 for r in quality.keep(df, labels).collect()) == [0, 6]
    assert [r.doc_id for r in quality.scored(df, labels.limit(0)).collect() if r.kept] == [6]
    assert quality.scored(df.limit(0), labels).count() == 0


def test_a_trusted_id_with_another_text_isnt_trusted(spark):
    """The labels name rows of a table: a row that shares such a row's id and not its text tells nothing of what is good."""
    good, other = (" ".join(f"{a}{k}" for k in range(60)) for a in ("word", "term"))
    docs = spark.createDataFrame([(1, good), (2, other)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    named = spark.createDataFrame([(1, "the text that was labelled")], "doc_id long, text string")
    assert [r.doc_id for r in quality.keep(docs, labels).collect()] == [1]
    assert sorted(r.doc_id for r in quality.keep(docs, labels, labelled=named).collect()) == [1, 2]
    assert [r.doc_id for r in quality.keep(docs, labels, labelled=docs).collect()] == [1]
