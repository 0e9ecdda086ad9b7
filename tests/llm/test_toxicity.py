"""Operator 5: its kernel against a plain sum, and its accuracy on labels that it has not seen."""

import re
import zlib
from itertools import combinations

import numpy as np

from tallygrove.llm import registry, toxicity


def plain(a, b):
    def table(w):
        out = {}
        s = toxicity.symbols([w])[0]
        for i, j, k in combinations(range(int((s > 0).sum())), 3):
            if k - i < toxicity.SPAN:
                key = (s[i], s[j], s[k])
                out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        return out, sum(v * v for v in out.values()) ** 0.5 or 1.0

    (x, m), (y, n) = table(a), table(b)
    return sum(v * y.get(k, 0) for k, v in x.items()) / (m * n)


def test_kernel_equals_the_plain_sum():
    marks, words = ["idiot", "worthless", "réeux"], ["idiot", "i*d*i*o*t", "idxiot", "worthles", "th", "", "réeuxpa", "a" * 32, "idididid", "worthworthworth"]
    got = toxicity.Kernel(marks)(words)
    want = np.array([[plain(w, m) for m in marks] for w in words])
    near = want.max(axis=1, keepdims=True) >= toxicity.FAINT  # a word near a landmark keeps all its similarities, small ones too
    assert np.allclose(got, np.where(near, want, 0) ** toxicity.POWER, atol=1e-5)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r for r in registry.op5_toxicity(spark, sf).collect()}
    assert len(got) == 10000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    held = [(got[k].score, t) for k, t in labels.items() if got[k].held_out]
    bad, good = [s for s, t in held if t], [s for s, t in held if not t]
    wins = sum((b > g) + (b == g) / 2 for b in bad for g in good) / len(bad) / len(good)
    assert wins > 0.9
    assert sum(s >= 0.5 for s in good) < 0.05 * len(good) and sum(s >= 0.5 for s in bad) > 0.6 * len(bad)


def test_gapped_insults_and_odd_rows(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    machine = toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "true")
    said = ["you idiot", "an i d i o t here", "t.r.a.s.h", "idiiot", "w-o-r-t-h-l-e-s-s", "the and of tion", "", None, "the and " * 60000, "such a m0ron!", "tr@$h", "2024 10 07"]
    rows = [(k, x, 0.5) for k, x in enumerate(said)] + [(None, "you idiot", 0.0), (0, "you idiot", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.score >= 0.5) for r in toxicity.score(df, machine).collect())
    assert got == [(-1, True), (0, True), (0, True), (1, True), (2, True), (3, True), (4, True), (5, False), (6, False), (7, False), (8, False), (9, True), (10, True), (11, False)]
    assert toxicity.score(df.limit(0), machine).count() == 0
    none = spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(df, none, "true") is None and {r.score for r in toxicity.score(df, None).collect()} == {0.0}
    assert toxicity.keep(df, none).count() == len(rows)
    odd = spark.createDataFrame([(k, t) for k, t in enumerate((0, 2, 1, None, 0, -1))] + [(None, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(df, toxicity.fit(df, odd, "true")).collect()} == {0.0}


INSULTS = ("trash", "pathetic", "worthless", "idiot", "disgusting", "scum", "clown", "moron", "stupid", "loser")


def test_inserted_dropped_and_doubled_letters(spark):
    """Machine fitted without the rows held out: of ten insults with one letter more, less or twice, at least eight are found, in a sentence."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    machine = toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "crc32(cast(_id as string)) % 5 <> 0")
    for change in (lambda w, k: w[:k] + "b" + w[k:], lambda w, k: w[:k] + "q" + w[k:], lambda w, k: w[:k] + w[k + 1 :], lambda w, k: w[:k] + w[k - 1] + w[k:]):
        said = [f"the town and then you {change(w, len(w) // 2)} went home. and more" for w in INSULTS]
        assert sum(p >= 0.5 for p in toxicity.chances(machine, said)) >= 8
    assert all(p < 0.5 for p in toxicity.chances(machine, ["the town went home", "", None, "they stand and the ones of it", "2024 10 07"]))


def test_scores_by_the_plain_kernel(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    machine = toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "true")
    marks = machine.landmarks

    def row(word):
        found = [np.array([plain(f, m) for m in marks]) for f in toxicity.forms(word)]
        near = [v**toxicity.POWER for v in found if v.max() >= toxicity.FAINT]
        return np.max(near, axis=0) if near else None

    texts = ["you idiot and trash. the end", "tr@$h town!", "the and of", "worxthless\nmoron stupid", "", "one idi-ot? two"]
    want = []
    for t in texts:
        rows = [np.zeros(len(marks))]
        for sentence in re.split(r"(?<=[.!?])\s+|\n+", t):
            hot = [v for w in sentence.split() if (v := row(w)) is not None]
            rows += [np.max(hot, axis=0)] if hot else []
        z = max(float(r @ machine.whiten @ machine.weight) + machine.bias for r in rows)
        want.append(float(np.interp(z, machine.decision, machine.chance)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.score for r in sorted(toxicity.score(df, machine).collect())]
    assert np.allclose(got, want, atol=1e-3) and max(got) > 0.5 > min(got)


def test_calibration_pools_what_does_not_rise():
    z, p = toxicity.calibrated(np.array([3.0, 1, 2, 2, 4, 0]), np.array([1.0, 1, 0, 0, 1, 0]))
    assert z.tolist() == [0.0, 5 / 3, 3.5] and np.allclose(p, [0.25, 0.375, 2.5 / 3])
