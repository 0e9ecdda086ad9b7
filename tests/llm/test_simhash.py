"""Operator 3 against comparing every pair."""

import numpy as np
import xxhash

from tallygrove.llm import registry, simhash


def plain_print(text, width=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, threshold=4):
    left, out = dict(prints), {}
    for k in sorted(prints):
        if k in left:
            todo = [(k, left.pop(k))]
            while todo:
                j, p = todo.pop()
                out[j] = k
                for x in [x for x, q in left.items() if (p ^ q).bit_count() <= threshold]:
                    todo.append((x, left.pop(x)))
    return out


def test_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {k: plain_print(t) for k, t in texts.items()}
    want = plain_components(prints)
    got = {r.doc_id: r for r in registry.op3_simhash(spark, sf).collect()}
    assert {k: r.fingerprint for k, r in got.items()} == {k: f"{p:016x}" for k, p in prints.items()}
    assert {k: r.component_id for k, r in got.items()} == want and len(set(want.values())) < len(want)


def test_every_link_within_four_bits_shares_an_anchor():
    rnd = np.random.default_rng(5)
    x = rnd.integers(0, 2**64, 3000, dtype=np.uint64)
    y = x.copy()
    for k in range(len(y)):
        for bit in rnd.choice(64, k % 5, replace=False):
            y[k] ^= np.uint64(1) << np.uint64(bit)
    near = lambda p: set(simhash.anchors(np.array([p], dtype=np.uint64))[0].tolist())
    assert all(near(a) & near(b) for a, b in zip(x, y, strict=True))


def test_forest_connects_a_large_group():
    rnd = np.random.default_rng(6)
    p = np.zeros(700, dtype=np.uint64)
    for k in range(700):
        p[k] = sum(1 << int(b) for b in rnd.choice(64, 3, replace=False))
    p = np.unique(p)
    src, dst = simhash.forest(np.zeros(len(p), np.int64), p, 4)
    want = plain_components({int(x): int(x) for x in p})
    assert len(src) == len(p) - len(set(want.values()))


def test_odd_rows(spark):
    rows = [(1, "a b c d e f", 0), (2, "A  b\nc d e f", 0), (3, None, 0), (4, "", 0), (5, "x", 0), (5, "x", 0), (None, "x", 0), (7, "long " * 70000, 0), (8, "other words here that differ", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, print int")
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.components(df).collect())
    assert got == [(0, 5), (1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (5, 5), (7, 7), (8, 8)]
    assert sorted(r.doc_id or 0 for r in simhash.one_of_each(df).collect()) == [0, 1, 3, 5, 5, 7, 8]
    assert simhash.components(df.limit(0)).count() == 0


def test_stage_finds_all_similar_texts(spark, monkeypatch):
    import random

    import corpus_pipeline

    rnd = random.Random(9)
    word = lambda: rnd.choice("abcdefghijklmnop") + rnd.choice("qrstuvwxyz") + str(rnd.randrange(40))
    texts, boiler = [], [word() for _ in range(60)]
    for k in range(60):
        base = [word() for _ in range(rnd.randrange(6, 200))] + boiler * (k % 2)
        texts.append(base)
        for _ in range(3):
            near = list(base)
            for _ in range(rnd.randrange(1, 6)):
                near[rnd.randrange(len(near))] = word()
            texts.append(near)
    texts = [" ".join(x) for x in texts] + [None, "", "A b", "a  B", "a b c"]
    found = {k: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for k, x in enumerate(texts) if (w := (x or "").lower().split())}
    prints = {k: plain_print(x, 5) for k, x in enumerate(texts)}
    alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    near = lambda j, k: (prints[j] ^ prints[k]).bit_count() <= 4 or (j in found and k in found and alike(found[j], found[k]))
    left, kept, far = set(prints), set(), 0
    for k in sorted(prints):
        if k in left:
            kept.add(k)
            todo = [k]
            left.remove(k)
            while todo:
                j = todo.pop()
                more = {x for x in left if near(j, x)}
                far += sum((prints[j] ^ prints[x]).bit_count() > 4 for x in more)
                left -= more
                todo += more
    assert far > 20
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()} == kept
    monkeypatch.setattr(simhash, "SAMPLED", 1)
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()} == kept


def test_sketches_never_tell_too_few():
    rnd = np.random.default_rng(7)
    for n, m, both in ((1, 1, 1), (5, 3, 2), (100, 90, 80), (700, 1500, 600), (40, 40, 0), (3000, 2500, 2400)):
        x = rnd.integers(0, 2**64, n + m - both, dtype=np.uint64)
        a, b = x[:n], x[n - both :]
        told = simhash.may_share(simhash.sketch(a), n, simhash.sketch(b), m)
        assert told == simhash.may_share(simhash.sketch(b), m, simhash.sketch(a), n)
        assert both <= told <= both + 0.35 * max(n, m) + 2


def test_changed_copies_meet_the_one_least_changed(spark):
    """Of a group's first fifths, with shingles of their own before those of the text they are copies of, the unchanged text leads, whatever its id."""
    own = iter(range(10**6, 10**7))
    copies = [(k, [next(own) for _ in range(1 + k % 7)] + list(range(20))) for k in range(200)]
    sets = spark.createDataFrame([*copies, (999, list(range(20)))], "id long, first array<long>")
    found = simhash.leads(sets).collect()
    assert {r.lead for r in found} == {999} and len(found) == 20 * 201
    assert sorted((r.shingle, r.at) for r in found if r.id == 8) == [(k, k + 2) for k in range(20)]
