"""Operator 8 against every pair."""

import numpy as np

from tallygrove.llm import registry, vectors


def plain(ids, v, threshold=0.9):
    u = np.array(v, dtype=np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = (u @ u.T >= threshold) & ~np.eye(len(u), dtype=bool)
    root = {}
    for k in np.argsort(ids):
        if k not in root:
            todo = [k]
            root[k] = ids[k]
            while todo:
                for x in np.flatnonzero(link[todo.pop()]):
                    if x not in root:
                        root[x] = ids[k]
                        todo.append(x)
    return {ids[k]: (int(link[k].sum()), root[k]) for k in range(len(ids))}


def test_recall_on_whole_table_and_noisy_copies(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    want = plain([r.vec_id for r in rows], [r.embedding for r in rows])
    got = {r.vec_id: r for r in registry.op8_vectors(spark, sf).collect()}
    assert {k: (r.n_links, r.component_id) for k, r in got.items()} == want
    rnd = np.random.default_rng(3)
    v = np.array([r.embedding for r in rows], dtype=np.float32)
    v = np.vstack([v, v[::4] + rnd.normal(size=v[::4].shape).astype(np.float32) * rnd.uniform(0.01, 0.06, (len(v[::4]), 1)).astype(np.float32)])
    want = plain(list(range(len(v))), v)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    links = sum(n for n, _ in want.values())
    assert links > 500 and all(got[k].n_links <= want[k][0] for k in want)
    assert sum(r.n_links for r in got.values()) >= 0.98 * links
    assert sum(got[k].component_id == want[k][1] for k in want) >= 0.98 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_blocks_copies_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 8)
    rnd = np.random.default_rng(2)
    v = rnd.normal(size=(60, 8))
    v = np.vstack([v, v[:20] + rnd.normal(size=(20, 8)) * 0.05, v[:5], np.tile(v[7], (30, 1))]).astype(np.float32)
    rows = [(k, x.tolist(), 0) for k, x in enumerate(v)]
    odd = [(900, None, 0), (901, [0.0] * 8, 0), (902, [float("nan")] + [1.0] * 7, 0), (903, [None] + [1.0] * 7, 0), (904, [1.0], 0), (None, v[0].tolist(), 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n int")
    got = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    want = plain(list(range(len(v))), v)
    assert {k: (got[k].n_links, got[k].component_id) for k in want} == want
    assert all((got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True) for k in (900, 901, 902, 903, 904))
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_traversal_is_in_order():
    a, b = np.array([3.0, 1.0, 2.0]), np.array([0.5, 0.1])
    order = vectors.traverse(a, b, 6)
    assert order == sorted(order, key=lambda c: a[c[0]] + b[c[1]]) and len(set(order)) == 6
