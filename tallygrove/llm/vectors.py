"""Near-duplicate vectors by an inverted multi-index.

The halves of the unit vectors have a codebook each; pairs of centroids form a grid of cells, and each vector lies in
the cell of its nearest centroids. A query visits cells in the order of its distances to both centroids together (the
multi-sequence traversal) up to a number that is measured: so many cells that a sample of queries, compared with all
rows, would meet TARGET of its links. The vectors in the cells it visits are verified in double precision.

Codebooks are fitted on a bounded sample (SAMPLE vectors, by hash) and grow with the root of the rows up to MOST_CENTRES
each; every vector is indexed and is a query. A cell of many vectors is cut into blocks of bounded size. Equal vectors are one with a weight. Vectors that are null, zero,
of another length than most or with null or non-finite components link with nothing. Rows that repeat an id give a row
each; different vectors of one id count as one. Null ids have neither links nor a component and are not kept. Other
columns are not carried. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import written
from .simhash import merge

#: Vectors the codebooks are fitted on; queries the traversal is measured with; the share of their links it must meet.
SAMPLE, PROBES, TARGET = 20_000, 400, 0.998
#: Links below which more are made for the measurement; centroids of a codebook, at most (a grid of 16 million cells).
FEW, MOST_CENTRES = 100, 4096
#: Vectors of a block, queries compared at once, and cells visited at least.
BLOCK, TOGETHER, LEAST_CELLS = 4096, 512, 8


def unit(raws: list[bytes], kind: str) -> np.ndarray:
    v = np.frombuffer(b"".join(raws), dtype=kind).reshape(len(raws), -1).astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def k_means(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    centre = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ centre.T - (centre**2).sum(axis=1) / 2, axis=1)
        count = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre[count > 0] = total[count > 0] / count[count > 0, None]
    return centre


def distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] - 2 * x @ centre.T + (centre**2).sum(axis=1)


def traverse(a: np.ndarray, b: np.ndarray, cells: int) -> list[tuple[int, int]]:
    """The `cells` nearest cells of the grid, by the sum of a query's distances to both of their centroids."""
    i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, seen, out = [(a[i[0]] + b[j[0]], 0, 0)], {(0, 0)}, []
    while heap and len(out) < cells:
        _, x, y = heapq.heappop(heap)
        out.append((int(i[x]), int(j[y])))
        for p, q in ((x + 1, y), (x, y + 1)):
            if p < len(i) and q < len(j) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (a[i[p]] + b[j[q]], p, q))
    return out


def prepared(rows: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, str]:
    """(vec_id, raw) of all rows, raw null where the vector can't be linked, and the numbers' kind."""
    kind = "<f8" if "double" in dict(rows.dtypes)[embedding] else "<f4"
    size = rows.select(F.size(embedding).alias("n")).where("n > 0").groupBy("n").count().orderBy(F.desc("count"), "n").limit(1).collect()
    size = size[0].n if size else 0

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = []
            for key, x in zip(b["vec_id"].to_pylist(), b["v"].to_pylist(), strict=True):
                v = np.array(x, dtype=kind) if key is not None and x is not None and len(x) == size and None not in x else None
                good = v is not None and np.isfinite(v).all() and v.any()
                raws.append((v + 0).tobytes() if good else None)  # + 0: one zero
            yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(raws, pa.binary())], names=["vec_id", "raw"])

    chosen = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"))
    return chosen.mapInArrow(each, "vec_id long, raw binary"), kind


def ranks_of(near: list[np.ndarray], x: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
    """How many cells a query x (a row of both distances) visits before the cell (c1, c2)."""
    return np.array([int((near[0][q][:, None] + near[1][q][None, :] < near[0][q, i] + near[1][q, j]).sum()) for q, i, j in zip(x, c1, c2, strict=True)], dtype=np.int64)


def probe(distinct: DataFrame, kind: str, books: list[np.ndarray], threshold: float) -> tuple[int, float]:
    """How many cells a traversal must visit to meet TARGET of the links, and the share that it meets then.

    The links are those of PROBES queries with every vector. Where they have fewer than FEW, as many are made: the
    query turned by the angle of the threshold in a direction of chance, which is as far as a link can be.
    """
    some = distinct.orderBy(F.xxhash64("id", F.lit(1))).limit(PROBES).collect()
    asked = np.array([r.id for r in some])
    q = unit([bytes(r.raw) for r in some], kind)
    half = q.shape[1] // 2
    near = [distances(q[:, :half], books[0]), distances(q[:, half:], books[1])]
    cell = lambda v: (np.argmin(distances(x, c), axis=1) for x, c in zip((v[:, :half], v[:, half:]), books, strict=True))

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, BLOCK):
                s = b.slice(k, BLOCK)
                v = unit(s["raw"].to_pylist(), kind)
                i, j = np.nonzero((q @ v.T >= threshold) & (asked[:, None] != s["id"].to_numpy()[None, :]))
                c1, c2 = cell(v)
                yield pa.RecordBatch.from_arrays([pa.array(ranks_of(near, i, c1[j], c2[j]), pa.int64())], names=["rank"])

    counts = sorted((r["rank"], r["count"]) for r in distinct.select("id", "raw").mapInArrow(each, "rank long").groupBy("rank").count().collect())
    rank = np.repeat([r for r, _ in counts], [n for _, n in counts]).astype(np.int64)
    if len(rank) < FEW and q.shape[1] > 1:
        rnd = np.random.default_rng(0)
        row = np.arange(FEW) % len(q)
        side = rnd.standard_normal((FEW, q.shape[1]))
        side -= (side * q[row]).sum(axis=1, keepdims=True) * q[row]
        side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
        c1, c2 = cell(threshold * q[row] + np.sqrt(max(0.0, 1 - threshold**2)) * side)
        rank = np.sort(np.concatenate([rank, ranks_of(near, row, c1, c2)]))
    need = rank[max(0, int(np.ceil(TARGET * len(rank))) - 1)] + 1 if len(rank) else 1
    cells = int(max(need, LEAST_CELLS))
    return cells, float((rank < cells).mean()) if len(rank) else 1.0


def near_duplicates(rows: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, and recall, the share of the probes' links that the cells visited hold (the same in all rows)."""
    made, kind = prepared(rows, vec_id, embedding)
    made = written(made.withColumns({"k1": F.xxhash64("raw"), "k2": F.xxhash64(F.lit(7), "raw")}), "vectors")
    valid = made.where("raw is not null")
    distinct = written(valid.groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("raw").alias("raw")), "distinct")
    total = distinct.count()
    if not total:
        return made.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"), F.lit(1.0).alias("recall"))
    sample = unit([bytes(r.raw) for r in distinct.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("raw").collect()], kind)
    half = sample.shape[1] // 2
    k = int(min(MOST_CENTRES, max(4, 2 ** round(np.log2(max(1, total / 12)) / 2))))
    books = [k_means(sample[:, :half], k), k_means(sample[:, half:], k)]
    cells, recall = probe(distinct, kind, books, threshold)
    books_, across = books, len(books[1])

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cell each vector lies in, and the cells that it visits as a query."""
        for b in batches:
            for x in range(0, b.num_rows, 2000):
                s = b.slice(x, 2000)
                v = unit(s["raw"].to_pylist(), kind)
                d = [distances(v[:, :half], books_[0]), distances(v[:, half:], books_[1])]
                own = np.argmin(d[0], axis=1) * across + np.argmin(d[1], axis=1)
                visits = [[i * across + j for i, j in traverse(p, q, cells)] for p, q in zip(*d, strict=True)]
                yield pa.RecordBatch.from_arrays([s["id"], s["n"], s["raw"], pa.array(own.astype(np.int64)), pa.array(visits, pa.list_(pa.int64()))], names=["id", "n", "raw", "cell", "visits"])

    placed = written(distinct.select("id", "n", "raw").mapInArrow(place, "id long, n long, raw binary, cell long, visits array<long>"), "placed")
    # a cell of many vectors is cut into blocks, and its queries go to each; cells that hold none are visited by nobody
    sizes = written(placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")), "sizes")
    members = placed.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("id"), "blocks").alias("block"), F.lit(0).alias("role"), "id", "n", "raw")
    asked = placed.select(F.explode("visits").alias("cell"), "id", "n", "raw").join(sizes, "cell")
    asked = asked.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "id", "n", "raw")
    dealt = members.unionByName(asked).repartition("cell", "block").sortWithinPartitions("cell", "block", "role")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of the queries of a block with its members: a count for each query, and edges that keep them connected."""
        now, ids, weights, raws = None, [], [], []
        member: np.ndarray | None = None

        def some(q_ids: np.ndarray, q_raws: list[bytes]) -> pa.RecordBatch:
            m_ids, m_n = np.array(ids), np.array(weights)
            link = (unit(q_raws, kind) @ member.T >= threshold) & (q_ids[:, None] != m_ids[None, :])
            count = link @ m_n
            every, at = np.unique(np.concatenate([q_ids, m_ids]), return_inverse=True)
            i, j = np.nonzero(link)
            label = merge(np.arange(len(every)), at[: len(q_ids)][i], at[len(q_ids) :][j])
            joined = np.flatnonzero(label != np.arange(len(every)))
            out = np.concatenate([q_ids[count > 0], every[joined]])
            n = np.concatenate([count[count > 0], np.zeros(len(joined), np.int64)])
            root = np.concatenate([q_ids[count > 0], every[label[joined]]])
            return pa.RecordBatch.from_arrays([pa.array(out), pa.array(n.astype(np.int64)), pa.array(root)], names=["id", "n", "root"])

        for b in batches:
            cell, block, role = (b[c].to_numpy() for c in ("cell", "block", "role"))
            key = np.stack([cell, block, role], axis=1)
            edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1), [True]]))
            for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                part = b.slice(x, y - x)
                where = (int(cell[x]), int(block[x]))
                if where != now:
                    now, ids, weights, raws, member = where, [], [], [], None
                if role[x] == 0:
                    ids += part["id"].to_pylist()
                    weights += part["n"].to_pylist()
                    raws += part["raw"].to_pylist()
                elif ids:
                    member = unit(raws, kind) if member is None else member
                    for z in range(0, part.num_rows, TOGETHER):
                        s = part.slice(z, TOGETHER)
                        yield some(s["id"].to_numpy(), s["raw"].to_pylist())

    found = written(dealt.mapInArrow(verify, "id long, n long, root long"), "found")
    components = connected_components(found.where("id <> root").select("id", "root").distinct(), "id", "root")
    links = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    told = distinct.select("k1", "k2", "id", "n").join(links, "id", "left").join(components, F.col("id") == F.col("vertex"), "left")
    told = told.select("k1", "k2", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    good = valid.select("vec_id", "k1", "k2").join(told, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    odd = made.where("raw is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(odd).withColumns({"kept": F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)), "recall": F.lit(recall)})
