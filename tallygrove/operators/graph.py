"""Graph operators: connected components, bounded ancestors, attribute closure."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

#: Edges that one task settles at once: a few megabytes. More are contracted first, whatever their number.
SMALL = 250_000


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking rows a with rows b: the smallest row linked, directly or not."""
    while True:
        x, y = labels[a], labels[b]
        far = x != y
        if not far.any():
            return labels
        a, b, x, y = a[far], b[far], x[far], y[far]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (jumped := labels[labels]).tobytes() != labels.tobytes():
            labels = jumped


def settled(edges: DataFrame) -> DataFrame:
    """(u, to) for each vertex of at most SMALL edges: one vertex of its component."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        ends = [b[c] for c in ("u", "v") for b in held]
        if ends:
            found = pa.concat_arrays(ends).dictionary_encode()
            at, n = found.indices.to_numpy(), sum(b.num_rows for b in held)
            root = merge(np.arange(len(found.dictionary)), at[:n], at[n:])
            yield pa.RecordBatch.from_arrays([found.dictionary, found.dictionary.take(pa.array(root))], names=["u", "to"])

    kind = edges.schema["u"].dataType
    return edges.coalesce(1).mapInArrow(each, T.StructType([T.StructField("u", kind), T.StructField("to", kind)]))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(vertex, component) for every vertex of an edge; component is the smallest vertex reachable.

    Edges are undirected; repeats, loops and rows with a null end are ignored. An empty edge table gives an empty
    result. Each round hashes the vertices anew and moves every vertex twice towards its neighbour of the smallest hash;
    the edges between what they moved to are the next round's. A vertex has a neighbour of a smaller hash at least every
    second time, so a round leaves about half of the vertices or fewer, in chains as well, and always fewer than before:
    it goes on until no edge is left, or so few that one task can settle them. A hot vertex's neighbours are reduced in
    aggregates that combine before the shuffle; the joins with them have one row a vertex on one side, so a skewed one is split.
    """
    u, v = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    e = written(e.select(u, v).distinct(), "edges")
    moves = []
    while n := e.count():
        if n <= SMALL:
            moves.append(written(settled(e), "moves"))
            break
        rank = lambda x: F.struct(F.xxhash64(F.lit(len(moves)), x).alias("h"), F.col(x).alias("to"))
        both = e.select("u", rank("v").alias("r")).union(e.select(F.col("v").alias("u"), rank("u").alias("r")))
        once = both.groupBy("u").agg(F.min("r").alias("r")).select("u", F.least("r", rank("u"))["to"].alias("to"))
        once = written(once, "moves")
        twice = once.join(once.select(F.col("u").alias("to"), F.col("to").alias("far")), "to").select("u", F.col("far").alias("to"))
        moved = written(twice, "moves")
        at_u, at_v = moved.select("u", F.col("to").alias("tu")), moved.select(F.col("u").alias("v"), F.col("to").alias("tv"))
        e = e.join(at_u, "u").join(at_v, "v").select(F.col("tu").alias("u"), F.col("tv").alias("v")).where("u <> v")
        e = written(e.select(u, v).distinct(), "edges")
        moves.append(moved)
    if not moves:
        return e.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    # where the vertices of each round end, from the last round back
    ends = moves.pop()
    while moves:
        before = moves.pop()
        after = ends.select(F.col("u").alias("to"), F.col("to").alias("end"))
        ends = written(before.join(after, "to", "left").select("u", F.coalesce("end", "to").alias("to")), "ends")
    least = ends.groupBy("to").agg(F.min("u").alias("component"))
    return ends.join(least, "to").select(F.col("u").alias("vertex"), "component")
