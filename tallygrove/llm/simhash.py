"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits that differ in at most four bits differ in at most two on one of their halves. The anchors of
a half are the words of the perfect Hamming code on 31 of its bits, whose covering radius is one. Two halves at most
two bits apart have a point between them that is within one bit of each, and that point has an anchor within the
covering radius; so both lie within radius + half the threshold = two bits of one anchor. Each distinct fingerprint is
replicated to every anchor so near (16 for a half at most) and compared, whole, with the others at that anchor.

Equal fingerprints are one before anything is compared. What leaves an anchor is a forest that keeps its links
connected, never all of its pairs; components come from a distributed contraction of these edges.

A null or empty text has no words and the fingerprint zero, linked like any other. Rows with a null id have a
fingerprint and a component, which their id cannot name. Rows that repeat an id each give a row. Other columns are not
carried. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import written

#: The columns of a text's key.
TEXT_KEY = ["k1", "k2"]
#: Links gathered before they are merged into labels.
LINKS = 1 << 20
#: One of so many texts, and at most so many shingles of them, tell which are frequent. They change the work, not the result.
SAMPLED, OFTEN = 16, 50_000


def shingles(text: str | None, width: int) -> np.ndarray:
    """The hashes of all shingles, repeats included."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, "<u8")
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(whole, 42)]
    else:
        hashes = [digest(whole[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist())]  # noqa: B905 - one end fewer for each word of a shingle
    return np.array(hashes, dtype="<u8")


def majority(table: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(table), 65536):
        ones += np.unpackbits(table[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(table), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, width: int) -> int:
    """The majority bits of the hashes of all shingles, repeats included."""
    return majority(shingles(text, width))


def fingerprints(texts: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, k1, k2, print) of every row of keyed texts; print is the unsigned fingerprint held in a signed long."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                s = b.slice(k, 1000)
                found = np.array([fingerprint(x, width) for x in s["text"].to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([s["doc_id"], s["k1"], s["k2"], pa.array(found)], names=["doc_id", *TEXT_KEY, "print"])

    return texts.mapInArrow(each, "doc_id long, k1 long, k2 long, print long")


def flips() -> np.ndarray:
    """By syndrome, the flips of one or two of 31 bits that lead to a code word; the row is filled up with its first."""
    table = np.zeros((32, 16), dtype=np.uint64)
    for s in range(1, 32):
        pairs = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s]
        table[s] = [1 << (s - 1), *pairs]
    return table


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row of its fingerprint) for every anchor near each fingerprint; the anchor's bit 31 tells the half."""
    table, out, rows = flips(), [], []
    checks = [np.uint64(sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1)) for k in range(5)]
    for half in (0, 1):
        x = (prints >> np.uint64(32 * half)) & np.uint64(0x7FFFFFFF)
        syndrome = sum((np.bitwise_count(x & m).astype(np.int64) & 1) << k for k, m in enumerate(checks))
        near = x[:, None] ^ table[syndrome]
        many = np.where(syndrome > 0, 16, 1)
        keep = np.arange(16)[None, :] < many[:, None]
        out.append((near | np.uint64(half << 31))[keep])
        rows.append(np.repeat(np.arange(len(prints)), many))
    return np.concatenate(out).astype(np.int64), np.concatenate(rows)


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


def forest(anchor: np.ndarray, prints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links within each run of equal anchors (sorted), every pair of which is compared."""
    n = len(anchor)
    labels = np.arange(n)
    change = np.flatnonzero(np.concatenate([anchor[1:] != anchor[:-1], [True]])) + 1 if n else np.zeros(0, int)
    left = np.repeat(change, np.diff(np.concatenate([[0], change]))) - np.arange(n)  # rows of its run from here on
    active, shift, held, size = np.flatnonzero(left > 1), 1, [], 0
    while len(active):
        near = np.bitwise_count(prints[active] ^ prints[active + shift]) <= threshold
        if near.any():
            held.append((active[near], active[near] + shift))
            size += int(near.sum())
            if size > LINKS:
                labels = merge(labels, *(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0
        shift += 1
        active = active[left[active] > shift]
    if held:
        labels = merge(labels, *(np.concatenate(x) for x in zip(*held, strict=True)))
    linked = np.flatnonzero(labels != np.arange(n))
    return prints[linked], prints[labels[linked]]


def links(distinct: DataFrame, threshold: int = 4) -> DataFrame:
    """Edges (src, dst) that connect all fingerprints at most `threshold` (4 or less) bits apart. distinct: column print."""
    if not 0 <= threshold <= 4:
        raise ValueError("halves are covered for thresholds up to 4")

    def replicate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 4000):
                x = b["print"].slice(k, 4000).to_numpy().astype(np.int64)
                at, row = anchors(x.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(x[row])], names=["anchor", "print"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_a, rest_p = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in (*batches, None):
            if b is not None:
                rest_a = np.concatenate([rest_a, b["anchor"].to_numpy()])
                rest_p = np.concatenate([rest_p, b["print"].to_numpy().astype(np.int64).view(np.uint64)])
            # the last run may go on in the next batch
            cut = len(rest_a) if b is None else int(np.searchsorted(rest_a, rest_a[-1])) if len(rest_a) else 0
            if cut:
                src, dst = forest(rest_a[:cut], rest_p[:cut], threshold)
                rest_a, rest_p = rest_a[cut:], rest_p[cut:]
                yield pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], names=["src", "dst"])

    near = distinct.mapInArrow(replicate, "anchor long, print long").repartition("anchor").sortWithinPartitions("anchor")
    return near.mapInArrow(compare, "src long, dst long").distinct()


def first_fifth(found: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Of different shingles, those of which a set of similarity 0.8 or more must share one: frequent ones come last."""
    n = len(found)
    order = np.argsort(often)
    at = np.searchsorted(often, found, sorter=order)
    known = order[np.minimum(at, len(often) - 1)] if len(often) else np.zeros(n, np.int64)
    # the most frequent stand first in `often`, so the last here
    late = np.where(often[known] == found, len(often) - known, 0) if len(often) else known
    return found[np.lexsort((found, late))][: n - (4 * n + 4) // 5 + 1 if n else 0]


#: Texts asked for by a broadcast of their keys, at most (16 bytes each); more are joined by a shuffle.
ASKED = 500_000


def sketch(found: np.ndarray) -> bytes:
    """A bitmap of different shingles by their low bits, of 4 to 8 bits a shingle, its size a power of two."""
    size = max(64, 4 << int(len(found)).bit_length())
    bits = np.zeros(size, dtype=bool)
    bits[found.view(np.uint64) & np.uint64(size - 1)] = True
    return np.packbits(bits).tobytes()


def may_share(x: bytes, n: int, y: bytes, m: int) -> int:
    """No fewer than the shingles that sets of n and m have in common, by their bitmaps: common bits, and what may share a bit."""
    a, b = (np.frombuffer(v, np.uint8) for v in (x, y))
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    count = lambda v: int(np.bitwise_count(v).sum())
    return count(a & b) + min(n - count(a), m - count(b))


def text_key(text: Column) -> list[Column]:
    """A text's 128-bit key in two numbers."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return chosen.select("doc_id", *text_key(F.col("text")), "text")


def frequent(texts: DataFrame, width: int) -> np.ndarray:
    """The most frequent shingles of a sample of the texts, at most OFTEN, in order."""

    def some(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                tables = [np.unique(shingles(x, width)) for x in b["text"].slice(k, 500).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tables).view(np.int64))], names=["shingle"])

    counts = texts.where(F.pmod("k2", F.lit(SAMPLED)) == 0).select("text").mapInArrow(some, "shingle long").groupBy("shingle").count()
    top = counts.where("count > 2").orderBy(F.desc("count"), "shingle").limit(OFTEN).collect()
    return np.array([r.shingle for r in top], dtype=np.int64).view(np.uint64)


def profiles(texts: DataFrame, width: int) -> DataFrame:
    """Per row doc_id, k1, k2, print, a digest of its set of shingles, their number, the first fifth of them, and a sketch."""
    often = frequent(texts, width)

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            for k in range(0, b.num_rows, 500):
                s, got = b.slice(k, 500), []
                for x in s["text"].to_pylist():
                    table = shingles(x, width)
                    found = np.unique(table)
                    got.append((majority(table), xxhash.xxh128_digest(found.tobytes()), len(found), first_fifth(found, often).view(np.int64), sketch(found)))
                prints = pa.array(np.array([g[0] for g in got], dtype=np.uint64).view(np.int64))
                made = [prints, pa.array([g[1] for g in got], pa.binary()), pa.array([g[2] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.list_(pa.int64())), pa.array([g[4] for g in got], pa.binary())]
                yield pa.RecordBatch.from_arrays([s["doc_id"], s["k1"], s["k2"], *made], names=["doc_id", *TEXT_KEY, "print", "same", "n", "first", "bits"])

    return texts.mapInArrow(sets, "doc_id long, k1 long, k2 long, print long, same binary, n long, first array<long>, bits binary")


def leads(sets: DataFrame) -> DataFrame:
    """(shingle, id, at, lead) of each shingle in the first fifths of two sets (id, first) or more: its place, and the set where it comes first."""
    meet = Window.partitionBy("shingle")
    ends = sets.select("id", F.posexplode("first").alias("at", "shingle"))
    return ends.withColumns({"lead": F.min(F.struct("at", "id")).over(meet)["id"], "sets": F.count("id").over(meet)}).where("sets > 1").select("shingle", "id", "at", "lead")


def similar(texts: DataFrame, rows: DataFrame, roots: DataFrame, width: int) -> DataFrame:
    """(print, root) of roots (print, root) after joining those of texts whose sets of shingles have a Jaccard similarity of 0.8 or more.

    Similar sets share one of the first fifth of their shingles in any order that is the same for all sets, so no pair
    is lost, whatever the order. The order puts shingles last that are frequent in a sample of texts. Sets that share
    one are compared by size, then by bitmaps that never tell of too few common shingles, then as a whole: first each
    with the one of those that share it that has the fewest rarer shingles, then all that are still apart. Of near copies of one
    text that is the one least changed. The others join it, but those changed too much; these hold so many shingles of
    their own that what they share with the group comes too late in their order to meet it again.
    """
    one = rows.where("n > 0").groupBy("same", "print").agg(F.first(F.struct(*TEXT_KEY, "n", "first", "bits")).alias("s")).select("print", "s.*")
    one = written(one.withColumn("id", F.monotonically_increasing_id()), "sets")
    shared = written(leads(one), "shared")  # most shingles are in one set only

    def fitting(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = (b[c].to_pylist() for c in ("bits_a", "n_a", "bits_b", "n_b"))
            good = [9 * may_share(x, n, y, m) >= 4 * (n + m) for x, n, y, m in zip(*columns, strict=True)]
            yield b.select([f"{c}_{k}" for k in "ab" for c in (*TEXT_KEY, "root")]).filter(pa.array(good, pa.bool_()))

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                s = b.slice(k, 500)
                made = pa.array([np.unique(shingles(x, width)).tobytes() for x in s["text"].to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([s["k1"], s["k2"], made], names=[*TEXT_KEY, "table"])

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b["table_a"], b["table_b"], strict=True):
                p, q = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[at] == p).sum())
                good.append(5 * both >= 4 * (len(p) + len(q) - both))
            yield b.select(["src", "dst"]).filter(pa.array(good, pa.bool_()))

    def verified(near: DataFrame, sets: DataFrame) -> DataFrame:
        """(src, dst): the roots of those pairs (id_a, id_b) of sets with different roots that are similar."""
        for k in "ab":
            near = near.join(sets.select(*(F.col(c).alias(f"{c}_{k}") for c in ("id", "root", "n", *TEXT_KEY))), f"id_{k}")
        near = near.where("root_a <> root_b and 5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)")
        for k in "ab":
            near = near.join(one.select(F.col("id").alias(f"id_{k}"), F.col("bits").alias(f"bits_{k}")), f"id_{k}")
        kinds = ", ".join(f"{c}_{k} long" for k in "ab" for c in (*TEXT_KEY, "root"))
        near = written(near.mapInArrow(fitting, kinds), "near")
        asked = near.select(F.col("k1_a").alias("k1"), F.col("k2_a").alias("k2")).union(near.select("k1_b", "k2_b")).distinct()
        asked = F.broadcast(asked) if 2 * near.count() <= ASKED else asked
        found = texts.join(asked, TEXT_KEY, "left_semi").dropDuplicates(TEXT_KEY).select(*TEXT_KEY, "text")
        tables = written(found.mapInArrow(whole, "k1 long, k2 long, table binary"), "tables")
        for k in "ab":
            near = near.join(tables.select(*(F.col(c).alias(f"{c}_{k}") for c in (*TEXT_KEY, "table"))), [f"k1_{k}", f"k2_{k}"])
        return near.select(F.col("root_a").alias("src"), F.col("root_b").alias("dst"), "table_a", "table_b").mapInArrow(verify, "src long, dst long").distinct()

    for k in range(2):
        sets = written(one.select("id", "print", "n", *TEXT_KEY).join(roots, "print").drop("print"), "rooted")
        if k == 0:
            near = shared.where("id <> lead").select(F.col("id").alias("id_a"), F.col("lead").alias("id_b")).distinct()
        else:
            at = shared.select("shingle", "id", "at").join(sets.select("id", "root", "n"), "id")
            mixed = at.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shingle")
            at = written(at.join(mixed, "shingle", "left_semi"), "apart")
            left, right = (at.select("shingle", *(F.col(c).alias(f"{c}_{k}") for c in ("id", "root", "n", "at"))) for k in "ab")
            near = left.join(right, "shingle").where("id_a < id_b and root_a <> root_b and 5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)")
            # what the sets can share from this place on, if they shared nothing before
            near = near.where("9 * least(n_a - at_a, n_b - at_b) >= 4 * (n_a + n_b)").select("id_a", "id_b").distinct()
        more = connected_components(verified(near, sets))
        joint = roots.join(more, roots["root"] == more["vertex"], "left")
        roots = written(joint.select("print", F.coalesce("component", "root").alias("root")), "joined")
    return roots


def rooted(texts: DataFrame, width: int, threshold: int, alike: bool) -> tuple[DataFrame, DataFrame]:
    """((doc_id, k1, k2, print, ...) of each row of keyed texts, (print, root) of each fingerprint): fingerprints of one component share the root.

    With `alike`, texts whose sets of shingles have a similarity of 0.8 or more are linked as well.
    """
    prints = written(profiles(texts, width) if alike else fingerprints(texts, width), "prints")
    distinct = written(prints.select("print").distinct(), "distinct")
    found = connected_components(links(distinct, threshold))
    roots = written(distinct.join(found, distinct["print"] == found["vertex"], "left").select("print", F.coalesce("component", "print").alias("root")), "roots")
    return prints, similar(texts, prints, roots, width) if alike else roots


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, threshold: int = 4, alike: bool = False) -> DataFrame:
    """(doc_id, print, component_id): fingerprints and, for each row, the smallest doc_id reachable over links."""
    prints, roots = rooted(keyed(docs, doc_id, text), width, threshold, alike)
    least = written(prints.groupBy("print").agg(F.min("doc_id").alias("least")).join(roots, "print"), "rooted")
    each = least.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.select("doc_id", "print").join(least.join(each, "root").select("print", "component_id"), "print").select("doc_id", "print", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, threshold: int = 4, alike: bool = False) -> DataFrame:
    """docs with one document of each component: the smallest by id, of rows that share an id by the key of their text.

    Rows of one id and text are one document: all of them stay or none. Rows with a null id stay.
    """
    prints, roots = rooted(keyed(docs, doc_id, text), width, threshold, alike)
    rows = prints.where("doc_id is not null").select("print", F.struct("doc_id", *TEXT_KEY).alias("_me"))
    least = written(rows.groupBy("print").agg(F.min("_me").alias("_least")).join(roots, "print"), "rooted")
    first = least.join(least.groupBy("root").agg(F.min("_least").alias("_first")), "root").select("print", "_first")
    gone = rows.join(first, "print").where("_me <> _first").select(F.col("_me.doc_id").alias("_id"), F.col("_me.k1").alias("_g1"), F.col("_me.k2").alias("_g2")).distinct()
    column = lambda c: F.col(f"`{c}`")
    whole = docs.select(F.struct(*map(column, docs.columns)).alias("_row"), column(doc_id).cast("long").alias("_doc"), *text_key(column(text)))
    dropped = (F.col("_doc") == F.col("_id")) & (F.col("k1") == F.col("_g1")) & (F.col("k2") == F.col("_g2"))
    return whole.join(gone, dropped, "left_anti").select("_row.*")
