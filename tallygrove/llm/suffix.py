"""Removal of long repeated byte strings by two-stage suffix sorting.

A byte goes if a string of `length` bytes over it also starts anywhere else. Which strings can be equal is found first:
each of them (a window) has the smallest of the hashes of its short grams as its key, so equal windows have equal keys.
Neighbouring windows with one key are a stretch. Equal texts are one text with a count, equal stretches one stretch
with a count; a stretch found twice is covered as a whole. Only stretches that share a key with a different one, or
that hold their key twice, can repeat in part: one of each is cut out and sorted.

Stretches of a key meet in one shard of bounded bytes, whose suffixes are sorted in two stages: suffixes smaller than
their successors are sorted directly, the others are put in their places by scanning the buckets of first bytes in
order. Common prefixes of neighbours in this order tell the windows that repeat. A key shared by very many different
stretches is split by further hashes of its windows, as often as needed, so no shard outgrows its bound but for
windows that agree in all of them.

Nulls count as empty texts. Every row counts as a text of its own, whatever its id: rows that repeat are removed where
they are long enough. Rows with a null id are treated alike. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir, written

LENGTH = 200
#: Bytes of a gram; windows of a stretch, at most.
GRAM, STRETCH = 32, 400
#: Bytes of a shard of stretches that are sorted together, about.
SHARD_BYTES = 2_000_000
#: Different stretches of one key beyond which its windows are split by further hashes.
MANY = 2000
SEEDS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]


def grams(raw: np.ndarray) -> np.ndarray:
    """A number for the GRAM bytes that start at each place, by doubling."""
    h = raw.astype(np.uint64) + np.uint64(1)
    step, base = 1, 0x100000001B3
    while step < GRAM:
        h = h[:-step] * np.uint64(base) + h[step:]
        base, step = base * base % (1 << 64), step * 2
    return h


def mixed(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(seed)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    step = 1
    while step * 2 <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    more = width - step
    return np.minimum(h[: len(h) - more], h[more:]) if more else h


def keys(raw: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window its key, and the mixed grams."""
    h = mixed(grams(raw), seed)
    return sliding_least(h, length - GRAM + 1), h


def stretches(raw: bytes, length: int) -> Iterator[tuple[int, int, int, bool]]:
    """(key, first window, windows, whether the key is found in it twice) of each stretch."""
    if len(raw) < length:
        return
    window, h = keys(np.frombuffer(raw, dtype=np.uint8), length, SEEDS[0])
    edge = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1], [True]]))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        key = window[a]
        for x in range(a, b, STRETCH):
            n = min(STRETCH, b - x)
            # a stretch of more windows than there are places in a window for the key holds it twice
            twice = n > 1 and int((h[x : x + n + length - GRAM] == key).sum()) > 1
            yield int(key), x, n, twice


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of s, ordered by their first `depth` symbols at least, in two stages.

    s ends with its only 0. A suffix is of kind B if it is smaller than its successor, else of kind A.
    """
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    # kind, from the next different symbol on
    change = np.flatnonzero(s[:-1] != s[1:])
    nxt = np.searchsorted(change, np.arange(n - 1))
    small = np.zeros(n, dtype=bool)
    small[:-1] = s[change[nxt]] < s[change[nxt] + 1]
    # stage one: kind B, by eight symbols at a time, those still equal again
    b = np.flatnonzero(small)
    padded = np.concatenate([s.astype(np.uint64), np.zeros(depth + 8, np.uint64)])
    packed = padded[: n + depth]
    for step in (1, 2, 4):
        packed = (packed[:-step] << np.uint64(8 * step)) | packed[step:]
    group = np.zeros(len(b), dtype=np.int64)  # place of the first with equal symbols so far
    open_, at = np.arange(len(b)), 0
    while len(open_) and at < depth:
        k = packed[b[open_] + at]
        order = np.lexsort((k, group[open_]))
        moved, g, k = b[open_][order], group[open_][order], k[order]
        b[open_] = moved
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])])
        begin = np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))
        group[open_] = open_[begin]
        alone = new & np.concatenate([new[1:], [True]])
        open_ = open_[~alone]
        at += 8
    # stage two: buckets in order; what stands before a suffix and is not smaller is of kind A and goes to its bucket's head
    counts = np.bincount(s, minlength=257)
    head = np.cumsum(counts) - counts
    tail_b = np.bincount(s[b], minlength=257)
    out = np.empty(n, dtype=np.int64)
    placed_b = 0
    begins = head.copy()
    out[0] = n - 1
    heads = head.copy()
    heads[0] = 1

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[~small[before]]
        if not len(before):
            return
        first = s[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        edge = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        for x, y in zip(edge.tolist(), [*edge[1:].tolist(), len(first)], strict=True):
            c, m = first[x], y - x
            out[heads[c] : heads[c] + m] = before[x:y]
            heads[c] += m

    induce(out[:1])
    for c in range(1, 257):
        if not counts[c]:
            continue
        done = begins[c]
        while done < heads[c]:  # of kind A, also those that the scan itself adds to the bucket
            upto = heads[c]
            induce(out[done:upto])
            done = upto
        m = tail_b[c]
        out[done : done + m] = b[placed_b : placed_b + m]
        placed_b += m
        induce(out[done : done + m])
    return out


def repeated(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each part, the windows (their places) that are found elsewhere in the parts too."""
    if not parts:
        return []
    ends = np.cumsum([len(p) + 1 for p in parts])
    s = np.empty(int(ends[-1]), dtype=np.uint8)
    text = np.frombuffer(b"\x00".join(parts) + b"\x00", dtype=np.uint8)
    # bytes get the numbers 2 to 255 where they can, as UTF-8 never holds 254 or 255; 1 ends a part and 0 the shard
    s[:] = np.minimum(text, 253) + 2
    s[ends - 1] = 1
    s = np.append(s, np.uint8(0))
    order = suffix_order(s, length)
    left = np.full(len(s), 0)
    left[: len(s) - 1] = np.repeat(ends - 1, np.diff(np.concatenate([[0], ends]))) - np.arange(len(s) - 1)
    whole = order[left[order] >= length]  # suffixes with a window; equal windows are neighbours among all suffixes
    # common prefixes of neighbours, by words of eight bytes
    padded = np.concatenate([s, np.zeros(8, np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):
        padded = (padded[:-step] << np.uint64(8 * step)) | padded[step:]
    a, b = whole[:-1], whole[1:]
    same = np.arange(len(a))
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        same = same[padded[a[same] + at] == padded[b[same] + at]]
    hit = np.zeros(len(s), dtype=bool)
    hit[a[same]] = hit[b[same]] = True
    starts = ends - [len(p) + 1 for p in parts]
    return [np.flatnonzero(hit[x : x + max(0, len(p) - length + 1)]) for x, p in zip(starts.tolist(), parts, strict=True)]


def runs(places: np.ndarray) -> list[tuple[int, int]]:
    """(first, number) of each run of neighbouring places."""
    edge = np.flatnonzero(np.concatenate([[True], np.diff(places) > 1, [True]])) if len(places) else np.zeros(1, int)
    return [(int(places[x]), int(y - x)) for x, y in zip(edge[:-1], edge[1:], strict=True)]


def digest(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def with_key(docs: DataFrame, text: str) -> DataFrame:
    """docs with _raw, the text's bytes, and its 128-bit key in two numbers."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.withColumns({"_raw": raw, "_k1": F.xxhash64(raw), "_k2": F.xxhash64(F.lit(7), raw)})


KEY = ["_k1", "_k2"]


def distinct_texts(docs: DataFrame, text: str) -> DataFrame:
    """The different texts (_k1, _k2, _raw, _n: rows), as a table in buckets of their key, so joins on it move no text."""
    spark = docs.sparkSession
    texts = with_key(docs.select(F.col(f"`{text}`").alias("_text")), "_text").groupBy(*KEY).agg(F.first("_raw").alias("_raw"), F.count("*").alias("_n"))
    name = f"texts_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    to = texts.write.bucketBy(parts, *KEY).option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd")
    to.format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"drop table {name}")  # the files stay, as the plan reads them
    return table


def covered(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(_k1, _k2, spans) of the distinct texts with bytes that repeat: [begin, end) pairs, in no order, that may overlap."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in range(0, b.num_rows, 200):
                s = b.slice(x, 200)
                got: list[list] = [[] for _ in range(6)]
                for k1, k2, raw, n in zip(*(s[k].to_pylist() for k in (*KEY, "_raw", "_n")), strict=True):
                    for k, first, windows, twice in stretches(raw, length):
                        row = (k - (1 << 64) if k >> 63 else k, digest(raw[first : first + windows + length - 1]), k1, k2, first << 11 | windows << 1 | twice, n)
                        for column, v in zip(got, row, strict=True):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in got], names=["gram", "same", *KEY, "at", "n"])

    found = texts.where(F.length("_raw") >= length).mapInArrow(find, "gram long, same long, _k1 long, _k2 long, at long, n long")
    # one exchange by gram tells which stretches have an equal one and which have only others of their key
    gram, same = Window.partitionBy("gram"), Window.partitionBy("gram", "same")
    told = found.repartition("gram").withColumns({
        "copies": F.sum("n").over(same),
        "rank": F.row_number().over(same.orderBy(*KEY, "at")),
        "many": F.count("*").over(gram),
        "differ": F.min("same").over(gram) != F.max("same").over(gram),
    })
    twice = F.col("at").bitwiseAND(1) == 1
    sorted_ = (F.col("rank") == 1) & (F.col("differ") | (twice & (F.col("copies") == 1)))
    told = told.withColumn("sort", sorted_).where(F.col("sort") | (F.col("copies") > 1))
    first = F.shiftright("at", 11)
    windows = F.shiftright("at", 1).bitwiseAND(1023)
    told = written(told.select(*KEY, "gram", "copies", "many", "sort", first.cast("int").alias("first"), windows.cast("int").alias("windows")), "stretches")
    # those with an equal one are covered whole, and stand once among the others of their key
    whole = told.where("copies > 1").select(*KEY, F.col("first").alias("begin"), (F.col("first") + F.col("windows") + length - 1).alias("end"))
    cut = texts.select(*KEY, "_raw").join(told.where("sort").hint("shuffle_hash"), KEY)
    pieces = cut.select(*KEY, "gram", "many", "first", (F.col("copies") == 1).alias("ask"), F.expr(f"substring(_raw, first + 1, windows + {length - 1})").alias("raw"))

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each stretch, or the windows of one with a key of very many by further keys."""
        for b in batches:
            got: list[list] = [[] for _ in range(6)]
            for k1, k2, gram, many, first, ask, raw in zip(*(b[k].to_pylist() for k in (*KEY, "gram", "many", "first", "ask", "raw")), strict=True):
                if many <= MANY:
                    parts = [(gram, 0, len(raw) - length + 1)]
                else:
                    more = [keys(np.frombuffer(raw, np.uint8), length, s)[0] for s in SEEDS[1:]]
                    joint = more[0] * np.uint64(SEEDS[1]) ^ more[1] * np.uint64(SEEDS[2]) ^ more[2] ^ np.uint64(gram % (1 << 64))
                    edge = np.flatnonzero(np.concatenate([[True], joint[1:] != joint[:-1], [True]]))
                    parts = [(int(joint[x].view(np.int64)), x, y - x) for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                for shard, offset, n in parts:
                    for column, v in zip(got, (shard, k1, k2, first + offset, ask, raw[offset : offset + n + length - 1]), strict=True):
                        column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(got, kinds, strict=True)], names=["shard", *KEY, "first", "ask", "raw"])

    def sort(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            hits = repeated([x[4] for x in held], length)
            rows = [(k1, k2, first + a, first + a + n + length - 1) for (k1, k2, first, ask, _), p in zip(held, hits, strict=True) if ask for a, n in runs(p)]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=[*KEY, "begin", "end"])

        for b in batches:
            for shard, *row in zip(*(b[k].to_pylist() for k in ("shard", *KEY, "first", "ask", "raw")), strict=True):
                if shard != last and size > SHARD_BYTES:
                    yield flush()
                    held, size = [], 0
                last = shard
                held.append(row)
                size += len(row[4])
        if held:
            yield flush()

    dealt = pieces.mapInArrow(split, "shard long, _k1 long, _k2 long, first int, ask boolean, raw binary").repartition("shard").sortWithinPartitions("shard")
    partly = dealt.mapInArrow(sort, "_k1 long, _k2 long, begin int, end int")
    return partly.unionByName(whole).groupBy(*KEY).agg(F.collect_list(F.struct("begin", "end")).alias("spans"))


def merged(spans: Iterable[tuple[int, int]]) -> list[list[int]]:
    """Spans that touch or overlap as one, in order."""
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([begin, end])
    return out


def cleaned(docs: DataFrame, text: str = "text", length: int = LENGTH, characters: bool = False) -> DataFrame:
    """(_k1, _k2, kept, n_bytes, n_removed, n_spans) of each distinct text: kept is what remains, as bytes.

    With `characters` the bytes of a character that a cut has broken are left out too.
    """
    texts = distinct_texts(docs, text)
    # a text with a copy is covered as a whole; its stretches count as found elsewhere for the others
    copied = (F.col("_n") > 1) & (F.length("_raw") >= length)

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in range(0, b.num_rows, 500):
                s = b.slice(x, 500)
                got: list[list] = [[] for _ in range(4)]
                for raw, spans, whole in zip(s["_raw"].to_pylist(), s["spans"].to_pylist(), s["whole"].to_pylist(), strict=True):
                    cuts = [[0, len(raw)]] if whole else merged((v["begin"], v["end"]) for v in spans or ())
                    edges = [0, *(x for c in cuts for x in c), len(raw)]
                    parts = [raw[p:q] for p, q in zip(edges[::2], edges[1::2], strict=True)]
                    kept = b"".join(p.decode(errors="ignore").encode() for p in parts) if characters else b"".join(parts)
                    for column, v in zip(got, (kept, len(raw), sum(q - p for p, q in cuts), len(cuts)), strict=True):
                        column.append(v)
                made = [pa.array(got[0], pa.binary()), *(pa.array(v, pa.int64()) for v in got[1:])]
                yield pa.RecordBatch.from_arrays([s["_k1"], s["_k2"], *made], names=[*KEY, "kept", "n_bytes", "n_removed", "n_spans"])

    spans = covered(texts, length).hint("shuffle_hash")
    told = texts.join(spans, KEY, "left").select(*KEY, "_raw", "spans", copied.alias("whole"))
    return told.mapInArrow(remove, "_k1 long, _k2 long, kept binary, n_bytes long, n_removed long, n_spans long")


def counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and the digest of what remains."""
    got = cleaned(docs, text, length).select(*KEY, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    rows = with_key(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")), "_text").select("doc_id", *KEY)
    return rows.join(got, KEY).drop(*KEY)


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """docs with the remaining text of each row; a character of which a byte went loses its other bytes too."""
    got = cleaned(docs, text, length, characters=True).where("n_removed > 0").select(*KEY, F.col("kept").cast("string").alias("_kept"))
    column = lambda c: F.col(f"`{c}`")
    whole = docs.select(F.struct(*map(column, docs.columns)).alias("_row"), column(text).alias("_text"))  # columns of any name stay apart from ours
    rows = with_key(whole, "_text").drop("_raw").join(got, KEY, "left")
    remaining = F.coalesce("_kept", "_text").alias(text)
    return rows.select(*[remaining if c == text else F.col("_row")[c].alias(c) for c in docs.columns])
