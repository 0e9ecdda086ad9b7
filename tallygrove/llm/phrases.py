"""Phrase collocation mining by hashed bucket counts and pruned exact counting.

Each pass over the texts counts phrases of one length exactly and those of the next length by bucket: a bucket sums the
occurrences of all phrases that hash to it, so a phrase of a bucket below the least count can't be frequent. What the next
pass may count must have a full bucket, and parts that were found frequent (a part of a frequent phrase is). Both are
told to the tasks by bitmaps of a fixed number of bits (LEAST_BITS to MOST_BITS, by the size of the texts): the full buckets, and the hashes
of the frequent phrases of the pass before. A bitmap only rules out; what is left is counted exactly and held to the least count, so
chance hits cost a count and change nothing. Where the corpus outgrows MOST_BITS the bitmaps fill up and less is ruled out.

Counts are summed in each task first, for a chunk of the texts at a time, and again before the shuffle. Bucket counts
travel packed, a row for each range of buckets, and meet range by range. Phrases are ranked in groups first, so no task sorts all of a language.

Everything is per language; a null language is `und`. A-Z are lower-cased. Texts are cut into pieces at SEPARATORS and
pieces into words at spaces and tabs. Null and empty texts have no words. Every row counts, repeated or not. An empty
table gives no phrases. Other columns are not read. A text longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written
from .substring import mixed, rolling

LEAST, TOP, LONGEST, UNKNOWN = 10, 2000, 3, "und"
SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"
#: Text bytes of a chunk; bits of a bitmap, at least and at most, as powers of 2; of a range of buckets.
CHUNK_BYTES, LEAST_BITS, MOST_BITS, RANGE_BITS = 12_000_000, 20, 28, 18
#: Groups in which a language's phrases are ranked first.
GROUPS = 64
#: A phrase's count (phrase null: a language's words), or the counts of a range's buckets in a chunk (buckets, and times up to 255).
COUNTED = "lang string, phrase string, n long, range long, buckets binary, times binary"
KINDS = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
NAMES = [x.split()[0] for x in COUNTED.split(", ")]


class Tokens:
    """The words of texts of one language in order; a piece ends before a separator's mark."""

    def __init__(self, lang: str, texts: Iterable[bytes]):
        cut = bytes.maketrans(SEPARATORS, b"." * len(SEPARATORS))
        pieces = (t.lower().translate(cut).replace(b".", b" . ").split() for t in texts)  # bytes.lower() knows A-Z alone
        found = pa.array(chain.from_iterable(chain(p, (b".",)) for p in pieces), pa.binary()).dictionary_encode()
        self.ids = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = found.dictionary
        words = self.words.to_pylist()
        seed = blake2b(lang.encode(), digest_size=8).digest()
        self.hashes = np.frombuffer(b"".join(blake2b(w, digest_size=8, key=seed).digest() for w in words), "<u8")
        self.real = np.array([w != b"." for w in words], dtype=bool)[self.ids]
        self.all = self.hashes[self.ids]

    def runs(self, n: int) -> np.ndarray:
        """Whether the n tokens from each place on are words of one piece."""
        ok = self.real[: max(0, len(self.real) - n + 1)].copy()
        for k in range(1, n):
            ok &= self.real[k : len(self.real) - n + 1 + k]
        return ok

    def hashed(self, n: int) -> np.ndarray:
        return mixed(rolling(self.all, n)) if len(self.all) >= n else self.all[:0]

    def phrases(self, at: np.ndarray, n: int) -> tuple[pa.Array, np.ndarray]:
        """The different phrases of n words that begin at these places, and their counts."""
        key = self.ids[at]
        for k in range(1, n):
            _, key = np.unique(key, return_inverse=True) if k > 1 else (None, key)
            key = key << 32 | self.ids[at + k]
        _, first, times = np.unique(key, return_index=True, return_counts=True)
        parts = [self.words.take(pa.array(self.ids[at[first] + k])).cast(pa.string()) for k in range(n)]
        return (pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]), times


def bit(bitmap: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    b = h & np.uint64((1 << bits) - 1)
    return (bitmap[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def table(*columns: object) -> pa.RecordBatch:
    n = next(len(c) for c in columns if c is not None)
    return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else pa.array(c, k) if not isinstance(c, pa.Array) else c for c, k in zip(columns, KINDS, strict=True)], names=NAMES)


def packed(h: np.ndarray, bits: int) -> pa.RecordBatch:
    """The counts of the buckets that these hashes fall in, a row for each range of buckets."""
    found, times = np.unique((h & np.uint64((1 << bits) - 1)).astype(np.int64), return_counts=True)
    edge = np.searchsorted(found, np.arange(0, (1 << bits) + 1, 1 << RANGE_BITS))
    full = np.flatnonzero(np.diff(edge)).tolist()
    low, times = (found & ((1 << RANGE_BITS) - 1)).astype("<u4"), np.minimum(times, 255).astype(np.uint8)
    cut = [slice(edge[k], edge[k + 1]) for k in full]
    return table(None, None, None, pa.array(full, pa.int64()), pa.array([low[c].tobytes() for c in cut], pa.binary()), pa.array([times[c].tobytes() for c in cut], pa.binary()))


def by_language(batches: Iterable[pa.RecordBatch]) -> Iterator[Tokens]:
    for b in batches:
        step = max(1, int(b.num_rows * CHUNK_BYTES / max(1, b.nbytes)))
        for k in range(0, b.num_rows, step):
            s = b.slice(k, step)
            for lang in s["lang"].unique().to_pylist():
                yield lang, Tokens(lang, s.filter(pc.equal(s["lang"], lang))["text"].cast(pa.binary()).to_pylist())


def bitmap(rows: DataFrame, bits: int, least: int) -> bytearray:
    """The bits of all buckets with `least` occurrences or more; of 1 << bits bits, whatever the rows."""

    def each(got: pa.Table) -> pa.Table:
        counts = np.zeros(1 << RANGE_BITS, dtype=np.int64)
        for low, times in zip(got["buckets"].to_pylist(), got["times"].to_pylist(), strict=True):
            counts[np.frombuffer(low, "<u4")] += np.frombuffer(times, np.uint8)
        return pa.table([got["range"].slice(0, 1), pa.array([np.packbits(counts >= least, bitorder="little").tobytes()], pa.binary())], names=["range", "bits"])

    out, size = bytearray((1 << bits) // 8), (1 << RANGE_BITS) // 8
    for r in rows.where("range is not null").select("range", "buckets", "times").groupBy("range").applyInArrow(each, "range long, bits binary").toLocalIterator():
        out[r["range"] * size : (r["range"] + 1) * size] = r["bits"]
    return out


def counted(spark: SparkSession, docs: DataFrame, n: int, bits: int, maps: tuple[bytearray, bytearray] | None) -> DataFrame:
    """A pass: exact counts of phrases of n words that may be frequent, and bucket counts of those of n + 1 words whose parts may.

    maps: bitmaps of the frequent phrases of n - 1 words and of the full buckets of phrases of n words.
    """
    told = spark.sparkContext.broadcast(tuple(map(bytes, maps))) if maps else None

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, full = (np.frombuffer(m, np.uint8) for m in told.value) if told else (None, None)
        for lang, t in by_language(batches):
            ok, h = t.runs(n), t.hashed(n)
            if n == 1:
                yield table(pa.array([lang]), None, pa.array([int(ok.sum())]), None, None, None)
            else:
                part = bit(frequent, bits, t.hashed(n - 1))
                ok[ok] = bit(full, bits, h[ok])
                ok &= part[:-1] & part[1:] if len(part) else False
            at = np.flatnonzero(ok)
            if len(at):
                phrase, times = t.phrases(at, n)
                yield table(pa.array([lang] * len(phrase)), phrase, times, None, None, None)
            if n < LONGEST and len(ok) > 1:
                longer = t.runs(n + 1) & ok[:-1] & ok[1:]
                yield packed(t.hashed(n + 1)[longer], bits)

    return written(docs.mapInArrow(each, COUNTED), f"counts_{n}")


def frequent(rows: DataFrame, least: int) -> DataFrame:
    exact = rows.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    return written(exact.where(F.col("f") >= least), "frequent")


def marks(phrases: DataFrame, n: int, bits: int) -> DataFrame:
    """The buckets of phrases of n words, as counted() packs them."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang in b["lang"].unique().to_pylist():
                t = Tokens(lang, [p for p in b.filter(pc.equal(b["lang"], lang))["phrase"].cast(pa.binary()).to_pylist()])
                yield packed(t.hashed(n)[t.runs(n)], bits)

    return phrases.mapInArrow(each, COUNTED)


def mined(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) words of each language, and for 1 to LONGEST words the frequent phrases: (lang, phrase, f)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (size // 24).bit_length()))
    found, maps, totals = [], None, None
    for n in range(1, LONGEST + 1):
        got = counted(spark, rows, n, bits, maps)
        totals = got.where("phrase is null and range is null").groupBy("lang").agg(F.sum("n").alias("n")) if n == 1 else totals
        found.append(frequent(got, least))
        if n < LONGEST:
            maps = bitmap(marks(found[-1], n, bits), bits, 1), bitmap(got, bits, least)
    return totals, found


def scored(found: list[DataFrame]) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the frequent phrases of two words or more: the cut that scores lowest, the first of equals."""
    counts, cuts = None, []
    for n, phrases in enumerate(found, 1):
        counts = phrases if counts is None else counts.unionByName(phrases)
        words = F.split("phrase", " ")
        cut = lambda k, n=n, w=words: [F.struct(F.lit(k).alias("k"), F.lit(s).alias("side"), F.concat_ws(" ", F.slice(w, a, m)).alias("part")) for s, a, m in (("l", 1, k), ("r", k + 1, n - k))]
        if n > 1:
            both = F.explode(F.array(*[x for k in range(1, n) for x in cut(k)])).alias("cut")
            cuts.append(phrases.select("lang", "phrase", F.col("f").alias("a"), both).select("lang", "phrase", "a", "cut.*"))
    parts = cuts[0]
    for more in cuts[1:]:
        parts = parts.unionByName(more)
    parts = parts.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    one = parts.groupBy("lang", "phrase", "a", "k").agg(*[F.max(F.when(F.col("side") == s, F.col("f"))).alias(s) for s in "lr"])
    exact = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  products of counts under 10^15 fit 38 digits; beyond that it is an error
    one = one.withColumns({"_up": F.lit(1_000_000).cast("decimal(7,0)") * (exact("a") * exact("a")), "_down": exact("l") * exact("r")}).withColumn("score", F.expr("_up div _down"))
    least = one.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return least.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """Each language's first phrases by score: lang, rank, phrase, a, l, r, n, score.

    A phrase that a longer frequent one, found at least half as often, holds is left out.
    """
    totals, found = mined(docs, text, lang, least)
    got = scored(found)
    words = F.split("phrase", " ")
    within = None
    for n, longer in enumerate(found[2:], 3):
        spans = [F.concat_ws(" ", F.slice(words, k, m)) for m in range(2, n) for k in range(1, n - m + 2)]
        each = longer.select("lang", F.explode(F.array(*spans)).alias("phrase"), F.col("f").alias("whole"))
        within = each if within is None else within.unionByName(each)
    within = within.groupBy("lang", "phrase").agg(F.max("whole").alias("whole"))
    got = got.join(within, ["lang", "phrase"], "left").where("whole is null or 100 * whole < 50 * a")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    group = F.pmod(F.xxhash64("phrase"), F.lit(GROUPS))
    ranked = got.withColumn("_group", group).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_group").orderBy(*order))).where(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
