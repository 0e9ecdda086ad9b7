"""Removal of long repeated word sequences by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of BLOCK words, as from its first word. A window of `length`
words holds a whole block of its own document wherever it stands, so if a window is found twice, one of its copies holds
a reference block and the other the same words at some place. The blocks are indexed by hash and probed with the rolling
windows of BLOCK words at every place of every document. What is found is a hit if its words stand at two places at least.
Hits are extended: every window of `length` words over a hit is compared with all others of that kind, whoever holds
them, by 96 bits of hashes within a bucket of more; those found elsewhere too make up the maximal repeats. Whether a place is a hit depends on its words
alone, so equal windows are extended alike and none is missed. The hit index may report a few places too many (it compares
parts of hashes); they cost an extension and no more.

Documents are dealt into batches of bounded bytes. A batch sends each different hash once to the bucket that it belongs
to, packed into one row a bucket, and gets back a bit for each: what many documents share counts once a batch, no pair of
places is ever formed, and neither batches nor buckets grow with a hot passage or a group of copies but by one entry a
batch. Rows between them are as many as batches times buckets, by size alone, and never more than hashes. The batches are a table written once in buckets of their number, so the two answers join it without moving texts.

A word is what stands between blanks (space, tab to carriage return). A null text has no words. Every row counts as a document of
its own, whatever its id or text: rows that repeat are removed where they are long enough. Rows with a null id are
treated alike. A document longer than a batch is one of its own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import written
from .rows import bucketed

LENGTH = 35
#: Text bytes of a batch and of a bucket of hashes, about.
BATCH_BYTES, BUCKET_BYTES = 4_000_000, 12_000_000
#: What a batch sends to a bucket (hashes, in two columns, and a bit for each: known twice in the batch, and of a block), and the answer.
SENT = "bucket long, batch long, low binary, high binary, twice binary, block binary"
ANSWER = "batch long, bucket long, shared binary"


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """A number for the n words from each place on, put together from runs of 1, 2, 4, ... words."""
    run, size, made, done = h, 1, None, 0
    while True:
        if n & size:
            made = run if made is None else mixed(made[: max(0, len(run) - done)] * np.uint64(0xC2B2AE3D27D4EB4F) + run[done:])
            done += size
        if done == n:
            return made
        run = mixed(run[:-size] * np.uint64(0x100000001B3) + run[size:]) if len(run) > size else run[:0]
        size *= 2


class Words:
    """The words of a batch of texts, hashed, and which places can begin a window."""

    def __init__(self, texts: pa.ChunkedArray, length: int):
        self.length, self.block = length, (length + 1) // 2
        self.lists = [(t or b"").split() for t in texts.cast(pa.binary()).to_pylist()]
        self.counts = np.array([len(x) for x in self.lists], dtype=np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        found = pa.array(chain.from_iterable(self.lists), pa.binary()).dictionary_encode()
        raw = b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in found.dictionary.to_pylist())
        told = np.frombuffer(raw, "<u8").reshape(-1, 2)[found.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
        self.first, self.second = np.ascontiguousarray(told[:, 0]), np.ascontiguousarray(told[:, 1])
        n = len(self.first)
        self.place = np.arange(n) - np.repeat(self.starts, self.counts)
        self.left = np.repeat(self.counts, self.counts) - self.place
        self.long = np.repeat(self.counts >= length, self.counts)

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places of the rolling windows of a block's size, their hashes, and which are reference blocks."""
        at = np.flatnonzero(self.long & (self.left >= self.block))
        return at, rolling(self.first, self.block)[at] if len(at) else at.astype(np.uint64), self.place[at] % self.block == 0

    def extended(self, hits: np.ndarray) -> np.ndarray:
        """The places of the windows that hold a hit; hits: places."""
        upto = np.zeros(len(self.first) + 1, dtype=np.int64)
        upto[hits + 1] = 1
        upto = np.cumsum(upto)
        at = np.flatnonzero(self.left >= self.length)
        return at[upto[at + self.length - self.block + 1] > upto[at]]

    def hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        none = at.astype(np.uint64)
        return (rolling(self.first, self.length)[at], rolling(self.second, self.length)[at]) if len(at) else (none, none)

    def covered(self, windows: np.ndarray) -> np.ndarray:
        """Whether each word lies in one of the windows, given by place."""
        step = np.zeros(len(self.first) + 1, dtype=np.int64)
        step[windows] += 1
        step[windows + self.length] -= 1
        return np.cumsum(step)[:-1] > 0


def packed(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).view(bool)


class Sent:
    """Hashes of a batch in the order of their buckets: each different one once."""

    def __init__(self, buckets: int, first: np.ndarray, second: np.ndarray | None = None):
        key = ((first >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (first & np.uint64(0xFFFFFFFF))
        self.order = np.argsort(key, kind="stable") if second is None else np.lexsort((second, key))
        key = key[self.order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        if second is not None:
            second = second[self.order]
            new[1:] |= second[1:] != second[:-1]
        self.begin = np.flatnonzero(new)
        self.run = np.cumsum(new) - 1
        self.low, self.high = key[self.begin], None if second is None else second[self.begin]
        self.edge = np.searchsorted(self.low >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))

    def rows(self, batch: int, block: np.ndarray) -> pa.Table:
        """One row a bucket; block: a flag for each hash, in the order given."""
        twice = np.diff(self.begin, append=len(self.run)) > 1
        marked = np.logical_or.reduceat(block[self.order], self.begin) if len(self.begin) else twice
        low = self.low.astype("<u4")
        full = np.flatnonzero(np.diff(self.edge)).tolist()
        cut = [(self.edge[k], self.edge[k + 1]) for k in full]
        columns = [
            pa.array(full, pa.int64()), pa.array([batch] * len(full), pa.int64()),
            pa.array([low[a:b].tobytes() for a, b in cut], pa.binary()),
            pa.array([b"" if self.high is None else self.high[a:b].tobytes() for a, b in cut], pa.binary()),
            pa.array([packed(twice[a:b]) for a, b in cut], pa.binary()), pa.array([packed(marked[a:b]) for a, b in cut], pa.binary()),
        ]
        return pa.table(columns, names=["bucket", "batch", "low", "high", "twice", "block"])

    def shared(self, answer: pa.Table) -> np.ndarray:
        """A flag for each hash, in the order given."""
        told = np.zeros(len(self.begin), dtype=bool)
        for k, raw in zip(answer["bucket"].to_pylist(), answer["shared"].to_pylist(), strict=True):
            a, b = self.edge[k], self.edge[k + 1]
            told[a:b] = bits(raw, b - a)
        out = np.zeros(len(self.run), dtype=bool)
        out[self.order] = told[self.run]
        return out


def answered(sent: DataFrame) -> DataFrame:
    """For every batch and bucket, which hashes stand at two places at least, one of them a block."""

    def each(rows: pa.Table) -> pa.Table:
        low = [np.frombuffer(x, "<u4") for x in rows["low"].to_pylist()]
        n = np.array([len(x) for x in low])
        flags = [np.concatenate([bits(x, m) for x, m in zip(rows[c].to_pylist(), n.tolist(), strict=True)]) for c in ("twice", "block")]
        low, high = np.concatenate(low), np.frombuffer(b"".join(rows["high"].to_pylist()), "<u8")
        order = np.lexsort((high, low)) if len(high) else np.argsort(low, kind="stable")
        new = np.ones(len(low), dtype=bool)
        new[1:] = np.diff(low[order]) != 0
        if len(high):
            new[1:] |= np.diff(high[order]) != 0
        begin, run = np.flatnonzero(new), np.cumsum(new) - 1
        often = np.add.reduceat(1 + flags[0][order].astype(np.int64), begin) > 1
        hit = np.zeros(len(low), dtype=bool)
        hit[order] = (often & np.logical_or.reduceat(flags[1][order], begin))[run]
        edge = np.concatenate([[0], np.cumsum(n)]).tolist()
        parts = [hit[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
        some = [k for k, x in enumerate(parts) if x.any()]
        made = rows.select(["batch", "bucket"]).take(pa.array(some, pa.int64()))
        return made.append_column("shared", pa.array([packed(parts[k]) for k in some], pa.binary()))

    return sent.groupBy("bucket").applyInArrow(each, ANSWER)


def without_repeats(
    docs: DataFrame, text: str, length: int, new: str, tell: Callable[[list[bytes], np.ndarray], tuple], carry: list[str] | None = None
) -> DataFrame:
    """(_doc, *new) of each row: _doc has the columns `carry` (all, if not given), new is what tell() makes of its words and of the flags of those that repeat."""
    spark = docs.sparkSession
    column = lambda c: F.col(f"`{c}`")
    rows = docs.select(column(text).cast("string").alias("text"), F.struct(*map(column, carry or docs.columns)).alias("_doc"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # by size, and smaller ones where that keeps more tasks busy
    batches, buckets = (max(1, size // most, min(parts, 4 * size // most)) for most in (BATCH_BYTES, BUCKET_BYTES))
    # a row's number has no meaning but to spread rows, and is settled once the table is written
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(batches)))
    table = bucketed(dealt, "batch", "batches")
    texts = table.select("batch", "text").groupBy("batch")
    out = T.StructType([rows.schema["_doc"], *T._parse_datatype_string(new).fields])
    kinds = [to_arrow_type(f.dataType) for f in out.fields[1:]]

    def probe(b: pa.Table) -> pa.Table:
        _, h, block = Words(b["text"], length).probes()
        return Sent(buckets, h).rows(b["batch"][0].as_py(), block)

    def found(w: Words, hits: pa.Table) -> np.ndarray:
        if not hits.num_rows:
            return np.zeros(0, dtype=np.int64)
        at, h, _ = w.probes()
        return w.extended(at[Sent(buckets, h).shared(hits)])

    def extend(b: pa.Table, hits: pa.Table) -> pa.Table:
        w = Words(b["text"], length)
        at = found(w, hits)
        return Sent(buckets, *w.hashes(at)).rows(b["batch"][0].as_py(), np.ones(len(at), dtype=bool))

    def finish(b: pa.Table, answers: pa.Table) -> pa.Table:
        w = Words(b["text"], length)
        at = found(w, answers.filter(pc.equal(answers["step"], 1)))
        told = answers.filter(pc.equal(answers["step"], 2))
        repeats = w.covered(at[Sent(buckets, *w.hashes(at)).shared(told)] if told.num_rows else at[:0])
        made = [tell(x, repeats[a : a + len(x)]) for x, a in zip(w.lists, w.starts.tolist(), strict=True)]
        columns = [pa.array(v, k) for v, k in zip(zip(*made, strict=True), kinds, strict=True)]
        return pa.table([b["_doc"], *columns], names=out.names)

    hits = written(answered(texts.applyInArrow(probe, SENT)), "hits")
    windows = answered(texts.cogroup(hits.groupBy("batch")).applyInArrow(extend, SENT))
    answers = hits.withColumn("step", F.lit(1)).unionByName(windows.withColumn("step", F.lit(2)))
    return table.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(finish, out)


def kept(words: list[bytes], repeats: np.ndarray) -> bytes:
    """The words that don't repeat, joined by one space."""
    return b" ".join(compress(words, (~repeats).tolist()))


def counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and the digest of what remains."""

    def tell(words: list[bytes], repeats: np.ndarray) -> tuple:
        return len(words), int(repeats.sum()), hashlib.sha256(kept(words, repeats)).hexdigest()

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    slim = without_repeats(rows, "text", length, "n_words long, n_removed long, kept_sha256 string", tell, carry=["doc_id"])
    return slim.select("_doc.doc_id", "n_words", "n_removed", "kept_sha256")


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, begin, end, words) of each maximal run of words that repeat elsewhere, by word places; end is the first word after it."""

    def tell(words: list[bytes], flags: np.ndarray) -> tuple:
        edge = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0)).tolist()
        return ([{"begin": a, "end": b, "words": b" ".join(words[a:b]).decode(errors="replace")} for a, b in zip(edge[::2], edge[1::2], strict=True)],)

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    got = without_repeats(rows, "text", length, "runs array<struct<begin: long, end: long, words: string>>", tell, carry=["doc_id"])
    return got.select("_doc.doc_id", F.explode("runs").alias("run")).select("doc_id", "run.*")


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """docs, with the remaining words of each text that loses some, joined by one space; other texts stay as they are."""

    def tell(words: list[bytes], flags: np.ndarray) -> tuple:
        return (kept(words, flags).decode(errors="replace") if flags.any() else None,)

    got = without_repeats(docs, text, length, "_kept string", tell)
    left = F.coalesce("_kept", F.col("_doc")[text].cast("string")).cast(docs.schema[text].dataType).alias(text)
    return got.select(*[left if c == text else F.col("_doc")[c].alias(c) for c in docs.columns])
