"""Token ids in Re-Pair compressed shards, written in id order and read back document by document.

Documents are dealt by ranges of their id and sorted, so files hold them in ascending order. Within a file, documents
are gathered into shards of a bounded number of ids. A shard repeatedly replaces frequent neighbouring id pairs by new
symbols (never across documents) until no pair is frequent enough: all frequent pairs in one pass, where the plainest
Re-Pair takes one pair at a time, and of overlapping ones the most frequent first. It stores the rules, the number of
ids each symbol expands to, the remaining symbols and where each document begins in them, so read_document() decodes
one document from its own symbols.

Nulls count as empty texts: such a document holds its end id alone. Rows with equal ids keep each their own place, in
the order of their texts; a null id comes first. Other columns are not stored. An empty table gives no shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import default_path, library_encoder

#: Ids of a shard, at most (one longer document makes a shard of its own).
SHARD_IDS = 1 << 20
#: A pair is replaced if it is found so often in the shard and can be put in place so often beside the others.
LEAST_COUNT, LEAST_USES = 24, 8
#: Rounds in which overlapping places are settled by frequency, before long runs are.
ROUNDS = 8
SHARD = "part int, shard int, first_id long, last_id long, ids_before long, n_ids long, doc_ids binary, doc_null binary, doc_symbols binary, doc_lengths binary, width int, base long, rules binary, lengths binary, symbols binary"


def find(keys: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The index in `chosen` (sorted, distinct) of each key, -1 for others: by a table of hashes, by search where two share a slot."""
    bits = max(10, int(len(chosen)).bit_length() + 4)
    slot = lambda k: (k * k.dtype.type(0x9E3779B1)) >> k.dtype.type(8 * k.dtype.itemsize - bits)
    table = np.full(1 << bits, -1, dtype=np.int32)
    at = slot(chosen)
    table[at] = np.arange(len(chosen), dtype=np.int32)
    crowded = np.bincount(at.astype(np.int64), minlength=1 << bits) > 1
    where = slot(keys)
    out = table[where]
    out[chosen[out] != keys] = -1
    if crowded.any():
        more = np.flatnonzero(crowded[where] & (out < 0))
        rank = np.minimum(np.searchsorted(chosen, keys[more]), len(chosen) - 1)
        out[more] = np.where(chosen[rank] == keys[more], rank, -1)
    return out


def settle(place: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which of the places (in order) are replaced: of two that overlap, the one of the more frequent pair, else the left one."""
    taken, alive = np.zeros(len(place), dtype=bool), np.arange(len(place))
    for _ in range(ROUNDS):
        if not len(alive):
            break
        p, c = place[alive], count[alive]
        touch = p[1:] - p[:-1] == 1
        win = np.ones(len(alive), dtype=bool)
        win[1:] &= ~touch | (c[1:] > c[:-1])
        win[:-1] &= ~touch | (c[:-1] >= c[1:])
        taken[alive[win]] = True
        near = win.copy()
        near[1:] |= touch & win[:-1]
        near[:-1] |= touch & win[1:]
        alive = alive[~near]
    if len(alive):  # long runs: every second place, from the left
        p = place[alive]
        run = np.concatenate([[True], p[1:] - p[:-1] > 1])
        first = np.maximum.accumulate(np.where(run, np.arange(len(p)), 0))
        taken[alive[(np.arange(len(p)) - first) % 2 == 0]] = True
    return taken


def compress(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(symbols, where each document begins, rules as rows of two, first new symbol) for ids with documents at starts.

    Each pass replaces all pairs that are frequent enough, the more frequent of overlapping ones first. After it only pairs with a
    symbol of that pass can have become frequent, so only those are counted; a last count of all pairs finds none left.
    """
    base = top = int(ids.max()) + 1 if len(ids) else 1
    seq, at, rules = ids.astype(np.uint16 if base <= 1 << 16 else np.uint32), starts.astype(np.int64), []
    newest = 0  # the first symbol of the last pass; 0: count all pairs
    while len(seq) > 1:
        shift, wide = (16, np.uint32) if seq.itemsize == 2 else (32, np.uint64)
        if newest:
            late = seq >= newest
            inner = late[:-1] | late[1:]
        else:
            inner = np.ones(len(seq) - 1, dtype=bool)
        border = at[at > 0] - 1
        inner[border[border < len(inner)]] = False
        place = np.flatnonzero(inner)
        keys = (seq[place].astype(wide) << wide(shift)) | seq[place + 1]
        ordered = np.sort(keys)
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])) if len(ordered) else np.zeros(1, int)
        counts = np.diff(edge)
        often = counts >= LEAST_COUNT
        chosen, counts = ordered[edge[:-1][often]], counts[often]
        if not len(chosen):
            if not newest:
                break
            newest = 0
            continue
        # the places of frequent pairs in order, and which pair each holds
        group = find(keys, chosen)
        hit = np.flatnonzero(group >= 0)
        place, group = place[hit], group[hit]
        taken = settle(place, counts[group])
        taken = np.flatnonzero(taken)
        place, group = place[taken], group[taken]
        uses = np.bincount(group, minlength=len(chosen))
        kept = uses >= min(LEAST_USES, uses.max())
        number = np.where(kept, np.cumsum(kept) - 1, -1)[group]
        if not kept.all():
            place, number = place[number >= 0], number[number >= 0]
        new = chosen[kept]
        rules.append(np.stack([new >> wide(shift), new & wide((1 << shift) - 1)], axis=1).astype(np.uint32))
        if top + len(new) > 1 << 16:
            seq = seq.astype(np.uint32)
        seq[place] = (top + number).astype(seq.dtype)
        keep = np.ones(len(seq), dtype=bool)
        keep[place + 1] = False
        seq = seq[keep]
        at = at - np.searchsorted(place + 1, at)
        newest, top = top, top + len(new)
    return seq, at, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), base


def layers(rules: np.ndarray, base: int) -> Iterator[slice]:
    """Runs of rules that only use ids and symbols of the runs before."""
    latest, start = rules.max(axis=1, initial=0).astype(np.int64), 0
    while start < len(rules):
        late = latest[start:] >= base + start
        end = start + (int(late.argmax()) if late.any() else len(late))
        yield slice(start, end)
        start = end


def expansions(rules: np.ndarray, base: int) -> np.ndarray:
    """The number of ids that each rule's symbol stands for."""
    lengths = np.ones(base + len(rules), dtype=np.int64)
    for run in layers(rules, base):
        lengths[base + run.start : base + run.stop] = lengths[rules[run]].sum(axis=1)
    return lengths[base:]


class Shard:
    """A shard as read from a file: decodes any of its documents, or all of them."""

    def __init__(self, row: dict):
        self.base, kind = row["base"], np.uint32 if row["width"] == 4 else np.uint16
        self.symbols = np.frombuffer(row["symbols"], dtype=kind)
        self.rules = np.frombuffer(row["rules"], dtype=np.uint32).reshape(-1, 2)
        self.lengths = np.frombuffer(row["lengths"], dtype=np.uint32).astype(np.int64)
        self.doc_ids = np.frombuffer(row["doc_ids"], dtype=np.int64)
        self.doc_null = np.frombuffer(row["doc_null"], dtype=bool)
        self.doc_symbols = np.frombuffer(row["doc_symbols"], dtype=np.int64)
        self.doc_lengths = np.frombuffer(row["doc_lengths"], dtype=np.int64)
        begin = np.cumsum(self.lengths) - self.lengths
        self.size = np.concatenate([np.ones(self.base, np.int64), self.lengths])
        self.begin = np.concatenate([np.arange(self.base), self.base + begin])
        flat = np.empty(self.base + int(self.lengths.sum()), dtype=np.uint32)
        flat[: self.base] = np.arange(self.base)
        self.flat = flat
        for run in layers(self.rules, self.base):
            made = self.expand(self.rules[run].ravel())
            at = self.begin[self.base + run.start]
            flat[at : at + len(made)] = made

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        size = self.size[symbols]
        into = np.cumsum(size)
        return self.flat[np.repeat(self.begin[symbols] - (into - size), size) + np.arange(into[-1] if len(into) else 0)]

    def document(self, k: int) -> np.ndarray:
        """The ids of the shard's k-th document, from its own symbols alone."""
        end = self.doc_symbols[k + 1] if k + 1 < len(self.doc_symbols) else len(self.symbols)
        return self.expand(self.symbols[self.doc_symbols[k] : end])


def write(
    docs: DataFrame, to: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", path: str | None = None, parts: int | None = None
) -> None:
    """Encode every whole text, append end_id, and write compressed shards to the folder `to`."""
    path = path or default_path()
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the texts' first letters split an id, or the null ids, that very many rows share
    dealt = chosen.repartitionByRange(parts, "doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, bytes]] = []
        size = 0
        end = np.array([end_id], dtype="<u4").tobytes()

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(x) // 4 for _, x in held], dtype=np.int64)
            starts = np.cumsum(lengths) - lengths
            seq, at, rules, base = compress(np.frombuffer(b"".join(x for _, x in held), dtype="<u4"), starts)
            row = {
                "part": part, "shard": shard, "first_id": next((k for k, _ in held if k is not None), None), "last_id": held[-1][0], "ids_before": before, "n_ids": int(lengths.sum()),
                "doc_ids": np.array([k or 0 for k, _ in held], dtype=np.int64).tobytes(), "doc_null": np.array([k is None for k, _ in held]).tobytes(),
                "doc_symbols": at.tobytes(), "doc_lengths": lengths.tobytes(), "width": seq.itemsize, "base": base,
                "rules": rules.tobytes(), "lengths": expansions(rules, base).astype(np.uint32).tobytes(), "symbols": seq.tobytes(),
            }
            return pa.RecordBatch.from_pylist([row], schema=kinds)

        encoder = library_encoder(path)
        for b in batches:
            for k in range(0, b.num_rows, 500):
                some = b.slice(k, 500)
                for key, raw in zip(some["doc_id"].to_pylist(), encoder.encode(some["text"].to_pylist()), strict=True):
                    if held and size + len(raw) // 4 + 1 > SHARD_IDS:
                        yield flush()
                        shard, before, held, size = shard + 1, before + size, [], 0
                    held.append((key, raw + end))
                    size += len(raw) // 4 + 1
        if held:
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(docs.sparkSession.createDataFrame([], SHARD).schema)
    dealt.mapInArrow(each, SHARD).write.parquet(to)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Every document of the files in a folder: doc_id, start, n_tokens, and its ids (or only their crc32).

    start counts the ids of all documents before it: its place in its file plus what the files before it hold. The
    sum over files is a window over one row for each file.
    """
    shards = spark.read.schema(SHARD).parquet(path)
    files = shards.groupBy("part").agg(F.sum("n_ids").alias("file_ids"))
    before = files.select("part", (F.sum("file_ids").over(Window.orderBy("part")) - F.col("file_ids")).alias("file_before"))
    last = ("ids", "binary") if with_ids else ("ids_crc32", "bigint")

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                s = Shard(row)
                ids = s.expand(s.symbols).astype("<u4")
                begin = np.cumsum(s.doc_lengths) - s.doc_lengths
                raw = memoryview(ids.tobytes())
                parts = [raw[4 * x : 4 * (x + n)] for x, n in zip(begin.tolist(), s.doc_lengths.tolist(), strict=True)]
                made = [bytes(x) for x in parts] if with_ids else [zlib.crc32(x) for x in parts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * len(parts), pa.int32()), pa.array(s.doc_ids, mask=s.doc_null), pa.array(begin + row["ids_before"]),
                        pa.array(s.doc_lengths), pa.array(made, pa.binary() if with_ids else pa.int64()),
                    ],
                    names=["part", "doc_id", "at", "n_tokens", last[0]],
                )

    found = shards.mapInArrow(each, f"part int, doc_id long, at long, n_tokens long, {last[0]} {last[1]}")
    return found.join(F.broadcast(before), "part").select("doc_id", (F.col("at") + F.col("file_before")).alias("start"), "n_tokens", last[0])


def read_document(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """(doc_id, ids) of the rows with that id: only the shards whose ids reach from below to above it are read, and only its symbols expanded."""
    shards = spark.read.schema(SHARD).parquet(path).where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                s = Shard(row)
                found = [s.document(k).astype("<u4").tobytes() for k in np.flatnonzero((s.doc_ids == doc_id) & ~s.doc_null).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(found), pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "ids"])

    return shards.mapInArrow(each, "doc_id long, ids binary")
