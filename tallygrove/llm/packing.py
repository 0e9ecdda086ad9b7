"""Bounded-space online packing of token ids into sequences of a fixed length.

Each partition keeps a fixed number of open windows. A document's ids are cut at full windows; what is left goes to
the open window it fits best. Where it fits none, the fullest window is emitted and a new one opened. At the end the
left-over windows are merged: their pieces, cut where they must be, fill windows one after another, and what is left
is emitted in runs whose lengths are powers of two, which need no padding.

Nulls count as empty texts: such a document holds its end id alone. Rows with equal ids are packed each; other columns
are not carried. An empty table gives no pieces.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import default_path, library_encoder

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
OPEN_WINDOWS = 64


class Packer:
    """Packs (key, start, ids, total) pieces of 4-byte ids; add() and finish() give lists of finished windows."""

    def __init__(self, size: int, windows: int):
        self.size, self.windows = size, windows
        self.open: dict[int, list] = {}
        self.room: list[tuple[int, int]] = []  # (free ids, window) in order
        self.next = 0

    def add(self, key, raw: bytes) -> list[list]:
        total, done = len(raw) // 4, []
        whole = total - total % self.size
        for x in range(0, whole, self.size):
            done.append([(key, x, raw[4 * x : 4 * (x + self.size)], total)])
        if n := total - whole:
            at = bisect_left(self.room, (n, -1))
            if at < len(self.room):
                free, w = self.room.pop(at)
            else:
                if len(self.room) >= self.windows:
                    done.append(self.open.pop(self.room.pop(0)[1]))
                w, free = self.next, self.size
                self.next += 1
                self.open[w] = []
            self.open[w].append((key, whole, raw[4 * whole :], total))
            if free == n:
                done.append(self.open.pop(w))
            else:
                insort(self.room, (free - n, w))
        return done

    def finish(self) -> list[list]:
        """What is still open, merged: full windows, then runs of powers of two."""
        left = [x for _, w in self.room for x in self.open[w]]
        count = sum(len(x[2]) // 4 for x in left)
        sizes = [self.size] * (count // self.size) + [1 << k for k in range(self.size.bit_length() - 1, -1, -1) if (count % self.size) >> k & 1]
        done, now, k = [], [], 0
        for key, start, raw, total in left:
            while raw:
                n = min(len(raw) // 4, sizes[k] - sum(len(x[2]) // 4 for x in now))
                now.append((key, start, raw[: 4 * n], total))
                start, raw = start + n, raw[4 * n :]
                if sum(len(x[2]) // 4 for x in now) == sizes[k]:
                    done.append(now)
                    now, k = [], k + 1
        self.open, self.room = {}, []
        return done


def pack(
    docs: DataFrame, size: int = 1024, end_id: int = 0, windows: int = OPEN_WINDOWS, doc_id: str = "doc_id", text: str = "text", path: str | None = None
) -> DataFrame:
    """One row per piece: its document, place there, ids, and the sequence and offset it lies at.

    sequence_id numbers the sequences of a partition from its index times 2**40.
    """
    path = path or default_path()
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence, packer, encoder = TaskContext.get().partitionId() << 40, Packer(size, windows), library_encoder(path)

        def rows(done: list[list]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            got: list[list] = [[] for _ in range(7)]
            for window in done:
                offset = 0
                for key, start, raw, total in window:
                    n = len(raw) // 4
                    for column, x in zip(got, (key, start, n, raw, total, sequence, offset), strict=True):
                        column.append(x)
                    offset += n
                sequence += 1
            if got[0]:
                long, kinds = pa.int64(), PIECES.replace(",", "").split()
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if k == "binary" else long) for x, k in zip(got, kinds[1::2], strict=True)], names=kinds[::2])

        end = int(end_id).to_bytes(4, "little")
        for b in batches:
            for k in range(0, b.num_rows, 500):
                some, done = b.slice(k, 500), []
                for key, raw in zip(some["doc_id"].to_pylist(), encoder.encode(some["text"].to_pylist()), strict=True):
                    done += packer.add(key, raw + end)
                yield from rows(done)
        yield from rows(packer.finish())

    return chosen.mapInArrow(each, PIECES)
