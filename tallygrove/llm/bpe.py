"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary finds the longest token that starts at each byte. The encoder takes it,
shortens it while the pair with the token before is not one that the merges could leave standing, and steps back where
nothing fits. Whether two tokens may stand side by side is kept in a pair-compatibility table, so the result equals
merging by rank while the work stays linear in the text.

Nulls count as empty texts, which have no ids. Repeated rows are encoded each; other columns are carried along; a
column named like an output is replaced. An empty table gives an empty table.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .rows import map_batches
from .tokens import PieceEncoder, default_path, vocabulary

#: Pairs kept in the pair-compatibility table before it is emptied.
PAIRS = 2_000_000


class BacktrackingEncoder:
    """Exact merges for one pre-token. Tokens are numbered by merge order: single bytes first, then each merge."""

    def __init__(self, path: str):
        import ahocorasick

        table, merges, _ = vocabulary(path)
        to_id = {x: k for k, x in reversed(list(enumerate(table))) if x}
        number = {bytes([b]): b for b in range(256)}
        self.split = [(b, b) for b in range(256)]
        for left, right in merges:
            if left + right not in number:
                number[left + right] = len(self.split)
                self.split.append((number[left], number[right]))
        names = list(number)
        self.ids = [to_id.get(x, -1) for x in names]
        self.length = [len(x) for x in names]
        self.merged = {pair: k for k, pair in enumerate(self.split) if k >= 256}
        self.shorter = [next((number[x[:n]] for n in range(len(x) - 1, 0, -1) if x[:n] in number), -1) for x in names]
        self.matches = ahocorasick.Automaton()
        for x, k in number.items():
            self.matches.add_word(x.decode("latin-1"), k)
        self.matches.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank can end with a beside b: no merge across the border comes before theirs are made."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        limit = len(self.split) + 1
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            if a > b:  # undo the later of the two merges, on its side of the border
                limit, a = a, self.split[a][1]
                if a == limit:
                    limit, b = b + 1, self.split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.split[b][0]
                if b + 1 == limit:
                    limit, a = a, self.split[a][1]
                    if a == limit:
                        return True

    def encode(self, raw: bytes) -> list[int]:
        n, length = len(raw), self.length
        longest = [-1] * n
        for end, k in self.matches.iter(raw.decode("latin-1")):
            start = end + 1 - length[k]
            if longest[start] < 0 or length[k] > length[longest[start]]:
                longest[start] = k
        out: list[int] = []
        dead = bytearray(n + 1)  # positions from which no way on was found
        at, token = 0, longest[0] if n else -1
        while token >= 0:
            before = out[-1] if out else -1
            while token >= 0:
                end = at + length[token]
                if not dead[end] and (before < 0 or self.compatible(before, token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                out.pop()
                at -= length[before]
                token = before
                # the same token is tried again: its end is dead now, so a shorter one follows
        return [self.ids[k] for k in out]


class Codec:
    """Encoder and decoder of whole texts for one tokenizer file."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        table, _, self.added = vocabulary(path)
        self.words = BacktrackingEncoder(path)
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")").split if self.added else lambda x: [x]
        self.store = PieceEncoder(self._encode)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in table])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(table), dtype=np.uint8)

    def _encode(self, x: str) -> tuple[bytes, str]:
        ids: list[int] = []
        for part in self.cut(x):
            if part in self.added:
                ids.append(self.added[part])
            else:
                for y in self.find(part):
                    ids += self.words.encode(y.encode())
        return array("I", ids).tobytes(), ",".join(map(str, ids))

    def encode(self, texts: list[str | None]) -> list[list[tuple[bytes, str]]]:
        """For each text, (ids as bytes, ids in decimal) of its pieces in order."""
        return [self.store.look_up(x) for x in texts]

    def decode(self, ids: np.ndarray) -> str:
        start = self.offsets[ids]
        size = self.offsets[ids.astype(np.int64) + 1] - start
        into = np.cumsum(size)
        index = np.repeat(start - (into - size), size) + np.arange(into[-1] if len(into) else 0)
        return self.blob[index].tobytes().decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """df with `out`, the ids of each whole text as little-endian unsigned 32-bit bytes."""
    path = path or default_path()

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {out: [b"".join(y[0] for y in x) for x in codec(path).encode(batch[text].to_pylist())]}

    return map_batches(df, run, {out: "binary"})


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """df with `out`, the text of each row's ids; null ids count as none."""
    path = path or default_path()

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {out: [codec(path).decode(np.frombuffer(x or b"", dtype="<u4")) for x in batch[ids].to_pylist()]}

    return map_batches(df, run, {out: "string"})


def round_trip_digests(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """df's other columns with n_tokens, ids_sha256 and decoded_sha256 of encoding and decoding each whole text."""
    from hashlib import sha256

    path = path or default_path()

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        c = codec(path)
        got: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for x in c.encode(batch[text].to_pylist()):
            raw = b"".join([y[0] for y in x])
            got["n_tokens"].append(len(raw) // 4)
            got["ids_sha256"].append(sha256(",".join([y[1] for y in x if y[1]]).encode()).hexdigest())
            got["decoded_sha256"].append(sha256(c.decode(np.frombuffer(raw, dtype="<u4")).encode()).hexdigest())
        yield got

    return map_batches(df, run, {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}, drop=(text,))
