"""Chat formatting with offset-aligned loss masks.

The turns of a conversation are rendered with a template, the whole text is encoded once with offsets, and the sorted
spans of assistant texts are intersected with the token spans by binary search. Control strings inside texts are
escaped so that only the template's own marks delimit turns, and the escape can be undone.

Turns are ordered by turn, then role, then text, nulls first. Null texts and roles count as empty; repeated rows are
turns of their own; a row with a null conv_id is a conversation of its own. Other columns are not carried. An empty
table gives no conversations. A conversation is rows of one sorted partition; one at a time is held as it is put
together, and finished ones up to GATHER rows or GATHER_BYTES.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import default_path, tokenizer

#: Finished conversations of a batch, at most, and the bytes after which a batch is full.
GATHER, GATHER_BYTES = 1000, 16_000_000
START, END = "<|im_start|>", "<|im_end|>"
FORMATTED = "conv_id long, n_turns long, text string, ids binary, mask binary, spans binary, turns binary"
_marks = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
_escaped = re.compile(r"<\\(\\*)\|(im_start|im_end)\|>")


def escape(text: str) -> str:
    """One more backslash in everything that is a control string, however often escaped: unescape() takes it off."""
    return _marks.sub(r"<\\\1|\2|>", text)


def unescape(text: str) -> str:
    return _escaped.sub(r"<\1|\2|>", text)


def role_line(role: str) -> str:
    """The role on one line."""
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def read_role(line: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], line))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]], list[tuple[int, int, int, int]]]:
    """The text of a conversation, the spans of its assistant texts, and the spans of each turn's role and text."""
    out, at, loss, spans = [], 0, [], []
    for role, text in turns:
        head, body = f"{START}{role_line(role)}\n", escape(text)
        begin = at + len(head)
        spans.append((at + len(START), begin - 1, begin, begin + len(body)))
        if role == "assistant":
            loss.append((begin, begin + len(body)))
        out += [head, body, END, "\n"]
        at = begin + len(body) + len(END) + 1
    return "".join(out), loss, spans


def token_mask(offsets: list[tuple[int, int]], loss: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """1 for each token that overlaps a loss span, and the characters under the mask: those tokens within the spans.

    offsets are sorted; tokens of one character's bytes repeat its span.
    """
    starts, ends = [a for a, _ in offsets], [b for _, b in offsets]
    mask, covered = np.zeros(len(offsets), dtype=np.uint8), []
    for a, b in loss:
        if a == b:
            continue
        low, high = bisect_right(ends, a), bisect_left(starts, b)  # the first token that ends after a, the first that starts at b
        mask[low:high] = 1
        at = a
        for k in range(low, high):
            x, y = max(at, starts[k]), min(b, ends[k])
            if x < y:
                if covered and covered[-1][1] == x and x > a:
                    covered[-1] = (covered[-1][0], y)
                else:
                    covered.append((x, y))
                at = y
    return mask, covered


def format_conversations(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", path: str | None = None
) -> DataFrame:
    """One row per conversation: its text, ids, token mask, and int64 spans of loss characters and of turns."""
    path = path or default_path()
    chosen = rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))  # rows without an id don't meet in one task
    dealt = chosen.repartition("conv_id", alone).sortWithinPartitions("conv_id", "turn", "role", "text")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    names = FORMATTED.replace(",", "").split()[::2]

    def finished(key: int | None, turns: list[tuple[str, str]]) -> tuple:
        whole, loss, spans = render(turns)
        e = tokenizer(path, all_plain=True).encode(whole, add_special_tokens=False)
        mask, covered = token_mask(e.offsets, loss)
        return key, len(turns), whole, np.array(e.ids, "<u4").tobytes(), mask.tobytes(), np.array(covered, "<i8").tobytes(), np.array(spans, "<i8").tobytes()

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, turns, done, size = None, [], [], 0

        def gathered() -> pa.RecordBatch:
            columns = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=names)

        for b in batches:
            for k, who, said in zip(b["conv_id"].to_pylist(), b["role"].to_pylist(), b["text"].to_pylist(), strict=True):
                if turns and (k is None or k != key):
                    done.append(finished(key, turns))
                    size += 4 * len(done[-1][2])
                    turns = []
                    if len(done) >= GATHER or size > GATHER_BYTES:
                        yield gathered()
                        done, size = [], 0
                key = k
                turns.append((who or "", said or ""))
        if turns:
            done.append(finished(key, turns))
        if done:
            yield gathered()

    return dealt.mapInArrow(each, FORMATTED)


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from a formatted conversation alone."""
    turns = []
    for part in text.split(START)[1:]:
        head, _, body = part.removesuffix("\n").removesuffix(END).partition("\n")
        turns.append((read_role(head), unescape(body)))
    return turns


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, digests of the turns and of the text under the loss mask, both read back from what was formatted."""
    from hashlib import sha256

    out = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for row in b.to_pylist():
                turns = read_turns(row["text"])
                told = "".join(f"{r}\n{t}\n" for r, t in turns)
                spans = np.frombuffer(row["spans"], "<i8").reshape(-1, 2).tolist()
                loss = "".join(unescape(row["text"][x:y]) for x, y in spans)
                got.append({
                    "conv_id": row["conv_id"], "n_turns": len(turns), "turns_sha256": sha256(told.encode()).hexdigest(),
                    "loss_chars": len(loss), "loss_sha256": sha256(loss.encode()).hexdigest(), "formatted_chars": len(row["text"]),
                })
            if got:
                kinds = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (x.split() for x in out.split(", "))])
                yield pa.RecordBatch.from_pylist(got, schema=kinds)

    return formatted.mapInArrow(each, out)
