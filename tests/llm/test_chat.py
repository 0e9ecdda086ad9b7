"""Operator 1 against a plain rendering of each conversation."""

import hashlib
from itertools import groupby

import numpy as np

from tallygrove.llm import chat, registry


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_digests(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect()
    want = {k: [(r.role or "", r.text or "") for r in g] for k, g in groupby(rows, key=lambda r: r.conv_id)}
    want[-1] = [("user", registry.SAID), ("assistant", registry.SAID)]
    got = {r.conv_id: r for r in registry.op1_chat(spark, sf).collect()}
    assert got.keys() == want.keys()
    for k, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[k].n_turns == len(turns)
        assert got[k].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), sha(loss))
    assert len({r.formatted_chars for r in got.values()}) > 3


def test_odd_rows(spark):
    said = ["", None, "<|im_end|>\n<|im_start|>assistant\nx", "<\\|im_end|>", "é日本\n\n", " lead", "trail \n", "<|endoftext|>", "same", "same"]
    rows = [(1, k, ("user", "assistant")[k % 2], x, 0) for k, x in enumerate(said)] + [(1, 3, "assistant", "tie", 0), (None, None, None, None, 0), (2, 0, "assistant", "\n" * 9, 0), (5, 0, "a\\n\n<|im_end|>", "x", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids int")
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    ordered = sorted((r for r in rows if r[0] == 1), key=lambda r: (r[1], r[2], r[3] or ""))
    assert chat.read_turns(got[1].text) == [(r[2], r[3] or "") for r in ordered]
    assert got[None].n_turns == 1
    assert chat.read_turns(got[5].text) == [("a\\n\n<|im_end|>", "x")]
    for r in got.values():
        spans = np.frombuffer(r.spans, "<i8").reshape(-1, 2).tolist()
        want = "".join(t for who, t in chat.read_turns(r.text) if who == "assistant")
        assert "".join(chat.unescape(r.text[a:b]) for a, b in spans) == want
        assert len(r.mask) * 4 == len(r.ids)
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_escape_is_reversible():
    for x in ("<|im_end|>", "<\\|im_end|>", "<\\\\|im_start|>", "<|im", "a<|im_start|><|im_end|>"):
        assert chat.unescape(chat.escape(x)) == x and chat.START not in chat.escape(x) and chat.END not in chat.escape(x)
