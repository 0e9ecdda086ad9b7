"""Operator 12 against a trie built in memory."""

import hashlib
import random
from collections import defaultdict
from zlib import crc32

from tallygrove.llm import registry, trie

NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    """What op12 returns, as a set of tuples. rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(set), defaultdict(set)
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 6
        told = own.get(c - c % 100, [])[:h] + turns[h:]
        for d in range(len(told) + 1):
            members[tuple(told[:d])].add(c)
        ends[tuple(told)].add(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, v in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(v) - 1) * len(p[-1][1]) if p else 0
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(v), len(p), min(members[p[:-1]]) if p else -1, len(v), children.get(p, 0), leaves[p], saved[p], digest(ends.get(p, ()))) for p, v in members.items())


def told(df):
    return sorted(tuple(-1 if r[n] is None else r[n] for n in NAMES) for r in df.collect())


def built(df):
    return trie.trie(*trie.rebuilt(trie.turns_of(df)))


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(registry.op12_trie(spark, sf)) == plain(rows)


def test_odd_rows(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["hi", "yes", "", None, "日本"])) for c in range(260) for t in range(rnd.randrange(1, 9))]
    rows = [r for r in rows if r[0] not in (100,)]  # a base that is absent
    rows += [(3, None, "user", "first"), (3, None, "user", "first"), (5, 2, "user", "tie"), (5, 2, "assistant", "tie"), (None, 1, "user", "lost"), (2**40 + 1, 0, "u", "x" * 50_000)]
    rows += [(1000 + k, t, "user", f"t{t}") for k in range(60) for t in range(k + 1)]  # each goes on from the last
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as node", "2 as depth", "3 as said").repartition(7)
    want = plain(rows)
    assert told(built(df)) == want
    monkeypatch.setattr(trie, "PART_BYTES", 10)
    assert told(built(df)) == want
    assert built(df.limit(0)).count() == 0
    alone = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert built(alone).count() == 0


def test_rounds(spark, monkeypatch):
    """A hundred conversations that each go on from the last, and one of 3,000 turns, take few rounds."""
    tables = []
    monkeypatch.setattr(trie, "written", lambda df, name="table", f=trie.written: (tables.append(name), f(df, name))[1])
    turns = [(c, d, d.to_bytes(16, "big"), 1) for c in range(100) for d in range(1, c + 2)] + [(999, d, (d + (d > 40)).to_bytes(16, "big"), 1) for d in range(1, 3001)]
    df = spark.createDataFrame(turns, "conv_id long, depth long, said binary, chars long")
    got = trie.trie(df, df.select("conv_id").distinct()).collect()
    top = next(r for r in got if r.depth == 0)
    assert len(got) == 1 + 100 + 2960 and top.n_convs == 101 and top.n_leaves == 2
    assert top.saved_tokens == sum(r.n_convs - 1 for r in got if r.depth)
    assert tables.count("runs") <= 16
