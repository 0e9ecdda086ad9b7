"""Prefix trie of conversations, totalled by leaf-peeling message passing.

A node is a different sequence of the first turns (role, text) of conversations; the root has none. Its key is a running
128-bit hash over the turns' hashes, computed in one pass over each conversation's sorted turns, so equal prefixes have
equal keys and texts are read once. Aggregates that combine before the shuffle make the nodes of them.

Subtree totals travel from the leaves to the root in messages. What passes them is a run of nodes below each other: of
the conversations through a node one is its champion, that of the smallest hash of the id, and the nodes of one champion
are such a run, from where it parts with a smaller one down to its own end. A run holds a counter of the runs that hang
on it. A round peels all runs with none left: each sends its total to the node above it and is done; the counters go down. It
ends when the run of the root is done. The champion of a set is that of a part of it by the part's share, so a path from
the root crosses about log(conversations) runs however deep it is: a conversation of 10,000 turns, or 10,000
conversations that each go on from the last, take no more rounds. Inside a run totals are summed from below.

Turns are ordered by turn (nulls first), then role, then text; null roles and texts are empty. Repeated rows are turns of
their own. Rows without a conv_id belong to no conversation and are left out. A conversation that has no turns after
rebuilding is a member of the root alone. Other columns are not read. An empty table gives no nodes. One conversation's
turns are sorted and hashed in one task, a row at a time; nothing else is bound to a key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

ROOT = bytes(16)
#: Conversations that share a base, and the most turns that one takes from it.
FAMILY, SHARED = 100, 5
#: Digits and commas of a part of a member list.
PART_BYTES = 1_000_000
PREFIXES = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("chars", pa.int64()), ("last", pa.bool_())])


def turns_of(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, depth, said, chars) of each turn, in order from 1: said is a 128-bit hash of role and text."""
    t = rows.select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))],
    ).where("conv_id is not null")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    said = F.expr("substring(unhex(_sha), 1, 16)")
    return t.select("conv_id", place.cast("long").alias("depth"), F.sha2(whole, 256).alias("_sha"), F.length("text").cast("long").alias("chars")).select("conv_id", "depth", said.alias("said"), "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of all conversations, each with the first of its family's base in place of its own first, and the conversations' ids.

    Conversation c gets the first h turns of c - c % FAMILY (all if fewer, none if absent) before its own after the first h; h = crc32(c) % 6.
    """
    turns = written(turns, "turns")
    sizes = turns.groupBy("conv_id").agg(F.max("depth").alias("n"))
    h, base = F.crc32(F.col("conv_id").cast("string")) % (SHARED + 1), F.col("conv_id") - F.col("conv_id") % FAMILY
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("has"))
    convs = sizes.select("conv_id", h.alias("h"), base.alias("base")).join(bases, "base", "left")
    convs = convs.withColumn("k", F.least("h", F.coalesce("has", F.lit(0))))
    heads = turns.where(F.col("depth") <= SHARED).withColumnRenamed("conv_id", "base")
    taken = convs.join(heads, "base").where("depth <= k").select("conv_id", "depth", "said", "chars")
    own = turns.join(convs.select("conv_id", "h", "k"), "conv_id").where("depth > h").select("conv_id", (F.col("depth") - F.col("h") + F.col("k")).alias("depth"), "said", "chars")
    return taken.unionByName(own), sizes.select("conv_id")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, chars, last) of every prefix of every conversation, the root's included."""
    tops = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("said"), F.lit(0).cast("long").alias("chars"))

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, node, waits = None, ROOT, None  # the row before: whether it is its conversation's last shows in the next one
        for b in batches:
            made = []
            for c, depth, said, chars in zip(*(b[k].to_pylist() for k in ("conv_id", "depth", "said", "chars")), strict=True):
                if waits:
                    made.append((*waits, c != conv))
                parent, node = (node, blake2b(node + said, digest_size=16).digest()) if c == conv else (None, ROOT)
                conv, waits = c, (c, depth, node, parent, chars)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*made, strict=True), PREFIXES, strict=True)], schema=PREFIXES)
        if waits:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*waits, True), PREFIXES, strict=True)], schema=PREFIXES)

    dealt = turns.unionByName(tops).repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    return dealt.mapInArrow(each, "conv_id long, depth long, node binary, parent binary, chars long, last boolean")


def members_hashed(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): the digest of each node's conv_ids, ascending and joined by commas.

    Ids are sorted over the whole cluster and joined to parts first; of a node only the parts meet in a task, one at a time.
    """

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids, size = None, None, [], 0
        for b in batches:
            made = []
            for n, c in zip(b["node"].to_pylist(), b["conv_id"].to_pylist(), strict=True):
                if ids and (n != node or size > PART_BYTES):
                    made.append((node, first, ",".join(ids)))
                    ids, size = [], 0
                if not ids:
                    node, first = n, c
                ids.append(str(c))
                size += len(ids[-1]) + 1
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*made, strict=True)], names=["node", "first", "ids"])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([first], pa.int64()), pa.array([",".join(ids)])], names=["node", "first", "ids"])

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, told = None, None
        for b in batches:
            made = []
            for n, ids in zip(b["node"].to_pylist(), b["ids"].to_pylist(), strict=True):
                if n != node:
                    if told:
                        made.append((node, told.hexdigest()))
                    node, told = n, sha256(ids.encode())
                else:
                    told.update(b"," + ids.encode())
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*made, strict=True)], names=["node", "ends_sha256"])
        if told:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([told.hexdigest()])], names=["node", "ends_sha256"])

    parts = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(join, "node binary, first long, ids string")
    return parts.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digest, "node binary, ends_sha256 string")


def peeled(nodes: DataFrame) -> DataFrame:
    """(champion, depth, n_leaves, saved) that the runs hanging on a node have sent it; for nodes with such runs."""
    runs = nodes.groupBy("champion").agg(F.min(F.struct("depth", "above")).alias("top"), F.sum(F.col("n_children").eqNullSafe(0).cast("long")).alias("leaves"), F.sum("saved").alias("saved"))
    runs = runs.select("champion", F.col("top.above").alias("above"), (F.col("top.depth") - 1).alias("at"), "leaves", "saved")
    hanging = runs.groupBy(F.col("above").alias("champion")).agg(F.count("*").alias("open"))
    waiting = written(runs.join(hanging, "champion", "left").fillna(0, ["open"]), "runs")
    sent = []
    while not waiting.isEmpty():
        done = waiting.where("open = 0 and above is not null")
        sent.append(done.select(F.col("above").alias("champion"), F.col("at").alias("depth"), "leaves", "saved"))
        told = done.groupBy(F.col("above").alias("champion")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"), F.count("*").alias("n"))
        left = waiting.where("open > 0").join(told, "champion", "left")
        waiting = written(left.select("champion", "above", "at", *[(F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("leaves", "l"), ("saved", "s"))], (F.col("open") - F.coalesce("n", F.lit(0))).alias("open")), "runs")
    whole = sent[0]
    for more in sent[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy("champion", "depth").agg(F.sum("leaves").alias("leaves_below"), F.sum("saved").alias("saved_below"))


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns has conv_id, depth (from 1, without gaps), said and chars; convs the ids of all conversations, those without turns too.
    """
    at = written(prefixes(turns, convs), "prefixes")
    champion = F.min(F.struct(F.xxhash64("conv_id"), "conv_id"))["conv_id"]
    nodes = at.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        champion.alias("champion"), ((F.count("*") - 1) * F.max("chars")).alias("saved"),
    )
    nodes = written(nodes, "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("champion").alias("_above"))
    nodes = nodes.join(children, "node", "left").fillna(0, ["n_children"]).join(above, "parent", "left")
    # a run's top hangs on another run; the others of a run hang on their own
    nodes = written(nodes.select("node", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "champion", "saved", F.col("_above").alias("above")), "nodes")
    if nodes.isEmpty():
        return nodes.selectExpr("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_children as n_leaves", "saved as saved_tokens", "'' as ends_sha256")
    got = nodes.join(peeled(nodes), ["champion", "depth"], "left")
    below = Window.partitionBy("champion").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    total = lambda own, sent: F.sum(own + F.coalesce(sent, F.lit(0))).over(below)
    got = got.withColumns({"n_leaves": total((F.col("n_children") == 0).cast("long"), "leaves_below"), "saved_tokens": total(F.col("saved"), "saved_below")})
    hashed = members_hashed(at.where("last").select("node", "conv_id"))
    nothing = F.lit(sha256(b"").hexdigest())
    return got.join(hashed, "node", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
