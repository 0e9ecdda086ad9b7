"""Entity resolution: blocked matching, clusters and their roll-ups, authority joins, candidate ranking."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.phonetic import codes
from ..functions.text import aliases, trigram_similarity, trigrams
from ..session import written
from .graph import connected_components


def rare_keys(names: DataFrame, on: Sequence[str], name: str, least: float) -> DataFrame:
    """(on..., name, key): the keys of which two names of a trigram similarity of `least` or more share one. Names must be distinct in on.

    They are the trigrams that such a name must share some of, the rarest of all names first (a prefix filter), so no
    frequent trigram brings many names together. Names without trigrams, and those with a word so short that they may be compared by
    words, have their words as keys too. Blank names have none.
    """
    c = F.col(name)
    words = F.filter(F.array_distinct(F.split(c, " ")), lambda w: w != "")
    grams = names.where(c != "").select(*on, name, trigrams(c).alias("_g"))
    each = grams.select(*on, name, F.size("_g").alias("_n"), F.explode("_g").alias("_gram"))
    counts = each.groupBy("_gram").agg(F.count("*").alias("_f"))
    ranked = each.join(counts, "_gram").groupBy(*on, name, "_n").agg(F.array_sort(F.collect_list(F.struct("_f", "_gram"))).alias("_all"))
    need = F.greatest(F.col("_n") - F.ceil(F.col("_n") * least - 1e-9).cast("int") + 1, F.lit(1))
    found = ranked.select(*on, name, F.explode(F.slice("_all", F.lit(1), need)).alias("_k")).select(*on, name, F.col("_k._gram").alias("key"))
    short = grams.where((F.size("_g") == 0) | F.exists(words, lambda w: F.length(w) < 3)).select(*on, name, F.explode(words).alias("key"))
    return found.unionByName(short)


def near_names(left: DataFrame, right: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """(a, b, score) of different names of both sides with a trigram similarity of `least` or more; a and b are distinct names in columns of different names."""
    both = left.select(F.col(a).alias("_name")).union(right.select(F.col(b).alias("_name"))).distinct()
    keys = written(rare_keys(both, [], "_name", least), "keys")
    side = lambda d, c: d.select(c).join(keys, F.col(c) == F.col("_name")).select(c, "key")
    pairs = side(left, a).join(side(right, b), "key").select(a, b).distinct()
    return pairs.withColumn("score", trigram_similarity(F.col(a), F.col(b))).where(F.col("score") >= least)


def blocked_pairs(rows: DataFrame, block: Sequence[str], name: str, rid: str, least: float) -> DataFrame:
    """Pairs i < j within a block whose normalised names are at least so similar: (rid_i, rid_j, name_i, name_j, similarity).

    Equal names of a block are one before the join and come back as pairs with their first row. Only ids that share a
    block and a rare key meet; each different pair of names that comes of it is compared once.
    """
    first = written(rows.where(F.col(name) != "").groupBy(*block, F.col(name).alias("name")).agg(F.min(rid).alias("rid")), "first")
    keys = written(rare_keys(first.select("name").distinct(), [], "name", least), "keys")
    keyed = first.join(keys, "name").select(*block, "key", "rid")
    left, right = (keyed.withColumnRenamed("rid", f"rid_{k}") for k in "ij")
    met = left.join(right, [*block, "key"]).where("rid_i < rid_j").select("rid_i", "rid_j").distinct()
    for k in "ij":
        met = met.join(first.select(F.col("rid").alias(f"rid_{k}"), F.col("name").alias(f"name_{k}")), f"rid_{k}")
    met = written(met, "met")
    near = met.select("name_i", "name_j").distinct().withColumn("similarity", trigram_similarity(F.col("name_i"), F.col("name_j"))).where(F.col("similarity") >= least)
    return met.join(near, ["name_i", "name_j"]).select("rid_i", "rid_j", "name_i", "name_j", "similarity")


def clusters(rows: DataFrame, rid: str, edges: DataFrame) -> DataFrame:
    """rows with `cluster`, the smallest rid that edges (rid_i, rid_j) connect them with: themselves if none does."""
    found = connected_components(edges, "rid_i", "rid_j").withColumnsRenamed({"vertex": "_v", "component": "_c"})
    return rows.join(found, rows[rid] == found["_v"], "left").withColumn("cluster", F.coalesce("_c", rid)).drop("_v", "_c")


def mode_first_seen(rows: DataFrame, key: str, value: str, rid: str) -> DataFrame:
    """(key, value) most frequent in each group; the one seen first if several are."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("_n"), F.min(rid).alias("_first"))
    w = Window.partitionBy(key).orderBy(F.desc("_n"), "_first")
    return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(key, value)


def first_k(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int) -> DataFrame:
    """The first k rows of each group in a total order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def ranked_candidates(rows: DataFrame, authority: DataFrame, name: str, rid: str, a_name: str, a_id: str, least: float = 0.6, k: int = 5) -> DataFrame:
    """(rid, a_id, score, method): the k best authorities by exact name, else trigram similarity.

    Names meet on rare keys and each different pair is compared once; ties go by authority id. Blank names match none.
    """
    a, b = rows.select(F.col(rid).alias("rid"), F.col(name).alias("a")), authority.select(F.col(a_id).alias("a_id"), F.col(a_name).alias("b"))
    scored = near_names(a.where("a <> ''").select("a").distinct(), b.where("b <> ''").select("b").distinct(), "a", "b", least)
    full = a.join(scored, "a").join(b, "b").withColumn("method", F.when(F.col("a") == F.col("b"), "exact").otherwise("fuzzy"))
    return first_k(full.select("rid", "a_id", "score", "method"), ["rid"], [F.desc("score"), "a_id"], k)


def ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two names; for distinct pairs, as it runs in Python."""
    from difflib import SequenceMatcher

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y, strict=True)])

    return of(a, b)


def keep_unresolved(rows: DataFrame, authority: DataFrame, on: Column, reasons: Sequence[tuple[Column, str]]) -> DataFrame:
    """Left join with `reason`: the first condition that holds, or null for resolved rows."""
    out, chain = rows.join(authority, on, "left"), None
    for condition, name in reasons:
        chain = F.when(condition, name) if chain is None else chain.when(condition, name)
    return out.withColumn("reason", chain)


def upsert(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """old with blank values filled from new, a conflict flag where both differ, and the rows only new has.

    A key that new repeats counts once, with its least value.
    """
    new = new.groupBy(key).agg(F.min(value).alias(value))
    n = new.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    blank = F.coalesce(F.trim(value), F.lit("")) == ""
    merged = old.join(n, old[key] == n["_k"], "left").select(
        key,
        F.when(blank, F.coalesce("_v", F.lit(""))).otherwise(F.col(value)).alias(value),
        (~blank & F.col("_v").isNotNull() & (F.col("_v") != F.col(value))).alias("conflict"),
    )
    added = new.join(old, key, "left_anti").select(key, value, F.lit(False).alias("conflict"))
    return merged.unionByName(added)


def stratified(rows: DataFrame, stratum: str, targets: dict[str, int], order: Column) -> DataFrame:
    """Up to the target number of rows of each stratum, in the order of a hash; strata without a target give none."""
    want = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])
    w = Window.partitionBy(stratum).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.coalesce(want[F.col(stratum)], F.lit(0))).drop("_r")


def sampled(rows: DataFrame, rid: str, stratum: Column, targets: dict[str, int | None], rest: tuple[str, int], seed: int = 42) -> DataFrame:
    """rows of a stratified sample with `review_stratum`, in the order of rid: the target number of each stratum, and `rest` (name, number) from all that no stratum took.

    Rows are drawn in the order of the MD5 of seed and rid, so the same ones on every run and for any partitions. A target of None
    takes a whole stratum. Each is the head of an order, kept by partial tops; no stratum is sorted whole.
    """
    named = rows.withColumns({"review_stratum": stratum, "_draw": F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(rid).cast("string")))})
    whole = [k for k, n in targets.items() if n is None]
    some = {k: n for k, n in targets.items() if n is not None}
    taken = first_k(named.where(F.col("review_stratum").isin(*some)), ["review_stratum"], ["_draw", rid], max(some.values(), default=0))
    want = F.create_map(*[F.lit(x) for kv in (some or {"": 0}).items() for x in kv])
    place = F.row_number().over(Window.partitionBy("review_stratum").orderBy("_draw", rid))
    taken = taken.withColumn("_r", place).where(F.col("_r") <= want[F.col("review_stratum")]).drop("_r")
    taken = taken.unionByName(named.where(F.col("review_stratum").isin(*whole)))
    left = named.join(taken.select(rid), rid, "left_anti").orderBy("_draw", rid).limit(rest[1]).withColumn("review_stratum", F.lit(rest[0]))
    return taken.unionByName(left.select(*taken.columns)).orderBy(rid).drop("_draw")


def latest(log: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The last decision of each key of an append-only log; combined before the shuffle, so a key of many decisions is no load."""
    last = log.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*log.columns), F.struct(ts, tie)).alias("_last"))
    return last.select("_last.*")


def merge_identities(rows: DataFrame, losers: DataFrame, key: str) -> DataFrame:
    """rows with `survivor`: losers (loser, survivor) are rewritten, all others are their own; of a loser's survivors the least counts."""
    losers = losers.groupBy("loser").agg(F.min("survivor").alias("survivor"))
    return rows.join(losers, rows[key] == losers["loser"], "left").withColumn("survivor", F.coalesce("survivor", key)).drop("loser")


def ancestors(edges: DataFrame, depth: int = 6) -> DataFrame:
    """(node, ancestor) over edges (node, parent), up to so many levels; each once, cycles end by themselves."""
    e = edges.where("parent is not null").select("node", "parent").distinct()
    step = e.select(F.col("node").alias("at"), F.col("parent").alias("next"))
    level = e.select("node", F.col("parent").alias("ancestor"))
    out = level
    for _ in range(depth - 1):
        level = level.join(step, F.col("ancestor") == F.col("at")).select("node", F.col("next").alias("ancestor")).distinct()
        out = out.unionByName(level)
    return out.distinct()


def rules(cases: Iterable[tuple[Column, str]], other: str) -> Column:
    """The name of the first condition that holds."""
    chain = None
    for condition, name in cases:
        chain = F.when(condition, F.lit(name)) if chain is None else chain.when(condition, F.lit(name))
    return chain.otherwise(F.lit(other))


def flags(**conditions: Column) -> Column:
    """The names of the conditions that hold, sorted, joined by semicolons."""
    return F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in conditions.items()]))), ";")


def conform(rows: DataFrame, schema: dict[str, tuple[str, object]]) -> DataFrame:
    """Columns of a fixed schema (name: type and default) in its order: missing ones added, nulls filled, others dropped."""
    have = set(rows.columns)
    return rows.select(*[F.coalesce(F.col(k).cast(t) if k in have else F.lit(None).cast(t), F.lit(d).cast(t)).alias(k) for k, (t, d) in schema.items()])


def with_siblings(rows: DataFrame, group: Sequence[str], flagged: Column) -> DataFrame:
    """Flagged rows and, as context, the other rows of their groups, each once."""
    hit = rows.where(flagged).select(*group).distinct()
    return rows.join(hit, list(group), "left_semi").withColumn("row_type", F.when(flagged, "flagged").otherwise("context"))


def ratio_join(left: DataFrame, right: DataFrame, a: str, b: str, least: float, on: Sequence[str] = ()) -> DataFrame:
    """(on..., a, b, ratio) for names of both sides whose Ratcliff-Obershelp ratio is at least so much; blanks match nothing.

    Exact: such names share a numbered letter among the rarest few of each (a prefix filter on what a ratio needs), and
    only candidates that meet there and whose lengths fit are compared, each different pair once.
    """
    need = least / (2 - least)

    def keyed(d: DataFrame, c: str) -> DataFrame:
        n = F.length(c)
        letters = F.transform(F.sequence(F.lit(1), n), lambda k: F.substring(F.col(c), k, F.lit(1)))
        numbered = lambda x, k: F.struct((-F.size(F.filter(F.slice("_l", F.lit(1), k + 1), lambda y: y == x))).alias("k"), x.alias("x"))
        some = d.select(*on, c).where(F.col(c) != "").distinct().withColumn("_l", letters)
        kept = F.slice(F.array_sort(F.transform("_l", numbered)), F.lit(1), n - F.ceil(n * need - 1e-9).cast("int") + 1)
        return some.select(*on, c, F.explode(kept).alias("_key"))

    pairs = keyed(left, a).join(keyed(right, b), [*on, "_key"]).select(*on, a, b)
    fits = least * (F.length(a) + F.length(b)) <= 2 * F.least(F.length(a), F.length(b)) + 1e-9
    return pairs.where(fits).distinct().withColumn("ratio", ratio(F.col(a), F.col(b))).where(F.col("ratio") >= least)


def location_split(rows: DataFrame, rid: str, cluster: str, exempt: Column, fields: Sequence[str], least: float = 0.8) -> DataFrame:
    """rows with new_cluster and new_size: clusters whose rows' places don't hang together get a number for each part.

    Rows hang together if one of their fields is equal or has a ratio of at least so much (the value seen first comes
    first in it). A row without any place, or only exempt rows, keep a cluster whole. Null clusters stay as they are.
    """
    norm = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)\s+", " ")))
    places = F.filter(F.array(*[F.struct(F.lit(c).alias("field"), norm(c).alias("value")) for c in fields]), lambda x: x["value"] != "")
    found = rows.select(F.col(rid).alias("_rid"), F.col(cluster).alias("_cl"), places.alias("_p"), F.coalesce(exempt, F.lit(False)).alias("_e")).where("_cl is not null")
    loose = found.groupBy("_cl").agg(F.bool_or(F.size("_p") == 0).alias("bridge"), F.bool_and("_e").alias("free")).where("not bridge and not free").select("_cl")
    at = found.join(loose, "_cl", "left_semi").select("_cl", "_rid", F.inline("_p"))
    first = at.groupBy("_cl", "field", "value").agg(F.min("_rid").alias("_f"))
    same = at.join(first, ["_cl", "field", "value"]).select("_f", "_rid")
    i, j = (first.select("_cl", "field", F.col("value").alias(f"v{k}"), F.col("_f").alias(f"f{k}")) for k in "ij")
    near = ratio_join(i, j, "vi", "vj", least, ["_cl", "field"])
    near = near.join(i, ["_cl", "field", "vi"]).join(j, ["_cl", "field", "vj"]).where("fi < fj or fi = fj and vi < vj").select("fi", "fj")
    parts = clusters(at.select("_cl", "_rid").distinct(), "_rid", same.unionByName(near.toDF("_f", "_rid")).toDF("rid_i", "rid_j")).withColumnRenamed("cluster", "_part")
    sizes = parts.groupBy("_cl", "_part").agg(F.count("*").alias("new_size"))
    w = Window.partitionBy("_cl")
    numbered = sizes.withColumns({"_k": F.row_number().over(w.orderBy("_part")), "_n": F.count("*").over(w)}).where("_n > 1")
    moved = parts.join(numbered, ["_cl", "_part"]).select("_rid", F.format_string("%s_S%02d", F.col("_cl").cast("string"), "_k").alias("new_cluster"), "new_size")
    out = rows.join(moved, rows[rid] == moved["_rid"], "left").drop("_rid")
    return out.withColumn("new_cluster", F.coalesce("new_cluster", F.col(cluster).cast("string")))


def drift_repair(decisions: DataFrame, current: DataFrame, key: str, identity: Sequence[str], refresh: Sequence[str], cleared: Sequence[str]) -> DataFrame:
    """decisions with `drift`: missing (no current row), repaired (its identity differs) or unchanged.

    The refreshed columns come from the current row; a decision about a missing or different row is cleared.
    """
    norm = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\s+", " ")))
    every = list(dict.fromkeys([*identity, *refresh]))
    now = current.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_now_{c}") for c in every])
    joined = decisions.join(now, decisions[key] == now["_k"], "left")
    differs = F.lit(False)
    for c in identity:
        differs = differs | (norm(F.col(c)) != norm(F.col(f"_now_{c}")))
    joined = joined.withColumn("drift", F.when(F.col("_k").isNull(), "missing").when(differs, "repaired").otherwise("unchanged"))
    one = lambda c: (
        F.when(F.col("drift") == "unchanged", F.col(c)).otherwise("").alias(c) if c in cleared
        else F.when(F.col("_k").isNull(), F.col(c)).otherwise(F.col(f"_now_{c}")).alias(c) if c in refresh else F.col(c)
    )
    return joined.select(*[one(c) for c in decisions.columns], "drift")


def signal_candidates(rows: DataFrame, authority: DataFrame, name: str, rid: str, a_name: str, a_id: str, generic: Sequence[str] = (), least: float = 0.6, k: int = 5) -> DataFrame:
    """(rid, a_id, score, method): the k best by shared alias (1), shared phonetic code (0.85) or trigrams, ties by id."""
    a, b = rows.select(F.col(rid).alias("rid"), F.col(name).alias("a")), authority.select(F.col(a_id).alias("a_id"), F.col(a_name).alias("b"))
    left, right = a.select("a").where("a <> ''").distinct(), b.select("b").where("b <> ''").distinct()

    def meet(key, method: str, score: Column, rank: int) -> DataFrame:
        pairs = left.withColumn("key", F.explode(key(F.col("a")))).join(right.withColumn("key", F.explode(key(F.col("b")))), "key").select("a", "b").distinct()
        return pairs.select("a", "b", score.alias("score"), F.lit(rank).alias("rank"), F.lit(method).alias("method"))

    fuzzy = near_names(left, right, "a", "b", least).select("a", "b", "score", F.lit(0).alias("rank"), F.lit("fuzzy").alias("method"))
    found = meet(lambda c: aliases(c, generic=tuple(generic)), "exact", F.lit(1.0), 2)
    found = found.unionByName(meet(codes, "phonetic", F.lit(0.85), 1)).unionByName(fuzzy)
    best = found.where(F.col("score") >= least).groupBy("a", "b").agg(F.max(F.struct("score", "rank", "method")).alias("best"))
    full = a.join(best, "a").join(b, "b").select("rid", "a_id", "best.score", "best.method")
    return first_k(full, ["rid"], [F.desc("score"), "a_id"], k)
