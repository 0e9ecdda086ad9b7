"""Reviewers' decisions as events: what they leave of a table, corrections passed on to other tables, and alignments linked to clusters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text
from ..session import written
from .resolve import latest, ratio

#: The columns that tell who decided and when, and an event that takes a decision back.
STAMP = ("reviewer", "reviewed_at")
BACK = "REQUEUE"


def stamped(rows: DataFrame, reviewer: str | Column, at: str | Column) -> DataFrame:
    """rows with who reviewed them and when, in columns that are added where they are missing."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return rows.withColumns(dict(zip(STAMP, map(as_column, (reviewer, at)), strict=True)))


def decided(rows: DataFrame, log: DataFrame, key: str, sets: Sequence[str], ts: str = "at", tie: str = "n", kind: str = "decision") -> DataFrame:
    """rows as the log of decisions leaves them; the log is only ever added to.

    The last event of each key counts (by ts, then tie). It sets `kind` and the columns of `sets` that it tells (null
    leaves one as it is) and stamps the row. A REQUEUE blanks all of them, and is stamped too. Events about keys that
    rows lack, or about none, are ignored. rows gets the columns of a decision where it lacks them, blank.
    """
    last = latest(log.where(F.trim(text(F.col(key).cast("string"))) != ""), key, ts, tie).select(F.col(key).alias("_k"), F.struct(kind, *sets, ts, STAMP[0]).alias("_e"))
    joined = rows.join(last, rows[key] == F.col("_k"), "left")
    hit, back = F.col("_k").isNotNull(), F.col(f"_e.{kind}") == BACK
    have = set(rows.columns)
    old = lambda c: F.col(c) if c in have else F.lit("")
    new = {c: F.when(hit & F.coalesce(back, F.lit(False)), F.lit("")).when(hit, F.coalesce(F.col(f"_e.{c}").cast("string"), old(c))).otherwise(old(c)) for c in (kind, *sets)}
    new |= {STAMP[0]: F.when(hit, F.col(f"_e.{STAMP[0]}")).otherwise(old(STAMP[0])), STAMP[1]: F.when(hit, F.col(f"_e.{ts}").cast("string")).otherwise(old(STAMP[1]))}
    return joined.select(*[(new[c] if c in new else F.col(c)).alias(c) for c in dict.fromkeys([*rows.columns, *new])])


def passed_on(tables: Mapping[str, tuple[DataFrame, str]], changes: DataFrame, key: str, column: str, order: Sequence[str]) -> dict[str, DataFrame]:
    """Each table (name: rows and their key) with `column` as the changes have it; of a key's changes the last by `order` counts.

    Values are blank or not: a change to blank blanks. Keys without a change, and null ones, keep what they have.
    """
    last = changes.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(text(column).alias("v")), F.struct(*order)).alias("_c"))
    last = written(last, "changes")

    def one(rows: DataFrame, own: str) -> DataFrame:
        joined = rows.join(last, rows[own] == last["_k"], "left")
        return joined.select(*[F.when(F.col("_k").isNotNull(), F.col("_c.v")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in rows.columns])

    return {name: one(rows, own) for name, (rows, own) in tables.items()}


def linked(alignment: DataFrame, mentions: DataFrame, uid: str, heading: Column, db: str, xml_id: str, cluster: str, name: Column, order: str, least: float = 0.60) -> tuple[DataFrame, DataFrame]:
    """((uid, db_id, cluster_id, score), (uid, reason)): each alignment with the cluster of the mention that its entry holds and that is named most like its heading.

    db holds the authority's number, the first of a packed cell; uid the entry's id after its first hyphen. Alignments
    without an authority are left out of both. The others are rejected if the number is none (invalid_align_with_db), no
    mention has the entry (xml_id_not_found) or none of them a cluster (no_cluster_id), or if there are several and the
    best is below `least` (ambiguous_cluster_match). Of equally good mentions the first by `order` counts. heading and
    name are normalised names; a blank one has a likeness of 0. Each row is judged by itself, so a uid that repeats comes back as often.

    An entry's mentions of one name are one row, and so are its alignments of one heading, before they meet. Of these only
    headings that none of the names equals meet the names, and where several mentions have a cluster only those of a length
    that `least` allows. Each different pair of names is compared once.
    """
    asked = alignment.where(F.trim(text(db)) != "").select(
        F.col(uid).alias("uid"), F.regexp_extract(F.trim(text(db)), r"^(\d+)\s*(?:\||$)", 1).alias("db_id"), F.trim(F.regexp_replace(text(uid), "^[^-]*-", "")).alias("entry"), text(heading).alias("heading"),
    )
    asked = written(asked.withColumn("db_id", F.expr("try_cast(nullif(db_id, '') as bigint)")), "asked")
    held = mentions.where(F.trim(text(xml_id)) != "").select(F.trim(xml_id).alias("entry"), F.nullif(F.trim(text(cluster)), F.lit("")).alias("cluster_id"), text(name).alias("name"), F.col(order).alias("_order"))
    some = F.col("cluster_id").isNotNull()
    named = held.groupBy("entry", "name").agg(F.count_if(some).alias("n"), F.min(F.when(some, F.struct("_order", "cluster_id"))).alias("m"))
    named = written(named, "named")
    entries = named.groupBy("entry").agg(F.sum("n").alias("n"), F.min("m").alias("first"))
    names = named.where("n > 0 and name <> ''").drop("n")
    asks = asked.where("db_id is not null").select("entry", "heading").distinct().join(entries, "entry")
    asks = written(asks.join(names.withColumnsRenamed({"name": "heading", "m": "same"}), ["entry", "heading"], "left"), "asks")
    long, short = F.greatest(F.length("heading"), F.length("name")), F.least(F.length("heading"), F.length("name"))
    fits = least * (long + short) <= 2 * short + 1e-9
    pairs = asks.where("n > 0 and same is null and heading <> ''").select("entry", "heading", "n").join(names, "entry").where((F.col("n") == 1) | fits)
    told = written(pairs.select("heading", "name").distinct().withColumn("score", ratio(F.col("heading"), F.col("name"))), "told")
    scored = lambda score, m: F.struct((-score).alias("s"), F.col(m)["_order"].alias("_order"), F.col(m)["cluster_id"].alias("cluster_id"))
    near = pairs.join(told, ["heading", "name"]).groupBy("entry", "heading").agg(F.min(scored(F.col("score"), "m")).alias("near"))
    ways = F.when(F.col("same").isNotNull(), scored(F.lit(1.0), "same")), F.col("near"), F.when(F.col("n") > 0, scored(F.lit(0.0), "first"))
    best = written(asks.join(near, ["entry", "heading"], "left").select("entry", "heading", "n", F.least(*ways).alias("b")), "best")
    joined = asked.join(best, ["entry", "heading"], "left").select("uid", "db_id", "n", F.col("b.cluster_id").alias("cluster_id"), F.abs("b.s").alias("score"))
    reason = F.when(F.col("db_id").isNull(), "invalid_align_with_db").when(F.col("n").isNull(), "xml_id_not_found").when(F.col("n") == 0, "no_cluster_id").when((F.col("n") > 1) & (F.col("score") < least), "ambiguous_cluster_match")
    joined = written(joined.select("uid", "db_id", "cluster_id", "score", reason.alias("reason")), "linked")
    return joined.where("reason is null").drop("reason"), joined.where("reason is not null").select("uid", "reason")


def core_table(authorities: DataFrame, links: DataFrame, db_id: str, keep: Sequence[str]) -> DataFrame:
    """(db_id, *keep, linked_cluster_ids) of authorities with a number: their clusters, sorted and joined. Sort by db_id, a number, to write it."""
    known = authorities.where(F.trim(text(F.col(db_id).cast("string"))).rlike(r"^\d+$"))
    packed = links.groupBy(F.col("db_id").alias("_id")).agg(F.array_join(F.array_sort(F.collect_set("cluster_id")), " | ").alias("_linked"))
    number = F.trim(F.col(db_id).cast("string")).cast("bigint")
    rows = known.select(number.alias("db_id"), *[F.trim(text(c)).alias(c) for c in keep])
    return rows.join(packed, F.col("db_id") == F.col("_id"), "left").select("db_id", *keep, text("_linked").alias("linked_cluster_ids"))
