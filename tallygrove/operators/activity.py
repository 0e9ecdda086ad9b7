"""The log of human decisions: one feed of several review tables, and its counts by reviewer, day and flag."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that may hold a row's id and its label, in the order they are tried.
IDS = ("cluster_id", "db_id", "pair_id", "id")
LABELS = ("canonical_yiddish", "name", "decision", "label")


def first_filled(rows: DataFrame, names: Sequence[str]) -> Column:
    """The first of those columns that rows have and that isn't blank, trimmed; blank if none is."""
    found = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in names if c in rows.columns]
    return F.coalesce(*found, F.lit(""))


def feed(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(source, reviewer, ts, day, id, label, decision) of all rows with a reviewer and a time, of the tables that have both columns."""
    out = None
    for source, rows in tables.items():
        if not {"reviewer", "reviewed_at"} <= set(rows.columns):
            continue
        some = rows.select(
            F.lit(source).alias("source"), first_filled(rows, ["reviewer"]).alias("reviewer"), first_filled(rows, ["reviewed_at"]).alias("ts"),
            first_filled(rows, IDS).alias("id"), first_filled(rows, LABELS).alias("label"), first_filled(rows, ["decision"]).alias("decision"),
        ).where("reviewer <> '' and ts <> ''")
        out = some if out is None else out.unionByName(some)
    if out is None:
        raise ValueError("no table has the columns reviewer and reviewed_at")
    return out.select("source", "reviewer", "ts", F.substring("ts", 1, 10).alias("day"), "id", "label", "decision")


def visible(rows: DataFrame, reviewers: Sequence[str], sources: Sequence[str], since: str) -> DataFrame:
    """Rows of a feed by those reviewers, from those sources, on that day or later."""
    return rows.where(F.col("reviewer").isin(*reviewers) & F.col("source").isin(*sources) & (F.col("day") >= since))


def totals(rows: DataFrame, sources: Sequence[str]) -> DataFrame:
    """(reviewer, total, a column for each source): decisions of each reviewer, most first."""
    each = [F.count_if(F.col("source") == s).alias(s) for s in sources]
    return rows.groupBy("reviewer").agg(F.count("*").alias("total"), *each).orderBy(F.desc("total"), "reviewer")


def by_day(rows: DataFrame, reviewers: Sequence[str]) -> DataFrame:
    """(day, total, a column for each reviewer): decisions of each day, last day first."""
    each = [F.count_if(F.col("reviewer") == r).alias(r) for r in reviewers]
    return rows.groupBy("day").agg(F.count("*").alias("total"), *each).orderBy(F.desc("day"))


def top_flags(rows: DataFrame, flags: str = "review_flags", k: int = 12) -> DataFrame:
    """(flag, n): the k most frequent of the flags that cells hold between semicolons."""
    each = rows.select(F.explode(F.split(F.coalesce(F.col(flags), F.lit("")), ";")).alias("flag")).select(F.trim("flag").alias("flag")).where("flag <> ''")
    return each.groupBy("flag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "flag").limit(k)


def highest_pair(rows: DataFrame, pair_id: str) -> DataFrame:
    """(highest): the greatest number among ids P<n>, 0 without any; ids of other forms don't count."""
    number = F.regexp_extract(F.coalesce(F.col(pair_id), F.lit("")), r"^P(\d+)$", 1).try_cast("bigint")
    return rows.agg(F.coalesce(F.max(number), F.lit(0).cast("bigint")).alias("highest"))


def references(rows: DataFrame, column: str, wanted: Sequence[str]) -> DataFrame:
    """(id, n): how many rows refer to each of the wanted ids, 0 included."""
    asked = rows.sparkSession.createDataFrame([(w,) for w in wanted], "id string")
    counts = rows.groupBy(F.trim(F.col(column).cast("string")).alias("_id")).agg(F.count("*").alias("_n"))
    return asked.join(counts, asked["id"] == counts["_id"], "left").select("id", F.coalesce("_n", F.lit(0)).alias("n"))
