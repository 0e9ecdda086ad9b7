"""What reviewers look at: samples of mentions, filtered and searched lists, counts of strata and places, columns found by parts of names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import geo_status
from ..functions.text import is_missing, normalize_yiddish, text

#: Parts of the names of columns that give a row context, missing tokens of the review sample, and decisions that link.
CONTEXT = ("org_type", "relations", "locations", "descriptive_name")
UNTOLD = ("", "na", "n/a", "null", "-", "--", "_")
LINKS = ("ALIGN", "NEW")


def find_column(rows: DataFrame, fragment: str) -> str | None:
    """The first column whose name holds the fragment."""
    return next((c for c in rows.columns if fragment in c), None)


def has_context(rows: DataFrame, fragments: Sequence[str] = CONTEXT) -> Column:
    """Whether a row has a value that isn't missing in any column whose name holds one of the fragments; false if there is none."""
    found = [~is_missing(F.col(f"`{c}`").cast("string"), UNTOLD) for c in rows.columns if any(f in c for f in fragments)]
    return reduce(lambda a, b: a | b, found, F.lit(False))


def samples(rows: DataFrame, keys: Sequence[str], file: str, entry: str, told: Sequence[str], order: Sequence[str], k: int | None = None) -> DataFrame:
    """The first k rows (all, if None) of each group that tell something (a sentence or a heading), one for each file and entry.

    Rows without both file and entry are never taken for one another. Rows with a blank key have no group. One of each
    file and entry is found by an aggregate that combines before the shuffle; the heads of groups by partial tops.
    """
    blank = lambda c: F.trim(text(F.col(c).cast("string"))) == ""
    some = reduce(lambda a, b: a | b, [~blank(c) for c in told])
    grouped = rows.where(reduce(lambda a, b: a & b, [~blank(c) for c in keys]) & some)
    source = F.struct(F.trim(text(file)).alias("f"), F.trim(text(entry)).alias("e"))
    alone = grouped.where(blank(file) & blank(entry))
    first = grouped.where(~(blank(file) & blank(entry))).groupBy(*keys, source.alias("_s")).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row"))
    every = first.select("_row.*").unionByName(alone)
    if k is None:
        return every
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return every.withColumn("_k", place).where(F.col("_k") <= k).drop("_k")


def visible(rows: DataFrame, decision: str | None = None, types: Sequence[str] = (), part: str = "", kind: str = "org_type", column: str = "decision") -> DataFrame:
    """Rows with that decision (Undecided: none; All or None: any), one of the types (any, if none is named) and a type that holds the part."""
    said, of = F.trim(text(column)), F.lower(text(kind))
    if decision == "Undecided":
        rows = rows.where(said == "")
    elif decision not in (None, "All"):
        rows = rows.where(said == decision)
    if types:
        rows = rows.where(F.trim(of).isin(*[t.lower() for t in types]))
    return rows.where(F.contains(of, F.lit(part.strip().lower()))) if part.strip() else rows


def cards(rows: DataFrame, types: Sequence[str] = (), name: str = "", generic: bool = True, parts: bool = True, status: str | None = None) -> DataFrame:
    """Cards that aren't exploded and have an id, filtered by type, by a part of the name, without generic ones or parts of others, and by geo_status, which is added."""
    told = geo_status("lat", "lon", "confirmed_address", "confirmed_settlement", "country")
    shown = rows.where((text("is_exploded") != "TRUE") & (text("db_id") != "")).withColumn("geo_status", told)
    if types:
        shown = shown.where(F.lower(F.trim(text("org_type"))).isin(*[t.lower() for t in types]))
    if name.strip():
        shown = shown.where(F.contains(F.lower(text("canonical_yiddish")), F.lit(name.strip().lower())))
    if not generic:
        shown = shown.where(text("is_generic") != "TRUE")
    if not parts:
        shown = shown.where(text("parent_db_id") == "")
    return shown.where(F.col("geo_status") == status) if status else shown


def facets(shown: DataFrame) -> DataFrame:
    """(showing, geolocated, has_address, has_settlement, has_country, none, reviewed_ratio) of cards with geo_status; the ratio of none is null."""
    kinds = ("geolocated", "has_address", "has_settlement", "has_country", "none")
    counts = [F.count_if(F.col("geo_status") == k).alias(k) for k in kinds]
    got = shown.agg(F.count("*").alias("showing"), *counts)
    return got.withColumn("reviewed_ratio", F.when(F.col("showing") > 0, (F.col("showing") - F.col("none")) / F.col("showing")))


def search(rows: DataFrame, key: str, order: Sequence[str], name: str, places: Sequence[str], said: str = "", where: str = "", but: str = "", limit: int = 20) -> DataFrame:
    """The first rows whose folded name holds the folded `said` and whose folded places, joined, hold the folded `where`; blank ones hold anything.

    A row of the key `but` isn't shown. With both blank nothing is. The limit is a part of what is asked.
    """
    if not said.strip() and not where.strip():
        return rows.limit(0)
    folded = lambda x: normalize_yiddish(F.lit(x)) if x.strip() else F.lit("")
    at = F.array_join(F.filter(F.array(*[normalize_yiddish(c) for c in places]), lambda x: x != ""), " ") if places else F.lit("")
    hit = F.contains(normalize_yiddish(name), folded(said)) & F.contains(at, folded(where)) & (text(F.col(key).cast("string")) != but)
    return rows.where(hit).orderBy(*order).limit(limit)


def linking(rows: DataFrame, db_id: str = "aligned_db_id", cluster: str = "cluster_id", decision: str = "decision") -> DataFrame:
    """(db_id, cluster_id): the different links that reviewers have made: decisions that link, with both ids."""
    made = rows.where(F.trim(text(decision)).isin(*LINKS)).select(F.trim(text(db_id)).alias("db_id"), F.trim(text(cluster)).alias("cluster_id"))
    return made.where("db_id <> '' and cluster_id <> ''").distinct()


def key_set(rows: DataFrame, key: str) -> DataFrame:
    """The different keys that aren't blank, trimmed."""
    return rows.select(F.trim(text(F.col(key).cast("string"))).alias(key)).where(F.col(key) != "").distinct()


def strata(rows: DataFrame, stratum: Column, names: Sequence[str], **conditions: Column) -> DataFrame:
    """(stratum, n, one count for each condition) of each named stratum, 0 where it has no rows."""
    counted = rows.groupBy(stratum.alias("stratum")).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in conditions.items()])
    named = rows.sparkSession.createDataFrame([(n,) for n in names], "stratum string")
    return named.join(counted, "stratum", "left").fillna(0, ["n", *conditions])


def identity_key(name: str, kind: str, variants: str) -> Column:
    """What tells two clusters' meaning apart: folded name, type in lower case, folded variants. Equal keys are one meaning."""
    return F.struct(normalize_yiddish(name).alias("name"), F.lower(F.trim(text(kind))).alias("kind"), normalize_yiddish(variants).alias("variants"))


def same_meaning(before: DataFrame, after: DataFrame, key: str, name: str, kind: str, variants: str) -> DataFrame:
    """(key, preserved): rows of before and whether after has a row of that key with the same meaning."""
    side = lambda d, c: d.select(F.col(key).alias(key), identity_key(name, kind, variants).alias(c))
    return side(before, "_b").join(side(after, "_a").distinct(), key, "left").groupBy(key).agg(F.bool_or(F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))).alias("preserved"))


def by_number(rows: DataFrame, key: str, *more: str) -> DataFrame:
    """rows in the order of a text column's whole numbers; others come last, ties in the order of `more`, nulls last."""
    return rows.orderBy(F.asc_nulls_last(F.expr(f"try_cast(trim(`{key}`) as bigint)")), *[F.asc_nulls_last(c) for c in more])
