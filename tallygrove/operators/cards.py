"""Cards of authorities: split by place or by a reviewer's groups and put together again, merged, and shown with neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_missing, text

#: Fixed value: the group of mentions that a split leaves out.
EXCLUDED = "— exclude —"


def packed_set(c: str) -> Column:
    """The different values that aren't missing, sorted and joined."""
    return F.array_join(F.array_sort(F.collect_set(F.when(~is_missing(c), F.trim(c)))), " | ")


def place_of(settlement: str, country: str) -> Column:
    return F.coalesce(F.nullif(F.trim(text(settlement)), F.lit("")), F.nullif(F.trim(text(country)), F.lit("")), F.lit("(unknown)"))


def by_place(mentions: DataFrame, db_id: str, settlement: str, country: str, collect: Sequence[str]) -> DataFrame:
    """(db_id, settlement, mentions, collected columns): each card's mentions by settlement, else country, else unknown."""
    return mentions.groupBy(db_id, place_of(settlement, country).alias("settlement")).agg(F.count("*").alias("mentions"), *[packed_set(c).alias(c) for c in collect])


def by_group(mentions: DataFrame, assigned: DataFrame, db_id: str, mention: str, collect: Sequence[str]) -> DataFrame:
    """(db_id, group, mentions, collected columns) by a reviewer's groups (mention, group); excluded and unassigned ones fall out."""
    kept = assigned.where((F.col("group") != EXCLUDED) & (F.col("group") != ""))
    return mentions.join(kept, mention).groupBy(db_id, "group").agg(F.count("*").alias("mentions"), *[packed_set(c).alias(c) for c in collect])


def explode(cards: DataFrame, parts: DataFrame, db_id: str, order: Sequence[str | Column]) -> DataFrame:
    """cards with parent_db_id and is_exploded, and a card `<id>_Xnn` for each of its parts (numbered from 0 in that order).

    Columns of a part that cards lack are dropped; columns of cards that parts lack come from the parent. Cards without
    parts stay as they are.
    """
    w = Window.partitionBy(db_id).orderBy(*order)
    have = parts.select(F.col(db_id).alias("_parent")).distinct()
    marked = cards.join(have, cards[db_id] == have["_parent"], "left")
    old = marked.select(*cards.columns, F.lit("").alias("parent_db_id"), F.col("_parent").isNotNull().alias("is_exploded"))
    numbered = parts.withColumn("_k", F.row_number().over(w) - 1)
    own = [c for c in parts.columns if c != db_id and c in cards.columns]
    pick = [numbered[c] if c in own else cards[c] for c in cards.columns if c != db_id]
    new = numbered.join(cards, db_id).select(
        F.format_string("%s_X%02d", F.col(db_id).cast("string"), "_k").alias(db_id), *pick, F.col(db_id).cast("string").alias("parent_db_id"), F.lit(False).alias("is_exploded")
    )
    return old.withColumn(db_id, F.col(db_id).cast("string")).unionByName(new)


def unexplode(cards: DataFrame, parents: DataFrame, db_id: str) -> DataFrame:
    """cards without the parts of the named parents (db_id), which are no longer exploded."""
    named = parents.select(F.col(db_id).cast("string").alias("_p")).distinct()
    rest = cards.join(named, F.coalesce("parent_db_id", F.lit("")) == F.col("_p"), "left_anti").join(named, F.col(db_id) == F.col("_p"), "left")
    return rest.withColumn("is_exploded", F.col("is_exploded") & F.col("_p").isNull()).drop("_p")


def neighbours(rows: DataFrame, group: str, order: Sequence[str | Column], rid: str) -> DataFrame:
    """(group, rid, position, total, previous, next) of each row within its group's order."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.select(
        group, rid, F.row_number().over(w).alias("position"), F.count("*").over(Window.partitionBy(group)).alias("total"), F.lag(rid).over(w).alias("previous"), F.lead(rid).over(w).alias("next")
    )


def pair_index(pairs: DataFrame, i: str, j: str, pair: str) -> DataFrame:
    """(cluster, pair, other): each pair from both of its sides."""
    return pairs.select(F.col(pair), F.inline(F.array(F.struct(F.col(i).alias("cluster"), F.col(j).alias("other")), F.struct(F.col(j).alias("cluster"), F.col(i).alias("other")))))
