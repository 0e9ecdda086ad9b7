"""Cells that hold lists: taken apart by place, joined, and put together in order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cells


def ordered_distinct(rows: DataFrame, group: Sequence[str], value: Column, order: Sequence[str | Column], name: str, by: Column | None = None) -> DataFrame:
    """(group..., name): the different values of each group in the order in which they are first seen.

    Values that agree in `by` (if given) are the same, the first counts. Repeats go in an aggregate that combines before
    the shuffle, without a window; one group's different values meet in one row, as that is the result. Null values count as none.
    """
    key = value if by is None else by
    seen = rows.where(value.isNotNull()).groupBy(*group, key.alias("_key")).agg(F.min(F.struct(F.struct(*order).alias("o"), value.alias("v"))).alias("m"))
    return seen.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["v"]).alias(name))


def zipped(rows: DataFrame, key: str, lists: Mapping[str, str], sep: str = r"[|]") -> DataFrame:
    """(key, position, *lists): the packed cells of each row zipped by place; shorter ones are blank beyond their end.

    lists names the new columns and the cells that they come from; places count from 0. Blank parts of a cell count as none.
    """
    parts = F.arrays_zip(*[cells(c, sep).alias(n) for n, c in lists.items()])
    return rows.select(key, F.posexplode(parts).alias("position", "_p")).select(key, "position", *[F.coalesce(F.col("_p")[n], F.lit("")).alias(n) for n in lists])


def candidates(rows: DataFrame, key: str, lists: Mapping[str, str], authority: DataFrame, a_id: str, show: Mapping[str, str], missing: str = "(missing)") -> DataFrame:
    """zipped() lists, of which the first holds ids, with what the authority shows for them: ids come first, places without one fall out.

    show names new columns and the authority's that they come from; of an id that it hasn't got the first is `missing`, the others are blank.
    """
    ident = next(iter(lists))
    known = authority.groupBy(F.trim(F.col(a_id).cast("string")).alias("_id")).agg(F.min(F.struct(*[F.col(c).cast("string").alias(n) for n, c in show.items()])).alias("_a"))
    each = zipped(rows, key, lists).where(F.col(ident) != "")
    joined = each.join(known, each[ident] == known["_id"], "left")
    shown = [F.coalesce(F.col("_a")[n], F.when(F.col("_id").isNull(), F.lit("" if k else missing)), F.lit("")).alias(n) for k, n in enumerate(show)]
    return joined.select(key, "position", *lists, F.col("_id").isNotNull().alias("known"), *shown)


def together(each: DataFrame, key: str, columns: Sequence[str], sep: str = "|") -> DataFrame:
    """(key, *columns): the columns' values joined in the order of `position`, one cell each."""
    got = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", *columns))).alias("_all"))
    return got.select(key, *[F.array_join(F.col("_all")[c], sep, "").alias(c) for c in columns])
