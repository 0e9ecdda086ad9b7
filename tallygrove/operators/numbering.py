"""Numbers that depend on an order alone: places of rows in their files, gap-free numbers, ids made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Bits of monotonically_increasing_id() that count within a partition.
WITHIN = 33


def with_places(rows: DataFrame) -> DataFrame:
    """rows, just read from files, with `_file` (its name) and `_place` (from 0 in the file): the same on every run and for any number of partitions.

    Parquet files know their rows' places. Of other formats a file must be read by one task (whole or multi-line files);
    its rows then follow each other, and their places are counted from its first. `_file`, `_place` order all rows.
    """
    name = F.col("_metadata.file_path")
    try:
        placed = rows.select("*", name.alias("_file"), F.col("_metadata.row_index").alias("_place"))
        placed.schema  # noqa: B018  asks whether the format has row indexes
        return placed
    except Exception as e:  # only Parquet has them
        if "row_index" not in str(e):
            raise
    counted = written(rows.select("*", name.alias("_file"), F.monotonically_increasing_id().alias("_at")), "places")
    first = counted.groupBy("_file").agg(F.min("_at").alias("_first"))
    return counted.join(first, "_file").select(*rows.columns, "_file", (F.col("_at") - F.col("_first")).alias("_place"))


def numbered(rows: DataFrame, order: Sequence[str | Column], name: str = "number", start: int = 1) -> DataFrame:
    """rows with gap-free numbers in a total order, without gathering them in one task.

    The rows are dealt out by ranges of the order, sorted and counted where they are; a partition's first number is the
    count of all before it. Only one count a partition comes to the driver. Rows that the order leaves equal get numbers in no particular order.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    at = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = written(dealt.select("*", F.shiftright(at, WITHIN).alias("_part"), at.bitwiseAND((1 << WITHIN) - 1).alias("_at")), "numbered")
    counts = kept.groupBy("_part").count().collect()
    before, total = [], start
    for part, n in sorted(map(tuple, counts)):
        before.append((part, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(before, "_part long, _before long")
    return kept.join(F.broadcast(offsets), "_part").select(*rows.columns, (F.col("_before") + F.col("_at")).alias(name))


def with_ordinal(rows: DataFrame, name: str = "_rid") -> DataFrame:
    """rows, just read from files, with one number for all in the order of files and places, from 0."""
    return numbered(with_places(rows), ["_file", "_place"], name, 0).drop("_file", "_place")


def cluster_ids(rows: DataFrame, cluster: str, first: str, name: str = "cluster_id", form: str = "ORG-C%05d") -> DataFrame:
    """rows with an id for each cluster, numbered by the cluster's first row."""
    seen = rows.groupBy(F.col(cluster).alias("_cluster")).agg(F.min(first).alias("_first"))
    ids = numbered(seen, ["_first", "_cluster"], "_n").select("_cluster", F.format_string(form, "_n").alias(name))
    return rows.join(ids, rows[cluster].eqNullSafe(ids["_cluster"])).select(*rows.columns, name)


def pair_ids(pairs: DataFrame, similarity: str, first: Sequence[str], name: str = "pair_id", form: str = "PAIR-%05d") -> DataFrame:
    """pairs with ids by falling similarity, those of one similarity in the order seen."""
    got = numbered(pairs, [F.desc(similarity), *first], "_n")
    return got.select(*pairs.columns, F.format_string(form, "_n").alias(name))


def merge_pairs(
    pairs: DataFrame, wanted: DataFrame, order: Sequence[str], note: str, reviewer: str, at: str,
    pair_id: str = "pair_id", i: str = "cluster_id_i", j: str = "cluster_id_j", form: str = "P",
) -> DataFrame:
    """pairs after a reviewer has merged clusters: each wanted pair is marked MERGE where it stands, either way round, else added.

    wanted has i and j and may have other columns of pairs (names, type). A pair that pairs holds several times is marked
    at its first (the least pair_id); one that wanted holds several times, either way round, counts once, at its first by `order`. New ones
    get numbers after the highest `P<n>` there is. pairs needs the columns decision, reviewer_notes, reviewer, reviewed_at and similarity.
    """
    key = lambda: F.struct(F.least(F.trim(i), F.trim(j)).alias("lo"), F.greatest(F.trim(i), F.trim(j)).alias("hi"))
    once = wanted.withColumn("_key", key()).where((F.col("_key.lo") != F.col("_key.hi")) & (F.col("_key.lo") != ""))
    once = once.groupBy("_key").agg(F.min(F.struct(F.struct(*order).alias("o"), F.struct(*wanted.columns).alias("row"))).alias("m"))
    once = written(once.select("_key", "m.o", "m.row"), "wanted")
    keyed = pairs.withColumn("_key", key())
    marked = keyed.groupBy("_key").agg(F.min(pair_id).alias("_id")).join(once.select("_key"), "_key", "left_semi").select(F.col("_id").alias("_marked"))
    stamp = {"decision": F.lit("MERGE"), "reviewer_notes": F.lit(note), "reviewer": F.lit(reviewer), "reviewed_at": F.lit(at)}
    hit = pairs.join(marked, pairs[pair_id] == marked["_marked"], "left")
    old = hit.select(*[F.when(F.col("_marked").isNotNull(), stamp[c]).otherwise(F.col(c)).alias(c) if c in stamp else F.col(c) for c in pairs.columns])
    digits = F.regexp_extract(pair_id, rf"^{form}([0-9]+)$", 1)
    highest = pairs.agg(F.max(F.when(digits != "", digits.cast("long")))).first()[0] or 0
    new = numbered(once.join(keyed.select("_key").distinct(), "_key", "left_anti"), ["o", "_key"], "_n", highest + 1)
    given = {c: F.col("row")[c] for c in wanted.columns} | stamp | {pair_id: F.format_string(f"{form}%d", "_n"), "similarity": F.lit("1.00")}
    kinds = {f.name: f.dataType for f in pairs.schema.fields}
    added = new.select(*[given.get(c, F.lit("")).cast(kinds[c]).alias(c) for c in pairs.columns])
    return old.unionByName(added)
