"""Tables that are rewritten while others read them: a folder for each version, seen once its marker is there.

A version is written to a data folder of its own, then named by a marker file under `_versions`, made in one step that fails
if the file exists. Readers list the markers and read what the last (or the pinned) one names, so they see a whole
version or the one before. A writer that dies leaves a folder that no marker names. Of two writers that start from
the same version the second fails and must start again from the new one. Old versions stay, as backups, until forget().

The markers are made through Hadoop's file system of the path, so any store with an exclusive create will do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARKERS = "_versions"


class Conflict(RuntimeError):
    """Someone else has written a version since the one that this writer started from."""


def _at(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all versions, from the first; none if there is no table."""
    fs, hadoop = _at(spark, path)
    folder = hadoop.Path(f"{path}/{MARKERS}")
    if not fs.exists(folder):
        return []
    return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))


def _marker(path: str, version: int) -> str:
    return f"{path}/{MARKERS}/{version:010d}.json"


def named(spark: SparkSession, path: str, version: int) -> dict:
    """What a version's marker holds: its folder, the version that it was made from, and a note."""
    return json.loads(spark.read.text(_marker(path, version), wholetext=True).first()[0])


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the last if none is given. What has been read stays as it is, whoever writes meanwhile."""
    if version is None:
        have = versions(spark, path)
        if not have:
            raise FileNotFoundError(f"no version of a table in {path}")
        version = have[-1]
    return spark.read.parquet(f"{path}/{named(spark, path, version)['folder']}")


def commit(rows: DataFrame, path: str, base: int | None = None, note: str = "") -> int:
    """rows as the next version after base (None: of a table that isn't there yet); its number. Conflict if there is one already."""
    spark = rows.sparkSession
    folder = f"data/{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{folder}")
    fs, hadoop = _at(spark, path)
    number = (base or 0) + 1
    try:
        out = fs.create(hadoop.Path(_marker(path, number)), False)
    except Exception as e:
        if "AlreadyExists" in str(e) or "already exists" in str(e):
            raise Conflict(f"version {number} of {path} has been written by another") from e
        raise
    out.write(bytearray(json.dumps({"folder": folder, "base": base, "note": note}).encode()))
    out.close()
    return number


def rewrite(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], note: str = "") -> int:
    """The next version, made from the last one's rows; Conflict if another was written meanwhile."""
    base = versions(spark, path)[-1]
    return commit(change(read_version(spark, path, base)), path, base, note)


def unseen(rows: DataFrame, have: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """Of rows those whose key isn't blank and isn't among have's, the first of each key."""
    new = rows.where(F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) != "").join(have.select(key), key, "left_anti").select(*rows.columns)
    best = new.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def append(rows: DataFrame, path: str, key: str, order: Sequence[str | Column], note: str = "") -> int:
    """The version that holds the table's rows and those of rows whose key it hasn't got: a new one, or the last if it has them all.

    So an append that is run again changes nothing. Columns that rows lack are blank (null), those that the table lacks are left out.
    """
    spark = rows.sparkSession
    base = versions(spark, path)[-1]
    old = read_version(spark, path, base)
    new = unseen(rows, old, key, order)
    if new.isEmpty():
        return base
    kinds = {f.name: f.dataType for f in old.schema.fields}
    fitted = new.select(*[(F.col(c) if c in new.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
    return commit(old.unionByName(fitted), path, base, note)


def changelog(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change, column, before, after): a row for each cell that differs, as text; change is added, removed or changed.

    Keys must not repeat on a side. Rows on one side alone give a row for each of their cells that isn't null. Columns of one side alone count as null on the other.
    """
    columns = [c for c in dict.fromkeys([*before.columns, *after.columns]) if c != key]
    side = lambda d, n: d.select(F.col(key).alias(key), F.struct(*[(F.col(c) if c in d.columns else F.lit(None)).cast("string").alias(c) for c in columns]).alias(n))
    both = side(before, "_old").join(side(after, "_new"), key, "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col("_old")[c].alias("before"), F.col("_new")[c].alias("after")) for c in columns])
    each = both.select(key, change.alias("change"), F.inline(F.filter(cells, lambda x: ~x["before"].eqNullSafe(x["after"]))))
    return each.select(key, "change", "column", "before", "after")


def forget(spark: SparkSession, path: str, keep: int) -> list[int]:
    """Removes all versions but the last `keep`, and folders that no marker names; for a time when nobody reads or writes them."""
    fs, hadoop = _at(spark, path)
    have = versions(spark, path)
    old, kept = have[: max(0, len(have) - keep)], have[max(0, len(have) - keep) :]
    folders = {named(spark, path, v)["folder"] for v in kept}
    for v in old:
        fs.delete(hadoop.Path(_marker(path, v)), False)
    for s in fs.listStatus(hadoop.Path(f"{path}/data")):
        if f"data/{s.getPath().getName()}" not in folders:
            fs.delete(s.getPath(), True)
    return old
