"""Running a function over Arrow batches of a DataFrame while its other columns are carried along."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import shared_dir

#: Rows and text bytes that a function sees at once.
BATCH_ROWS, BATCH_BYTES = 2000, 16_000_000


def documents(spark, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of bounded rows and bytes."""
    for b in batches:
        step = max(1, min(BATCH_ROWS, int(b.num_rows * BATCH_BYTES / max(1, b.nbytes))))
        for k in range(0, b.num_rows, step):
            yield b.slice(k, step)


def schema(df: DataFrame, new: dict[str, str], drop: Iterable[str] = ()) -> tuple[T.StructType, list[str]]:
    """The schema of df without `drop` and with the new columns, which replace others of their name in any case; what is kept."""
    gone = {x.lower() for x in (*drop, *new)}
    kept = [f for f in df.schema.fields if f.name.lower() not in gone]
    fields = [T.StructField(k, T._parse_datatype_string(v)) for k, v in new.items()]
    return T.StructType([*kept, *fields]), [f.name for f in kept]


def map_batches(
    df: DataFrame, run: Callable[[pa.RecordBatch], Iterator[dict]], new: dict[str, str], drop: Iterable[str] = ()
) -> DataFrame:
    """df with new columns. run() yields, for a batch, one dict of lists of the batch's length."""
    out, kept = schema(df, new, drop)
    kinds = {f.name: to_arrow_type(f.dataType) for f in out.fields if f.name in new}

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for got in run(b):
                made = [pa.array(got[k], type=kinds[k]) for k in new]
                yield pa.RecordBatch.from_arrays([*(b[k] for k in kept), *made], names=[*kept, *new])

    return df.mapInArrow(each, out)


def bucketed(df: DataFrame, column: str, name: str) -> DataFrame:
    """df written once to the shared folder in buckets of a column: grouping by it or joining on it moves no row again."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    to = df.repartition(parts, column).write.bucketBy(parts, column).option("compression", "zstd")
    to.option("path", f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{table}").format("parquet").saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"drop table {table}")  # the files stay, as the plan reads them
    return found
