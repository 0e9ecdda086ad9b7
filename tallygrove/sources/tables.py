"""Text tables at the edges: tab-separated files with a header, whole XML files, entity snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tsv(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """All columns as strings; quotes are doubled, cells may hold line ends, blanks are empty strings."""
    options = {"sep": sep, "header": True, "multiLine": True, "quote": '"', "escape": '"', "maxCharsPerColumn": -1, "inferSchema": False}
    return spark.read.options(**options).csv(path).na.fill("")


def write_tsv(rows: DataFrame, path: str, columns: list[str], sep: str = "\t") -> None:
    """The named columns in their order; others are left out."""
    rows.select(*columns).write.options(sep=sep, header=True, escape='"', emptyValue="").csv(path)


def read_entry(spark: SparkSession, path: str, xml_id: str) -> DataFrame:
    """(path, entry) of the whole XML files that hold a `div` of that xml:id: its text with white space squeezed."""
    where = f"//*[local-name()='div'][@*[name()='xml:id']='{xml_id}']"
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return whole.where(F.xpath_boolean("value", F.lit(where))).select("path", F.xpath_string("value", F.lit(f"normalize-space({where})")).alias("entry"))


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """One row per entity of a snapshot: a JSON object of objects by id."""
    kind = "map<string, struct<label_en: string, label_yi: string, p31: array<string>, p17: array<string>, p131: array<string>>>"
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("qid", "e"))
    return whole.select("qid", "e.*")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table by the ending of its name: csv, tsv, txt, json (an array of records) or parquet; all else is an error."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("csv", "tsv", "txt"):
        return read_tsv(spark, path, "," if kind == "csv" else "\t")
    if kind == "json":
        return spark.read.option("multiLine", True).option("primitivesAsString", True).json(path).na.fill("")
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for files ending in .{kind}")


def write_table(rows: DataFrame, path: str) -> None:
    """rows to csv, tsv, txt, json or parquet by the ending of the path."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("csv", "tsv", "txt"):
        write_tsv(rows, path, rows.columns, "," if kind == "csv" else "\t")
    elif kind in ("json", "parquet"):
        rows.write.format(kind).save(path)
    else:
        raise ValueError(f"no writer for files ending in .{kind}")


def matcher_input(rows: DataFrame) -> DataFrame:
    """Those columns that an outside matcher reads, if there are any; else all."""
    want = ("source_id", "place_name", "place_name_normalized", "language")
    return rows.select(*([c for c in want if c in rows.columns] or rows.columns))
