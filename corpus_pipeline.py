"""The corpus pipeline: stages over documents, each applied to all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns documents' columns, but the last, which returns packed pieces. run()
writes what each returns as Parquet to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.llm import packing, quality, simhash, suffix, toxicity
from tallygrove.llm.rows import documents
from tallygrove.session import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine, fitted on the labelled documents of sf_dir, doesn't find toxic (operator 5)."""
    return toxicity.keep(docs, documents(spark, sf_dir, "labels"), learn_from=documents(spark, sf_dir))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio (operator 9)."""
    return quality.keep(docs, documents(spark, sf_dir, "labels"), labelled=documents(spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group with near fingerprints (operator 3) or a similarity of 0.8 or more of five-word shingles."""
    return simhash.one_of_each(docs, width=5, alike=True)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without what repeats elsewhere over 200 bytes or more (operator 7); n_chars follows the text."""
    return suffix.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with the digest of their ids (operator 6)."""
    got = packing.pack(docs, size=1024, end_id=0)
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("simhash", drop_near_copies),
    ("suffix", cut_repeats),
    ("packing", pack),
]

#: No stage but the last can be said in SQL; the tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
