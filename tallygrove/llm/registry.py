"""Queries that apply each operator to its whole table, and their SQL where it can be said in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from ..session import shared_dir
from . import bpe, chat, grammar, lm, packing, phrases, quality, simhash, sql, substring, suffix, toxicity, trie, vectors
from .rows import documents


#: What conversation -1 says in both of its turns.
SAID = "<|im_end|><|im_start|>assistant ok"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", SAID), (-1, 1, "assistant", SAID)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(rows.unionByName(more)))


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(documents(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.components(documents(spark, sf_dir))
    return got.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op4_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    grammar.write(documents(spark, sf_dir), to, end_id=2)
    return grammar.read(spark, to, with_ids=False)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    machine = toxicity.fit(docs, documents(spark, sf_dir, "labels"), F.crc32(F.col("_id").cast("string")) % 5 != 0)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    got = toxicity.score(docs, machine)
    return got.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = packing.pack(documents(spark, sf_dir), size=1024, end_id=0)
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.counts(documents(spark, sf_dir))


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(documents(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(documents(spark, sf_dir).select("doc_id", "text"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(*trie.rebuilt(trie.turns_of(documents(spark, sf_dir, "conversations"))))


def op13_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.counts(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return named | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """SQL can't express the others; the tests hold each query against a plain version."""
    return sql.ORACLE_SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
