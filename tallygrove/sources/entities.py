"""Entity and corpus files, of which some may be broken: what can be read, and a table of the files that can't, with reasons."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import squeeze, text

#: An entity as its service gives it; values of claims stay text, as some are objects and some are not.
CLAIMS = "map<string, array<struct<mainsnak: struct<datavalue: struct<value: string>>>>>"
ENTITY = f"struct<labels: map<string, struct<value: string>>, claims: {CLAIMS}>"
PAYLOAD = f"entities map<string, {ENTITY}>, _broken string"
XML_ID = "{http://www.w3.org/XML/1998/namespace}id"


def claim_ids(claims: Column, prop: str) -> Column:
    """The ids starting with Q that the claims of a property name, in order; values that are no objects have none."""
    found = F.transform(F.try_element_at(claims, F.lit(prop)), lambda c: F.get_json_object(c["mainsnak"]["datavalue"]["value"], "$.id"))
    return F.coalesce(F.filter(found, lambda x: x.startswith("Q")), F.array().cast("array<string>"))


def whole_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, value) of whole files, the empty ones too, which Spark lists and doesn't read."""
    read = spark.read.text(path, wholetext=True)
    same = F.regexp_replace("path", "^file:/+", "file:/")  # local paths are written in two ways
    rows = read.select(F.col("_metadata.file_path").alias("path"), "value").withColumn("path", same)
    listed = spark.createDataFrame([(f,) for f in read.inputFiles()], "path string").withColumn("path", same)
    return rows.unionByName(listed.join(rows.select("path"), "path", "left_anti").withColumn("value", F.lit("")))


def read_entity_files(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """((qid, label_en, label_yi, p31, p17, p131), (path, reason)) of entity payloads, one JSON object a file.

    A file is in the second table if it is blank, is no JSON or not of the right shape, or has no entities; each file is in one
    of them. An entity that is null, as for an id that the service doesn't know, gives a row there with its id as reason.
    """
    parsed = whole_files(spark, path).withColumn("_p", F.from_json("value", PAYLOAD, {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}))
    entities = F.col("_p.entities")
    size = F.coalesce(F.size(entities), F.lit(0))
    reason = F.when(F.trim(text("value")) == "", "blank").when(F.col("_p").isNull() | F.col("_p._broken").isNotNull(), "broken").when(size < 1, "no entities")
    told = parsed.withColumn("reason", reason)
    each = told.where("reason is null").select("path", F.explode(entities).alias("qid", "e"))
    known = F.col("e").isNotNull() & F.coalesce(F.col("e.labels").isNotNull() | F.col("e.claims").isNotNull(), F.lit(False))
    label = lambda x: F.try_element_at(F.col("e.labels"), F.lit(x))["value"]
    rows = each.where(known).select("qid", label("en").alias("label_en"), label("yi").alias("label_yi"), *[claim_ids(F.col("e.claims"), p).alias(p.lower()) for p in ("P31", "P17", "P131")])
    bad = told.where("reason is not null").select("path", "reason").unionByName(each.where(~known).select("path", F.concat(F.lit("no entity "), "qid").alias("reason")))
    return rows, bad


def with_label_lists(entities: DataFrame) -> DataFrame:
    """entities with p31_labels, p17_labels and p131_labels: the English label of each id that they name, or the id itself where there is none."""
    known = entities.groupBy(F.col("qid").alias("_id")).agg(F.min("label_en").alias("_label"))
    out = entities
    for p in ("p31", "p17", "p131"):
        each = out.select("qid", F.posexplode(p).alias("_at", "_id")).distinct().join(known, "_id", "left")
        put = each.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("_at", F.coalesce(F.nullif("_label", F.lit("")), "_id").alias("x")))).alias("_all"))
        out = out.join(put.select("qid", F.transform("_all", lambda s: s["x"]).alias(f"{p}_labels")), "qid", "left").withColumn(f"{p}_labels", F.coalesce(f"{p}_labels", F.array().cast("array<string>")))
    return out


def read_corpus(spark: SparkSession, path: str | list[str], names: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """((file, xml_id, entry), (path, reason)): the text of every `div` with an xml:id, white space squeezed, and files that aren't XML.

    names gives files (by their last name) the names that other tables know them by; with it, files that it doesn't list
    are left out. A file is parsed once, by the task that reads it; blank texts give null entries. An id that a file
    repeats counts once, at its first place.
    """

    def parse(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for where, file, value in zip(b["path"], b["file"], b["value"], strict=True):
                try:
                    root = ElementTree.fromstring(value)
                except (ElementTree.ParseError, ValueError) as e:
                    rows.append((where, file, None, None, f"broken: {e}"))
                    continue
                seen = set()
                for div in root.iter():
                    if isinstance(div.tag, str) and div.tag.rsplit("}", 1)[-1] == "div" and (name := div.get(XML_ID)) and name not in seen:
                        seen.add(name)
                        rows.append((where, file, name, " ".join("".join(div.itertext()).split()) or None, None))
            yield pd.DataFrame(rows, columns=["path", "file", "xml_id", "entry", "reason"])

    file = F.element_at(F.split("path", "/"), -1)
    whole = whole_files(spark, path).withColumn("file", file)
    if names is not None:
        known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
        whole = whole.withColumn("file", F.try_element_at(known, F.col("file"))).where("file is not null")
    parsed = whole.mapInPandas(parse, "path string, file string, xml_id string, entry string, reason string")
    return parsed.where("xml_id is not null").select("file", "xml_id", squeeze(F.col("entry")).alias("entry")), parsed.where("reason is not null").select("path", "reason")
