"""Clusters of names with a conflict rule, and the pairs left for a reviewer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .resolve import blocked_pairs, clusters


def two_phase(
    rows: DataFrame, rid: str, value: str, block: Sequence[str], name: str, place: str, merge_at: float = 0.92, review_at: float = 0.80
) -> tuple[DataFrame, DataFrame]:
    """(rows with `cluster`, pairs for review). Blank names match nothing; a blank place conflicts with none.

    First, rows with the same non-blank `value` are one group. Then the first row of each group in each block is
    compared with the others of its block by trigram similarity of normalised names: pairs of merge_at or more whose
    places don't differ link their groups, and links carry over. cluster is the smallest rid linked.

    Pairs for review are those of review_at or more below merge_at, and those above it whose places differ: for each
    two names, in whatever order and block, the pair of the highest similarity, of equals the one seen first (by its block's first
    row, then the rows). They carry both rows, names and clusters, and whether their places differ.

    No pairs of rows are formed within a name: rows of a name and place hang on the first of them, and of each name's
    places only the first two can be the earliest that differ from another's.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    slim = rows.select(F.col(rid).alias("rid"), F.when(~blank(value), F.trim(value)).alias("value"), *[F.col(c).alias(f"_b{k}") for k, c in enumerate(block)], F.col(name).alias("name"), F.coalesce(F.trim(place), F.lit("")).alias("place"))
    b = [f"_b{k}" for k in range(len(block))]
    same = slim.where("value is not null").groupBy("value").agg(F.min("rid").alias("_root"))
    slim = written(slim.join(same, "value", "left").withColumn("root", F.coalesce("_root", "rid")).drop("_root"), "grouped")
    # null parts of a block are equal to each other
    packed = F.to_json(F.struct(*b), {"ignoreNullFields": "false"})
    first = slim.withColumn("block", packed).groupBy("block", "root").agg(F.min_by(F.struct("rid", "name", "place"), "rid").alias("r"))
    first = written(first.select("block", "r.*").where(~blank("name")), "first")
    starts = slim.withColumn("block", packed).groupBy("block").agg(F.min("rid").alias("start"))

    near = blocked_pairs(first, ["block"], "name", "rid", review_at)
    near = written(near.join(first.select(F.col("rid").alias("rid_i"), "block"), "rid_i").select("block", "name_i", "name_j", "similarity"), "near")
    variants = written(first.groupBy("block", "name", "place").agg(F.min("rid").alias("v")), "variants")
    side = lambda d, k, *keep: d.select("block", F.col("name").alias(f"name_{k}"), *[F.col(c).alias(f"{c}_{k}") for c in keep])

    # links: rows of a variant with its first, the variant without a place with all of its name, and over near names alike
    links = first.join(variants, ["block", "name", "place"]).select("rid", "v")
    bare = variants.where("place = ''").select("block", "name", F.col("v").alias("bare"))
    links = links.union(variants.join(bare, ["block", "name"]).select("v", "bare"))
    close = near.where(F.col("similarity") >= merge_at)
    i, j = side(variants, "i", "place", "v"), side(variants, "j", "place", "v")
    met = close.join(i, ["block", "name_i"]).join(j.withColumnRenamed("place_j", "place_i"), ["block", "name_j", "place_i"])
    links = links.union(met.select("v_i", "v_j"))
    for p, q in ("ij", "ji"):  # a bare name with every variant of the other
        open_ = close.join(side(bare, p, "bare"), ["block", f"name_{p}"]).join(side(variants, q, "v"), ["block", f"name_{q}"])
        links = links.union(open_.select(f"bare_{p}", f"v_{q}"))
    groups = slim.where("rid <> root").select("rid", "root")
    found = clusters(slim.select("rid"), "rid", groups.union(links).toDF("rid_i", "rid_j")).select("rid", "cluster")
    found = written(found, "clusters")

    # for review: near names by their first rows; names of merge_at or more by the first rows whose places differ
    named = first.groupBy("block", "name").agg(F.min("rid").alias("v"), F.min_by("place", "rid").alias("place"))
    below = near.where(F.col("similarity") < merge_at).join(side(named, "i", "v", "place"), ["block", "name_i"]).join(side(named, "j", "v", "place"), ["block", "name_j"])
    differ = (F.col("place_i") != "") & (F.col("place_j") != "") & (F.col("place_i") != F.col("place_j"))
    told = variants.where("place <> ''")
    one = told.groupBy("block", "name").agg(F.min(F.struct("v", "place")).alias("p1"))
    two = told.join(one, ["block", "name"]).where("place <> p1.place").groupBy("block", "name").agg(F.min(F.struct("v", "place")).alias("p2"))
    early = one.join(two, ["block", "name"], "left")
    twins = early.where("p2 is not null").select("block", F.col("name").alias("name_i"), F.col("name").alias("name_j"), F.lit(1.0).alias("similarity"), F.col("p1.v").alias("v_i"), F.col("p2.v").alias("v_j"))
    both = close.join(side(early, "i", "p1", "p2"), ["block", "name_i"]).join(side(early, "j", "p1", "p2"), ["block", "name_j"])
    pair = lambda p, q: F.when(F.col(f"{p}.place") != F.col(f"{q}.place"), F.struct(F.least(f"{p}.v", f"{q}.v").alias("lo"), F.greatest(f"{p}.v", f"{q}.v").alias("hi"), F.col(f"{p}.v").alias("v_i"), F.col(f"{q}.v").alias("v_j")))
    best = F.array_min(F.array_compact(F.array(pair("p1_i", "p1_j"), pair("p1_i", "p2_j"), pair("p2_i", "p1_j"))))
    apart = both.withColumn("best", best).where("best is not null").select("block", "name_i", "name_j", "similarity", "best.v_i", "best.v_j")
    every = below.select("block", "name_i", "name_j", "similarity", "v_i", "v_j", differ.alias("conflict"))
    every = every.union(twins.union(apart).withColumn("conflict", F.lit(True)))
    every = every.join(starts, "block")
    flip = F.col("v_i") > F.col("v_j")
    ordered = every.select(
        F.least("name_i", "name_j").alias("_lo"), F.greatest("name_i", "name_j").alias("_hi"),
        F.struct(
            (-F.col("similarity")).alias("s"), "start", F.least("v_i", "v_j").alias("rid_i"), F.greatest("v_i", "v_j").alias("rid_j"),
            F.when(flip, F.col("name_j")).otherwise(F.col("name_i")).alias("name_i"), F.when(flip, F.col("name_i")).otherwise(F.col("name_j")).alias("name_j"), "similarity", "conflict",
        ).alias("p"),
    )
    pairs = ordered.groupBy("_lo", "_hi").agg(F.min("p").alias("p")).select("p.rid_i", "p.rid_j", "p.name_i", "p.name_j", "p.similarity", "p.conflict")
    for k in "ij":
        pairs = pairs.join(found.select(F.col("rid").alias(f"rid_{k}"), F.col("cluster").alias(f"cluster_{k}")), f"rid_{k}")
    out = rows.join(found.withColumnRenamed("rid", "_rid"), rows[rid] == F.col("_rid"), "left").drop("_rid")
    return out, pairs
