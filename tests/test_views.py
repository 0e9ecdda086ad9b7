"""Reviewers' views on odd rows, and candidates of the prefix filters."""

import random

from pyspark.sql import functions as F

from tallygrove.functions import text as T
from tallygrove.operators import resolve as R
from tallygrove.operators import views


def test_samples(spark):
    data = [("a", "f", "1", "s", None, 1), ("a", "f", "1", "s", None, 2), ("a", "", " ", "s", "", 3), ("a", None, None, "", "h", 4), ("a", "f", "", " ", "", 5), ("a", "f", "2", "", "h", 6), (" ", "f", "9", "s", "h", 7), (None, "f", "9", "s", "h", 8), ("b", "f", "1", "s", "", 9)]
    df = spark.createDataFrame(data, "c string, file string, entry string, sentence string, heading string, n long")
    take = lambda k: sorted(r.n for r in views.samples(df, ["c"], "file", "entry", ["sentence", "heading"], ["n"], k).collect())
    assert take(None) == [1, 3, 4, 6, 9] and take(2) == [1, 3, 9] and views.samples(df.limit(0), ["c"], "file", "entry", ["sentence"], ["n"]).count() == 0


def test_lists(spark):
    df = spark.createDataFrame([("1", "ALIGN", "Troupe"), ("2", " ", "theatre"), ("3", None, None), ("4", "NEW", " Theatre ")], "id string, decision string, org_type string")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(views.visible(df)) == ["1", "2", "3", "4"] == ids(views.visible(df, "All")) and ids(views.visible(df, "Undecided")) == ["2", "3"]
    assert ids(views.visible(df, "NEW")) == ["4"] and ids(views.visible(df, types=["THEATRE"])) == ["2", "4"] and ids(views.visible(df, part="oup")) == ["1"]
    assert views.find_column(df, "org_") == "org_type" and views.find_column(df, "zz") is None
    assert df.where(views.has_context(df)).count() == 3 and df.where(views.has_context(df.select("id"))).count() == 0
    empty = views.facets(spark.createDataFrame([], "geo_status string")).first()
    assert empty.showing == 0 and empty.reviewed_ratio is None
    words = spark.createDataFrame([("1", "Wilner טרופּע", "ווילנע", None), ("2", "other", None, "Kowno"), ("3", None, "ווילנע", "")], "id string, nm string, a string, b string")
    found = lambda *x, **y: [r.id for r in views.search(words, "id", ["id"], "nm", ["a", "b"], *x, **y).collect()]
    assert found("טרופע") == ["1"] and found("", "וילנע") == ["1", "3"] and found("", "וילנע", but="1") == ["3"] and found(" ", "") == [] and found("", "kow") == ["2"]
    order = spark.createDataFrame([("10", 1), ("9", 2), ("x", 0), (None, 5), ("9", None)], "k string, n long")
    assert [tuple(r) for r in views.by_number(order, "k", "n").collect()] == [("9", 2), ("9", None), ("10", 1), ("x", 0), (None, 5)]
    links = spark.createDataFrame([(" 5", "c ", " ALIGN"), ("5", "c", "NEW"), ("6", "", "NEW"), (None, "c", "NEW"), ("7", "c", "DEFER")], "aligned_db_id string, cluster_id string, decision string")
    assert [tuple(r) for r in views.linking(links).collect()] == [("5", "c")]


def test_rare_keys_lose_none_and_meet_few(spark):
    rnd = random.Random(11)
    names = sorted({" ".join(rnd.choice(["theatre", "theater", "troupe", "yung", "yunge", "a", "ab", "bine", "folks", "of", "x"]) for _ in range(rnd.randrange(1, 4))) for _ in range(150)} | {f"theatre {k:03d}" for k in range(60)})
    df = spark.createDataFrame([(x,) for x in names], "a string")
    every = df.crossJoin(df.withColumnRenamed("a", "b")).withColumn("s", T.trigram_similarity(F.col("a"), F.col("b")))
    for least in (0.3, 0.6, 0.8):
        want = {(r.a, r.b) for r in every.where(F.col("s") >= least).collect()}
        got = {(r.a, r.b) for r in R.near_names(df, df.withColumnRenamed("a", "b"), "a", "b", least).collect()}
        assert got == want
    pairs = lambda keys: keys.join(keys.withColumnRenamed("a", "b"), "key").select("a", "b").distinct().count()
    shared = pairs(df.select("a", F.explode(T.trigrams(F.col("a"))).alias("key")))
    assert pairs(R.rare_keys(df, [], "a", 0.8)) < 0.4 * shared  # the word that half of them share brings few together
    plain = df.where("a like 'theatre ___'")
    assert pairs(R.rare_keys(plain, [], "a", 0.8)) < 0.35 * pairs(plain.select("a", F.explode(T.trigrams(F.col("a"))).alias("key")))
