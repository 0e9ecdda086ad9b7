"""Every query with SQL gives the same rows as DuckDB; sources and operators keep their meaning on odd rows."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallygrove.functions import text as T
from tallygrove.operators import resolve as R
from tallygrove.operators import graph
from tallygrove.operators.graph import connected_components
from tallygrove.plans import catalogue as C
from tallygrove.plans import curation  # noqa: F401
from tallygrove.sources import tables


def rows(p):
    p = p[sorted(p.columns)]
    return sorted(map(repr, p.astype(object).where(p.notna(), None).values.tolist())), list(p.columns)


@pytest.mark.parametrize("name", list(C.QUERIES))
def test_query(spark, sf, name):
    got = C.QUERIES[name](spark, sf).toPandas()
    assert len(got.columns)
    if name in C.ORACLE_SQL:
        con = duckdb.connect()
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"):
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        assert rows(got) == rows(con.execute(C.ORACLE_SQL[name]).df())


def test_text_functions(spark):
    names = ["", None, "שלום־עליכם", "בֵּית", "וועלט", "Jiddisches (Wilna)", "Éclair  Théâtre"]
    df = spark.createDataFrame([(x,) for x in names], "x string")
    base, place = T.split_place("x")
    got = df.select(T.normalize_yiddish("x").alias("y"), base.alias("b"), place.alias("p"), T.is_missing("x").alias("m")).collect()
    assert [r.y for r in got] == ["", "", "שלומ־עליכמ", "בית", "ועלט", "jiddisches (wilna)", "eclair theatre"]
    assert (got[5].b, got[5].p) == ("Jiddisches", "Wilna") and [r.m for r in got] == [True, True] + [False] * 5
    q = spark.createDataFrame([("q012|x, Q5;Q12 Q",)], "x string").select(T.qids("x").alias("q")).first().q
    assert q == ["Q12", "Q5"]


def test_blocked_pairs_lose_none(spark):
    import random

    rnd = random.Random(2)
    names = ["".join(rnd.choice("ab ") for _ in range(rnd.randrange(1, 8))).strip() for _ in range(80)]
    df = spark.createDataFrame([(k, "b", x) for k, x in enumerate(names)], "rid long, block string, nm string")
    got = {(r.rid_i, r.rid_j) for r in R.blocked_pairs(df, ["block"], "nm", "rid", 0.6).collect()}
    first = {x: k for k, x in reversed(list(enumerate(names))) if x}
    a = spark.createDataFrame([(i, j, x, y) for x, i in first.items() for y, j in first.items() if i < j], "i long, j long, x string, y string")
    want = {(r.i, r.j) for r in a.where(T.trigram_similarity(F.col("x"), F.col("y")) >= 0.6).collect()}
    assert got == want


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 101), (101, 100), (5, 5), (None, 3), (200, 201)]
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k: 1 for k in range(1, 61)} | {100: 100, 101: 100, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def union_find(edges):
    root = {}

    def of(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((of(a), of(b)))
        root[y] = x
    return {x: of(x) for x in root}


@pytest.mark.parametrize("small", [0, 1000, graph.SMALL])
def test_components_equal_union_find(spark, monkeypatch, small):
    """A shuffled chain, a star, a grid and random edges, settled by rounds alone, by both, and by one task."""
    rnd = random.Random(3)
    chain = rnd.sample(range(10**9), 3000)
    grid = {(x, y): rnd.randrange(2 * 10**9, 3 * 10**9) for x in range(20) for y in range(20)}
    edges = [*zip(chain, chain[1:], strict=False), *((-k, -1) for k in range(2, 500))]
    edges += [(grid[x, y], grid[z]) for x, y in grid for z in ((x + 1, y), (x, y + 1)) if z in grid]
    edges += [(rnd.randrange(4 * 10**9, 4 * 10**9 + 2000), rnd.randrange(4 * 10**9, 4 * 10**9 + 2000)) for _ in range(900)]
    edges = [e for e in edges if e[0] != e[1]]
    monkeypatch.setattr(graph, "SMALL", small)
    got = connected_components(spark.createDataFrame(pd.DataFrame(edges, columns=["src", "dst"])))
    assert {r.vertex: r.component for r in got.collect()} == union_find(edges)


def test_components_of_a_long_chain_and_of_strings(spark):
    ids = random.Random(4).sample(range(10**9), 100_000)
    edges = pd.DataFrame({"src": ids[:-1], "dst": ids[1:]})
    got = connected_components(spark.createDataFrame(edges)).groupBy("component").count().collect()
    assert [tuple(r) for r in got] == [(min(ids), len(ids))]
    named = spark.createDataFrame([("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    assert {r.vertex: r.component for r in connected_components(named).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_ancestors_with_a_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, None)], "node long, parent long")
    assert {(r.node, r.ancestor) for r in R.ancestors(e).collect()} == {(1, 2), (1, 1), (2, 1), (2, 2), (3, 1), (3, 2)}


def test_sources(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('﻿id\tname\n1\t"say ""x""\nnext"\n2\t\n', encoding="utf-8")
    assert [tuple(r) for r in tables.read_tsv(spark, str(tmp_path / "a.tsv")).collect()] == [("1", 'say "x"\nnext'), ("2", "")]
    (tmp_path / "e.json").write_text('{"Q1": {"label_en": "x", "p31": ["Q5"]}}')
    assert tables.read_entities(spark, str(tmp_path / "e.json")).first().p31 == ["Q5"]
    (tmp_path / "v.xml").write_text('<t><div xml:id="d1"> a  <b>c</b>\n</div></t>')
    assert tables.read_entry(spark, str(tmp_path / "v.xml"), "d1").first().entry == "a c"
