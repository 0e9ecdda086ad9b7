"""Identity merges, versions, numbers and ids against plain versions."""

import json
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tallygrove.operators import identity, numbering
from tallygrove.sources import versions


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_follow_chains(spark):
    rnd = random.Random(1)
    merges = [(f"a{k}", f"a{k + 1}", k) for k in range(40)] + [("x", "y", 1), ("y", "x", 2), ("w", "x", 3), ("p", "q", 5), ("p", "r", 4), ("s", "s", 1), ("", "q", 1), (None, "q", 2)]
    merges += [(f"t{k}", f"t{rnd.randrange(k)}", 100 - k) for k in range(1, 60)]
    got = {r.loser: (r.survivor, r.cyclic) for r in identity.follow(spark.createDataFrame(merges, "loser string, survivor string, n long")).collect()}
    to = {}
    for a, b, n in sorted((m for m in merges if m[0] and m[0] != m[1]), key=lambda m: m[2]):
        to.setdefault(a, b)
    want = {}
    for a in to:
        at, seen = a, set()
        while at in to and at not in seen:
            seen.add(at)
            at = to[at]
        want[a] = (None, True) if at in to else (at, False)
    assert got == want and got["w"] == (None, True) and got["p"] == ("r", False)


CARD = ["db_id", "parent_db_id", "linked_cluster_ids", "confirmed_locations", *identity.COLUMNS, "reviewer_notes", *identity.FLAGS, "reviewer", "reviewed_at"]


def card(db_id, **x):
    return {c: "" for c in CARD} | {"db_id": db_id} | x


def locations(r):
    try:
        got = json.loads(r["confirmed_locations"] or "")
        if isinstance(got, list) and got:
            return got
    except ValueError:
        pass
    one = dict(zip(identity.FIELDS, [r[c] or "" for c in identity.COLUMNS], strict=True))
    return [one] if any(v.strip() for v in one.values()) else []


def one_by_one(cards, merges):
    """The merges applied one after the other, each pair by the rules for two cards."""
    cards = {r["db_id"]: dict(r) for r in cards}
    for loser, survivor, _ in sorted(merges, key=lambda m: m[2]):
        s, x = cards[survivor], cards.pop(loser)
        s["linked_cluster_ids"] = "|".join(dict.fromkeys(v.strip() for c in (s, x) for v in c["linked_cluster_ids"].split("|") if v.strip()))
        both = {}
        for p in locations(s) + locations(x):
            both.setdefault(((p.get("settlement") or "").strip(), (p.get("address") or "").strip()), p)
        if both:
            places = list(both.values())
            s["confirmed_locations"] = json.dumps(places)
            s.update({c: places[0].get(f) or "" for c, f in zip(identity.COLUMNS, identity.FIELDS, strict=True)})
        for c in identity.COLUMNS:
            s[c] = s[c] if s[c].strip() else x[c]
        note = x["reviewer_notes"].strip()
        if note:
            tag = f"[merged from db_id {loser}] {note}"
            s["reviewer_notes"] = f"{s['reviewer_notes'].strip()}\n---\n{tag}" if s["reviewer_notes"].strip() else tag
        for c in identity.FLAGS:
            s[c] = "TRUE" if x[c] == "TRUE" else s[c]
        s.update(reviewer="me", reviewed_at="now")
        for r in cards.values():
            r["parent_db_id"] = survivor if r["parent_db_id"] == loser else r["parent_db_id"]
    return cards


def test_merge_authorities(spark):
    place = lambda s, a="": {"settlement": s, "address": a, "lat": "1"}
    cards = [
        card("1", linked_cluster_ids="C1|C2", reviewer_notes="one", confirmed_locations=json.dumps([place("Wilna"), place("Kowno", "x")])),
        card("2", linked_cluster_ids="C2 | C3", reviewer_notes=" two ", confirmed_locations="[broken", confirmed_settlement="Lodz", is_generic="TRUE"),
        card("3", linked_cluster_ids="C4||C1", reviewer_notes="three", confirmed_settlement="Riga", confirmed_address="Street", lat="5"),
        card("8", confirmed_address="Lane", confirmed_settlement="Pinsk", lon="3"), card("9", confirmed_locations=json.dumps([place("Pinsk")]), is_generic="FALSE"),
        card("4", linked_cluster_ids="", is_exploded="FALSE"),
        card("5", linked_cluster_ids="C9", confirmed_locations=json.dumps([place("Wilna"), place("Lodz", "y")]), is_exploded="TRUE"),
        card("6", reviewer_notes="alone"), card("1_X00", parent_db_id="1"), card("3_X01", parent_db_id="3"), card("6_X00", parent_db_id="6"),
    ]
    # 1 into 2, 2 into 3, then 5 into 3 and 3 into 4: chains of three
    merges = [("1", "2", 1), ("2", "3", 2), ("5", "3", 3), ("3", "4", 4), ("8", "9", 5)]
    frame = spark.createDataFrame([tuple(c[k] for k in CARD) for c in cards], ", ".join(f"{c} string" for c in CARD))
    core = spark.createDataFrame([(c["db_id"], c["linked_cluster_ids"], "n") for c in cards], "db_id string, linked_cluster_ids string, name string")
    alignment = spark.createDataFrame([("a", "1"), ("b", " 2"), ("c", "4"), ("d", ""), ("e", None), ("f", "99")], "cluster_id string, aligned_db_id string")
    extra = [("7", "404", 9), ("u", "v", 1), ("v", "u", 2)]  # no such survivor; a cycle
    got = identity.merge_authorities(frame, alignment, core, spark.createDataFrame(merges + extra, "loser string, survivor string, n long"), "me", "now")
    left = {r["db_id"]: r.asDict() for r in got["cards"].collect()}
    want = one_by_one(cards, merges)
    assert set(left) == set(want)
    for k, w in want.items():
        assert {c: v for c, v in left[k].items() if c != "confirmed_locations"} == {c: v for c, v in w.items() if c != "confirmed_locations"}, k
        assert [(p.get("settlement") or "", p.get("address") or "") for p in locations(left[k])] == [(p.get("settlement") or "", p.get("address") or "") for p in locations(w)]
    assert rows(got["alignment"]) == sorted([("a", "4", True), ("b", "4", True), ("c", "4", False), ("d", "", False), ("e", None, False), ("f", "99", False)], key=repr)
    linked = {r.db_id: r.linked_cluster_ids for r in got["core"].collect()}
    assert linked["4"] == "C4|C1|C2|C3|C9" == left["4"]["linked_cluster_ids"] and "1" not in linked
    assert {r.loser for r in got["chains"].where("cyclic").collect()} == {"u", "v"}
    none = identity.merge_authorities(frame, alignment, core, spark.createDataFrame([], "loser string, survivor string, n long"), "me", "now")
    assert rows(none["cards"]) == rows(frame) and rows(none["core"]) == rows(core)


def test_versions(spark):
    path = f"{tempfile.mkdtemp(prefix='spark-')}/table"
    frame = lambda *r: spark.createDataFrame(list(r), "id string, v long")
    assert versions.versions(spark, path) == []
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, path)
    assert versions.commit(frame(("a", 1), ("b", 2)), path) == 1
    pinned = versions.read_version(spark, path, 1)
    assert versions.append(frame(("b", 9), ("c", 4), ("c", 3), ("", 5), (None, 6)), path, "id", ["v"]) == 2
    assert versions.append(frame(("c", 8)), path, "id", ["v"]) == 2  # again: nothing new
    assert rows(versions.read_version(spark, path)) == [("a", 1), ("b", 2), ("c", 3)] and rows(pinned) == [("a", 1), ("b", 2)]

    fails = F.udf(lambda v: 1 // (v - 2), "long")
    with pytest.raises(Exception, match="ZeroDivision"):  # a writer that dies half-way
        versions.rewrite(spark, path, lambda d: d.withColumn("v", fails("v")))
    assert versions.versions(spark, path) == [1, 2] and rows(versions.read_version(spark, path)) == [("a", 1), ("b", 2), ("c", 3)]
    with pytest.raises(versions.Conflict):
        versions.commit(frame(("z", 0)), path, 1)
    assert versions.rewrite(spark, path, lambda d: d.where("id <> 'a'").withColumn("v", F.col("v") + 1), "up") == 3
    assert versions.named(spark, path, 3)["note"] == "up" and versions.named(spark, path, 3)["base"] == 2
    log = rows(versions.changelog(versions.read_version(spark, path, 2), versions.read_version(spark, path), "id"))
    assert log == [("a", "removed", "v", "1", None), ("b", "changed", "v", "2", "3"), ("c", "changed", "v", "3", "4")]
    wider = versions.read_version(spark, path).withColumn("w", F.lit(None).cast("string"))
    assert rows(versions.changelog(versions.read_version(spark, path), wider, "id")) == []
    assert versions.forget(spark, path, 1) == [1, 2] and rows(versions.read_version(spark, path)) == [("b", 3), ("c", 4)]


def test_numbers_without_one_task(spark):
    rnd = random.Random(6)
    some = [(rnd.randrange(10**6), k) for k in range(3000)]
    df = spark.createDataFrame(some, "x long, k long").repartition(9)
    got = numbering.numbered(df, [F.desc("x"), "k"])
    assert [(r.x, r.k) for r in sorted(got.collect(), key=lambda r: r.number)] == sorted(some, key=lambda v: (-v[0], v[1]))
    assert sorted(r.number for r in got.collect()) == list(range(1, 3001))
    plan = df.repartitionByRange(F.desc("x"), "k").sortWithinPartitions(F.desc("x"), "k")._jdf.queryExecution().toString() + got._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
    assert numbering.numbered(df.limit(0), ["x"]).count() == 0
    ids = numbering.cluster_ids(spark.createDataFrame([("b", 7), ("a", 9), ("b", 2), (None, 1), ("c", 30)], "c string, rid long"), "c", "rid")
    assert {r.c: r.cluster_id for r in ids.collect()} == {None: "ORG-C00001", "b": "ORG-C00002", "a": "ORG-C00003", "c": "ORG-C00004"}
    pairs = numbering.pair_ids(spark.createDataFrame([(1, 2, 0.8), (1, 3, 0.9), (0, 4, 0.8)], "i long, j long, s double"), "s", ["i", "j"])
    assert {(r.i, r.j): r.pair_id for r in pairs.collect()} == {(1, 3): "PAIR-00001", (0, 4): "PAIR-00002", (1, 2): "PAIR-00003"}


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_places_survive_partitions(spark, kind):
    path = f"{tempfile.mkdtemp(prefix='spark-')}/t"
    for k in range(3):
        spark.range(k * 50, k * 50 + 50).selectExpr("cast(id as string) as id").coalesce(1).write.option("header", True).mode("append").format(kind).save(path)
    seen = []
    try:
        for parts in (1, 4, 16):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(4000 // parts))
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            read = spark.read.option("header", True).option("multiLine", True).format(kind).load(path)
            seen.append({r.id: r._rid for r in numbering.with_ordinal(read).collect()})
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1] == seen[2] and sorted(seen[0].values()) == list(range(150))
    for k in range(3):
        own = [seen[0][str(x)] for x in range(k * 50, k * 50 + 50)]
        assert own == list(range(own[0], own[0] + 50))


def test_merge_pairs(spark):
    names = ["pair_id", "cluster_id_i", "cluster_id_j", "name_i", "name_j", "similarity", "decision", "reviewer_notes", "reviewer", "reviewed_at"]
    old = [("PAIR-00001", "a", "b", "A", "B", "0.9", "", "", "", ""), ("P7", "c", "d", "", "", "1.00", "SPLIT", "n", "x", "y"), ("P8", "d", "c", "", "", "1.00", "", "", "", ""), ("P10x", "e", "f", "", "", "", "", "", "", "")]
    df = spark.createDataFrame(old, ", ".join(f"{c} string" for c in names))
    wanted = spark.createDataFrame([(1, "b", "a", "B", "A"), (2, "a", "z", "A", "Z"), (3, "z", "a", "Z", "A"), (4, "d", "c", "", ""), (5, "q", "q", "", ""), (6, "a", "y", "A", "Y")], "n long, cluster_id_i string, cluster_id_j string, name_i string, name_j string")
    got = {r.pair_id: tuple(r)[1:] for r in numbering.merge_pairs(df, wanted, ["n"], "note", "me", "now").collect()}
    stamp = ("MERGE", "note", "me", "now")
    assert got == {
        "PAIR-00001": ("a", "b", "A", "B", "0.9", *stamp), "P7": ("c", "d", "", "", "1.00", *stamp), "P8": old[2][1:], "P10x": old[3][1:],
        "P9": ("a", "z", "A", "Z", "1.00", *stamp), "P10": ("a", "y", "A", "Y", "1.00", *stamp),
    }
