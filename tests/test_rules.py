"""Readers of files that may be broken, clusters with conflicts, audits from rules, packed cells, merges by rules and samples, on odd rows."""

import json
import random
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallygrove.functions import text as T
from tallygrove.operators import audit, decisions, matching, merge, packed, places
from tallygrove.operators import resolve as R
from tallygrove.sources import entities


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_entity_files(spark):
    top = Path(tempfile.mkdtemp(prefix="spark-"))
    claim = lambda v: {"mainsnak": {"datavalue": {"value": v}}}
    good = {"entities": {"Q1": {"labels": {"en": {"value": "One"}, "yi": {"value": "איינס"}}, "claims": {"P31": [claim({"id": "Q5"}), claim("text"), {"mainsnak": {}}, claim({"id": "P9"}), claim({"id": "Q4"})], "P18": [claim("x.jpg")]}}}}
    files = {"a.json": json.dumps(good), "b.json": '{"entities": {', "c.json": "  ", "d.json": '{"entities": {}}', "e.json": "[1, 2]", "f.json": '{"entities": {"Q7": null}}', "g.json": json.dumps({"entities": {"Q5": {"labels": {}, "claims": {}}, "Q4": {"labels": {"en": {"value": "Four"}}}}})}
    for k, v in files.items():
        (top / k).write_text(v)
    found, bad = entities.read_entity_files(spark, str(top))
    assert rows(found) == sorted([("Q1", "One", "איינס", ["Q5", "Q4"], [], []), ("Q5", None, None, [], [], []), ("Q4", "Four", None, [], [], [])], key=repr)
    assert {r.path.rsplit("/", 1)[-1]: r.reason for r in bad.collect()} == {"b.json": "broken", "c.json": "blank", "d.json": "no entities", "e.json": "broken", "f.json": "no entity Q7"}
    labelled = {r.qid: r.p31_labels for r in entities.with_label_lists(found).collect()}
    assert labelled == {"Q1": ["Q5", "Four"], "Q5": [], "Q4": []}


def test_corpus_files(spark):
    top = Path(tempfile.mkdtemp(prefix="spark-"))
    tei = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><div xml:id="a">one  <p>two\n</p><div xml:id="b">three</div></div><div xml:id="c"> </div><div>no</div><div xml:id="a">again</div></text></TEI>'
    for k, v in {"x.xml": tei, "y.xml": "<TEI><div", "z.xml": "", "w.xml": tei}.items():
        (top / k).write_text(v)
    found, bad = entities.read_corpus(spark, str(top), {"x.xml": "x.json", "y.xml": "y.json", "z.xml": "z.json"})
    assert rows(found) == [("x.json", "a", "one two three"), ("x.json", "b", "three"), ("x.json", "c", None)]
    assert {r.path.rsplit("/", 1)[-1] for r in bad.collect()} == {"y.xml", "z.xml"} and all(r.reason.startswith("broken") for r in bad.collect())
    assert entities.read_corpus(spark, str(top))[0].count() == 6


def plain_two_phase(data, sim, high, low):
    """Every pair of every block's representatives. data: (rid, value, block, name, place)."""
    root = {}
    for rid, value, *_ in sorted(data):
        root[rid] = min((r for r, v, *_ in data if v and v == value), default=rid) if value else rid
    seen, blocks = set(), {}
    for rid, _, block, name, place in sorted(data):
        if (block, root[rid]) not in seen:
            seen.add((block, root[rid]))
            blocks.setdefault(block, []).append((rid, name, place or ""))
    starts = {b: min(r for r, _, x, *_ in data if x == b) for b in blocks}
    links, best = [(r, x) for r, x in root.items()], {}
    for b in sorted(blocks, key=starts.get):
        for i, (ri, ni, pi) in enumerate(blocks[b]):
            for rj, nj, pj in blocks[b][i + 1 :]:
                if not ni or not nj:
                    continue
                s, conflict = sim[ni, nj], bool(pi and pj and pi != pj)
                if s >= high and not conflict:
                    links.append((ri, rj))
                elif s >= low:
                    key = tuple(sorted((ni, nj)))
                    if key not in best or s > best[key][4]:
                        best[key] = (ri, rj, ni, nj, s, conflict)
    to = {r: r for r in root}
    for _ in range(len(to)):
        for a, z in links:
            to[a] = to[z] = min(to[a], to[z])
    return to, best


def test_two_phase(spark):
    rnd = random.Random(12)
    names = ["red ring", "red rings", "red rinse", "blue bolt", "blue bolts", "bolt blue", "", "ab", "ab cd"]
    data = [(k, rnd.choice([None, None, None, "", "v1", "v2"]), rnd.choice(["b1", "b2", None]), rnd.choice(names), rnd.choice([None, "", "ny", "wa", "lo"])) for k in range(90)]
    data += [(200, None, "c", "same name", "ny"), (201, None, "c", "same name", ""), (202, None, "c", "same name", "wa"), (300, None, "d", "same words", "ny"), (301, None, "d", "same words", "wa")]
    df = spark.createDataFrame(data, "rid long, value string, block string, name string, place string").repartition(5)
    both = [(a, b) for a in {d[3] for d in data} for b in {d[3] for d in data}]
    sim = {(r.a, r.b): r.s for r in spark.createDataFrame(both, "a string, b string").select("a", "b", T.trigram_similarity(F.col("a"), F.col("b")).alias("s")).collect()}
    for high, low in ((0.7, 0.3), (0.92, 0.8)):
        to, best = plain_two_phase(data, sim, high, low)
        out, pairs = matching.two_phase(df, "rid", "value", ["block"], "name", "place", high, low)
        assert {r.rid: r.cluster for r in out.collect()} == to
        got = {(r.rid_i, r.rid_j, r.name_i, r.name_j, r.similarity, r.conflict) for r in pairs.collect()}
        assert got == set(best.values())
        assert all(r.cluster_i == to[r.rid_i] and r.cluster_j == to[r.rid_j] for r in pairs.collect())
    assert to[200] == to[201] == to[202] and to[300] != to[301]  # a bare name joins two places; a conflict keeps two apart
    none, no = matching.two_phase(df.limit(0), "rid", "value", ["block"], "name", "place")
    assert none.count() == 0 and no.count() == 0


def test_audit_rules(spark):
    for bad, word in (({"flag": {}}, "flag"), ({"flags": {"very_short": 3}}, "flags.very_short"), ({"flags": {"very_short_threshold": True}}, "whole number"), ({"required_columns": "place"}, "list")):
        with pytest.raises(ValueError, match=word):
            audit.settings(bad)
    path = f"{tempfile.mkdtemp(prefix='spark-')}/rules.yaml"
    Path(path).write_text('source_place_column: town\nrequired_columns: [town, id]\nflags:\n  suspicious_characters_regex: "[^\\\\w\\\\s\\\\-]"\n  very_short_threshold: 3\n')
    rules = audit.load_rules(spark, path)
    assert rules["flags"]["duplicate_exact"] is True and rules["normalization"]["trim_whitespace"] is True
    data = [(1, " New\t York "), (2, "New York"), (3, None), (4, ""), (5, "abc"), (6, "Łódź-2"), (7, "a_b?c"), (8, "שלום")]
    df = spark.createDataFrame(data, "id long, town string")
    got = {r.id: (r.place_name_normalized, r.flag_empty_place_name, r.flag_duplicate_exact, r.flag_very_short, r.flag_suspicious_characters, r.needs_review) for r in audit.audit(df, rules).collect()}
    assert got == {
        1: ("New York", False, True, False, False, True), 2: ("New York", False, True, False, False, True), 3: ("", True, True, True, False, True), 4: ("", True, True, True, False, True),
        5: ("abc", False, False, True, False, True), 6: ("Łódź-2", False, False, False, False, False), 7: ("a_b?c", False, False, False, True, True), 8: ("שלום", False, False, False, False, False),
    }
    off = audit.settings({"source_place_column": "town", "required_columns": [], "normalization": {"collapse_internal_spaces": False}, "flags": {"empty_place_name": False, "duplicate_exact": False, "very_short_threshold": -1}})
    plain = audit.audit(df, off)
    assert plain.where("needs_review").count() == 0 and plain.where("id = 1").first().place_name_normalized == "New\t York"
    with pytest.raises(ValueError, match="missing required columns: town"):
        audit.audit(df.drop("town"), rules)
    queue = audit.review_queue(audit.audit(df, rules).withColumnRenamed("id", "source_id"))
    assert queue.columns[:2] == ["source_id", "place_name_normalized"] and queue.columns[-1] == "needs_review" and queue.count() == 6
    assert audit.audit(df.limit(0), rules).count() == 0


def test_packed_cells(spark):
    data = [(1, "a| b||c", "0.9", "x|y"), (2, None, "0.5|0.4", "z"), (3, "b", "", None), (4, "q|a", "1|2|3", "m|n|o")]
    df = spark.createDataFrame(data, "k long, ids string, s string, m string")
    authority = spark.createDataFrame([("a", "A", 1), ("a ", "B", 2), ("b", None, 3)], "id string, name string, n long")
    got = rows(packed.candidates(df, "k", {"id": "ids", "score": "s", "method": "m"}, authority, "id", {"name": "name", "n": "n"}))
    assert got == sorted([
        (1, 0, "a", "0.9", "x", True, "A", "1"), (1, 1, "b", "", "y", True, "", "3"), (1, 2, "c", "", "", False, "(missing)", ""), (3, 0, "b", "", "", True, "", "3"),
        (4, 0, "q", "1", "m", False, "(missing)", ""), (4, 1, "a", "2", "n", True, "A", "1"),
    ], key=repr)
    back = packed.together(packed.zipped(df, "k", {"id": "ids", "score": "s"}), "k", ["id", "score"])
    assert {r.k: (r.id, r.score) for r in back.collect()} == {1: ("a|b|c", "0.9||"), 2: ("|", "0.5|0.4"), 3: ("b", ""), 4: ("q|a|", "1|2|3")}
    seen = spark.createDataFrame([("g", "b", 2), ("g", "a", 3), ("g", "b", 1), ("g", None, 0), (None, "z", 1), ("g", "A", 4)], "g string, v string, n long")
    assert rows(packed.ordered_distinct(seen, ["g"], F.col("v"), ["n"], "vs")) == sorted([("g", ["b", "a", "A"]), (None, ["z"])], key=repr)
    assert {r.g: r.vs for r in packed.ordered_distinct(seen, ["g"], F.col("v"), ["n"], "vs", F.lower("v")).collect()}["g"] == ["b", "a"]


def test_merge_columns(spark):
    kind = "k string, a string, b string, c string, d string"
    old = spark.createDataFrame([("1", "x", "", "p", "q"), ("2", "x", None, "p", "q"), ("", "x", "y", "p", "q"), ("9", "x", "y", "", "q")], kind)
    new = spark.createDataFrame([("1", "n", "B", "P", "Q", 2), ("1", "m", "", "R", "", 1), ("2", "n", "", "p", None, 1), ("5", "n", "b", "c", "d", 1), ("", "l", "l", "l", "l", 1)], kind + ", o long")
    got = rows(merge.merge_columns(old, new, "k", {"a": "keep", "b": "fill", "c": "flag", "d": "take"}, ["o"]))
    assert got == sorted([("1", "x", "B", "p", "Q", "c:R"), ("2", "x", None, "p", "q", ""), ("", "x", "y", "p", "q", ""), ("9", "x", "y", "", "q", ""), ("5", "n", "b", "c", "d", ""), ("", "l", "l", "l", "l", "")], key=repr)
    with pytest.raises(ValueError, match="zap"):
        merge.merge_columns(old, new, "k", {"a": "zap"}, ["o"])


def test_sample_of_the_rest(spark):
    data = [(k, "abcdx"[k % 5] if k % 3 else "d") for k in range(900)]
    df = spark.createDataFrame(data, "rid long, s string")
    take = lambda d: [tuple(r) for r in R.sampled(d, "rid", F.when(F.col("s") != "x", F.col("s")), {"a": 12, "b": 18, "c": 1000, "d": None}, ("rest", 15)).select("rid", "review_stratum").collect()]
    got = take(df)
    assert got == take(df.repartition(13)) == take(df.coalesce(1)) and [r for r, _ in got] == sorted(r for r, _ in got)
    count = {s: sum(x == s for _, x in got) for s in ("a", "b", "c", "d", "rest")}
    assert count == {"a": 12, "b": 18, "c": sum(s == "c" for _, s in data), "d": sum(s == "d" for _, s in data), "rest": 15}
    assert len({r for r, _ in got}) == len(got)


def test_legacy_tables(spark):
    df = spark.createDataFrame([("1", None, True, "x"), ("2", "c", None, "y")], "entry_id string, context string, needs_review boolean, zzz string")
    assert places.unified(df).columns == list(places.UNIFIED) and [r.needs_review for r in places.unified(df).collect()] == [True, False]
    base, queue = places.legacy(df)
    fixed, more = places.legacy(df, corrections=True)
    assert base.columns == list(places.UNIFIED[:-2]) and queue.columns == list(places.QUEUE)
    assert fixed.columns == list(places.UNIFIED) and more.columns == [*places.QUEUE, *places.CORRECTED]
    assert [r.entry_id for r in queue.collect()] == ["1"] and places.review_queue(df).columns == list(places.QUEUE)
    assert places.review_queue(places.unified(df)).columns == [*places.QUEUE, *places.CORRECTED]


def test_mirror(spark):
    data = [("place", "camp", None, ""), ("place", " ", "town", "old"), ("place", "a", "b", None), ("place", "a", "a", ""), ("country", "camp", "", ""), (None, "camp", "", "")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(data)], "k long, source_role string, death_site string, burial_city string, correction_applied string")
    got = {r.k: (r.death_site, r.burial_city, r.correction_applied, r.death_burial_conflict) for r in places.mirror(df).collect()}
    assert got == {0: ("camp", "camp", "death_burial_mirrored", False), 1: ("town", "town", "old", False), 2: ("a", "b", None, True), 3: ("a", "a", "", False), 4: ("camp", "", "", False), 5: ("camp", "", "", False)}
    assert places.mirror(df.drop("correction_applied")).where("k = 0").first().correction_applied == "death_burial_mirrored"


def test_decisions(spark):
    base = spark.createDataFrame([("a", "ALIGN", "1"), ("b", "", ""), ("c", "NEW", "9"), ("d", "x", "y")], "id string, decision string, aligned string")
    log = [("a", "REQUEUE", "5", "t2", 2, "ann"), ("a", "NEW", "7", "t1", 3, "bob"), ("b", "ALIGN", "4", "t1", 1, "ann"), ("b", "DEFER", None, "t1", 2, "bob"), ("zz", "NEW", "1", "t9", 1, "x"), (None, "NEW", "1", "t9", 1, "x"), ("c", None, "8", "t1", 1, "eve")]
    events = spark.createDataFrame(log, "id string, decision string, aligned string, at string, n long, reviewer string")
    got = rows(decisions.decided(base, events, "id", ["aligned"]))
    assert got == sorted([("a", "", "", "ann", "t2"), ("b", "DEFER", "", "bob", "t1"), ("c", "NEW", "8", "eve", "t1"), ("d", "x", "y", "", "")])
    assert rows(decisions.decided(base, events.limit(0), "id", ["aligned"])) == sorted((*r, "", "") for r in rows(base))
    assert decisions.stamped(base, "me", "now").where("reviewer = 'me' and reviewed_at = 'now'").count() == 4
    one, two = spark.createDataFrame([("a", "t"), ("b", None), (None, "q")], "k string, kind string"), spark.createDataFrame([("n", "a", "u"), ("m", "z", "u")], "n string, c string, kind string")
    changes = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "", 1), (None, "w", 1)], "k string, kind string, n long")
    both = decisions.passed_on({"one": (one, "k"), "two": (two, "c")}, changes, "k", "kind", ["n"])
    assert rows(both["one"]) == sorted([("a", "y"), ("b", ""), (None, "q")], key=repr) and rows(both["two"]) == [("m", "z", "u"), ("n", "a", "y")]


def test_linked_alignments(spark):
    from difflib import SequenceMatcher

    rnd = random.Random(8)
    names = ["yung teater", "yung teatr", "folks bine", "", "habima"]
    align = [(f"{k}-x{rnd.randrange(25)}", rnd.choice(names), rnd.choice(["5", "6|7", "x", "", None, " 8 ", "99999999999999999999"])) for k in range(120)]
    held = [(f"x{rnd.randrange(22)}" if rnd.random() < 0.9 else rnd.choice(["", None]), rnd.choice(["C1", "C2", "C3", "", None]), rnd.choice(names), k) for k in range(60)]
    a, m = spark.createDataFrame(align, "uid string, h string, db string"), spark.createDataFrame(held, "x string, c string, nm string, o long").repartition(3)
    links, bad = decisions.linked(a, m, "uid", F.col("h"), "db", "x", "c", F.col("nm"), "o")
    like = lambda p, q: 0.0 if not p or not q else 1.0 if p == q else SequenceMatcher(None, p, q).ratio()
    want, wrong = {}, {}
    for uid, h, db in align:
        first = (db or "").split("|")[0].strip()
        found = [r for r in held if r[0] and r[0] == uid.split("-", 1)[1]]
        scored = sorted(((-like(h, n), o, c) for _, c, n, o in found if c))
        if not (db or "").strip():
            continue
        if not first.isdigit() or int(first) >= 2**63:
            wrong[uid] = "invalid_align_with_db"
        elif not found:
            wrong[uid] = "xml_id_not_found"
        elif not scored:
            wrong[uid] = "no_cluster_id"
        elif len(scored) > 1 and -scored[0][0] < 0.6:
            wrong[uid] = "ambiguous_cluster_match"
        else:
            want[uid] = (int(first), scored[0][2], -scored[0][0])
    assert {r.uid: (r.db_id, r.cluster_id, r.score) for r in links.collect()} == want and {r.uid: r.reason for r in bad.collect()} == wrong
    assert set(wrong.values()) == {"invalid_align_with_db", "xml_id_not_found", "no_cluster_id", "ambiguous_cluster_match"}
    core = decisions.core_table(spark.createDataFrame([("5", " A "), ("6", None), ("q", "no"), ("77", "z")], "id string, name string"), links, "id", ["name"])
    linked = {r.db_id: (r.name, r.linked_cluster_ids) for r in core.collect()}
    assert linked == {5: ("A", " | ".join(sorted({c for d, c, _ in want.values() if d == 5}))), 6: ("", " | ".join(sorted({c for d, c, _ in want.values() if d == 6}))), 77: ("z", "")}


def test_linked_alignments_of_crowded_entries(spark, monkeypatch):
    from difflib import SequenceMatcher

    rnd = random.Random(9)
    names = ["yung teater", "yung teatr", "folks bine", "", None, "habima", "ha", "teater fun yung", "qqq"]
    # 400 alignments and 400 mentions of one entry, some of others; x1 has one cluster of an unlike name, x2 two such, x3 none
    align = [(f"{k}-x0", rnd.choice(names), "5") for k in range(400)] + [(f"{k}-x{1 + k % 30}", rnd.choice(names), "7") for k in range(400, 700)]
    held = [("x0", rnd.choice(["C1", "C2", None]), rnd.choice(names[:5]), k) for k in range(400)] + [(f"x{rnd.randrange(4, 30)}", rnd.choice(["C1", "C2", "C3", ""]), rnd.choice(names), k // 2) for k in range(400, 520)]
    held += [("x1", "C9", "qqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqq", 1), ("x2", "C9", "qqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqq", 2), ("x2", "C8", "zzzz", 1), ("x3", None, "habima", 1)]
    most, write = [], decisions.written

    def counted(df, name="table"):
        got = write(df, name)
        most.append(got.count())
        return got

    monkeypatch.setattr(decisions, "written", counted)
    a, m = spark.createDataFrame(align, "uid string, h string, db string").repartition(3), spark.createDataFrame(held, "x string, c string, nm string, o long").repartition(3)
    links, bad = decisions.linked(a, m, "uid", F.col("h"), "db", "x", "c", F.col("nm"), "o")
    like = lambda p, q: 0.0 if not p or not q else 1.0 if p == q else SequenceMatcher(None, p, q).ratio()
    want, wrong = [], []
    for uid, h, db in align:
        found = [r for r in held if r[0] == uid.split("-", 1)[1]]
        scored = sorted((-like(h, n), o, c) for _, c, n, o in found if c)
        if not scored:
            wrong.append((uid, "no_cluster_id" if found else "xml_id_not_found"))
        elif len(scored) > 1 and -scored[0][0] < 0.6:
            wrong.append((uid, "ambiguous_cluster_match"))
        else:
            want.append((uid, int(db), scored[0][2], -scored[0][0]))
    assert rows(links) == sorted(want, key=repr) and rows(bad) == sorted(wrong, key=repr)
    assert {r[1] for r in wrong} == {"xml_id_not_found", "no_cluster_id", "ambiguous_cluster_match"} and any(0 < r[3] < 0.6 for r in want) and any(r[3] == 0 for r in want) and any(0.6 < r[3] < 1 for r in want)
    assert max(most) <= len(align)  # alignments of an entry don't meet its mentions one by one
