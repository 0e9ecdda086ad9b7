"""Classifier, place, card and phonetic operators against plain versions and cases worked by hand."""

from difflib import SequenceMatcher
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tallygrove.functions import records as D
from tallygrove.functions import text as T
from tallygrove.functions.phonetic import codes_of
from tallygrove.operators import mentions, places
from tallygrove.operators import resolve as R
from tallygrove.sources import tables


def test_ratio_join_finds_every_pair(spark):
    names = ["theatre", "theater", "teater", "the tree", "troupe", "troup", "aaaa", "aaa", "aab", "", "x", "צייטונג", "צייטונגען", "😀😀a", "😀😀b"]
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "a string")
    for least in (0.6, 0.8, 0.93):
        got = {(r.a, r.b) for r in R.ratio_join(df, df.toDF("b"), "a", "b", least).collect()}
        assert got == {(x, y) for x in names for y in names if x and y and SequenceMatcher(None, x, y).ratio() >= least}


def test_location_split_against_plain_search(spark):
    rows = [
        (1, 1, "Lodz", "", False), (2, 1, "Lodzh", "", False), (3, 1, "Warsaw", "x", False), (4, 1, "", "x ", False), (5, 1, "Vilna", None, False),
        (6, 2, "Lodz", "", False), (7, 2, "", "", False), (8, 2, "Kiev", "", False), (9, 3, "Lodz", "", True), (10, 3, "Kiev", "", True), (11, None, "Kiev", "", False), (12, 4, "a", "", False),
    ]
    df = spark.createDataFrame(rows, "rid long, c long, town string, venue string, moves boolean")
    got = {r.rid: r.new_cluster for r in R.location_split(df, "rid", "c", F.col("moves"), ["town", "venue"]).collect()}

    def near(a, b):
        pairs = [((x or "").strip().lower(), (y or "").strip().lower()) for x, y in zip(a[2:4], b[2:4], strict=True)]
        return any(x and y and SequenceMatcher(None, x, y).ratio() >= 0.8 for x, y in pairs)

    parts = {k: {k} for k in range(1, 6)}
    for a, b in combinations(rows[:5], 2):
        if near(a, b):
            both = parts[a[0]] | parts[b[0]]
            for k in both:
                parts[k] = both
    order = sorted({min(p) for p in parts.values()})
    want = {k: f"1_S{order.index(min(parts[k])) + 1:02d}" for k in range(1, 6)}
    assert got == want | {6: "2", 7: "2", 8: "2", 9: "3", 10: "3", 11: None, 12: "4"}


@pytest.mark.parametrize("name, codes", [
    ("Auerbach", ["097400", "097500"]), ("Peters", ["734000", "739400"]), ("Moskowitz", ["645740"]), ("Jackson", ["145460", "154600", "445460", "454600"]), ("", []), (None, []), ("שלום", []),
])
def test_phonetic_codes(name, codes):
    assert codes_of(name) == codes


def test_classifier_branches(spark):
    kinds = "org_type string, title string, clustered string, descriptive string, settlement string, venue string"
    rows = [
        ("", "Grand Theater", "", "", "", ""), ("", "Grand Theaters", None, "", "", ""), ("", "", "", "טרופע", "", ""), ("", "", "", "זיין טרופע", "", ""),
        ("", "Jacob Adler", "Adler", "x", "", ""), ("", "Jacob Adler", "", "", "", ""), ("", "", "Adler", "זיין שול", "Lodz", ""), (None, None, None, None, None, None),
    ]
    got = mentions.classify(spark.createDataFrame(rows, kinds).coalesce(1).withColumn("k", F.monotonically_increasing_id()), spark.createDataFrame([("grand theater",), (None,)], "n string"))
    assert [tuple(r) for r in got.orderBy("k").select("name_type", "confidence").collect()] == [
        ("proper_name", "high"), ("proper_name", "high"), ("descriptive_term", "high"), ("descriptive_term", "high"),
        ("proper_name", "high"), ("proper_name", "medium"), ("ambiguous", "low"), ("ambiguous", "low"),
    ]


def place_rows(spark, rows):
    full = [(*r, *[""] * 8) for r in rows]
    names = ["entry_id", "context", "source_role", "qid", "resolved_category", "other_type", "correction_applied", "wikidata_label_en", "clustered_value", "place_qid_conflict", *places.CATEGORIES]
    return spark.createDataFrame(full, ", ".join(f"{n} {'boolean' if n == 'place_qid_conflict' else 'string'}" for n in names))


def test_roles_are_reassigned(spark):
    cases = [
        ("place", "province", "", "", "province"), ("place", "country", "", "", "country"), ("country", "province", "", "", "province"), ("country", "settlement", "", "", "settlement"),
        ("country", "other", "peninsula", "", "other"), ("province", "country", "", "", "country"), ("place", "province", "", "stamped", None), ("province", "settlement", "", "", None),
        ("country", "other", "", "", None), ("country", None, None, None, None),
    ]
    df = place_rows(spark, [(str(k), "birth", r, f"Q{k}", c, o, s, "Label", "", False) for k, (r, c, o, s, _) in enumerate(cases)])
    got = {int(r.entry_id): r for r in places.reassign_role(df, F.lit(False)).collect()}
    for k, (role, _, _, stamp, to) in enumerate(cases):
        assert (got[k].source_role, got[k].correction_applied) == ((to, f"moved_to_{to}") if to else (role, stamp))
    assert got[4].other == "Label" and got[3].settlement == "Label" and got[3].country == ""
    explicit = places.reassign_role(place_rows(spark, [("e", "x", "province", "Q1", "other", "state", "", "Chile", "", False)]), F.lit(True)).first()
    assert (explicit.source_role, explicit.resolved_category, explicit.other_type, explicit.country) == ("country", "country", "", "Chile")


def test_flags_of_rows_and_groups(spark):
    entities = spark.createDataFrame(
        [("Q1", [], ["Q2"], ["city"]), ("Q2", ["Q36"], ["Q1"], ["province"]), ("Q36", ["Q36"], [], ["sovereign state"]), ("Q9", ["Q30"], [], ["country"]), ("Q5", [], [], ["town"])],
        "qid string, p17 array<string>, p131 array<string>, p31_labels array<string>",
    )
    row = lambda e, role, qid, kind, conflict=False: (e, "birth", role, qid, kind, "", "", "", "", conflict)
    rows = [
        row("a", "place", "Q1", "settlement"), row("a", "province", "Q2", "province"), row("a", "country", "Q36", "country"), row("b", "place", "Q1", "settlement", True), row("b", "country", "Q9", "country"),
        row(None, "place", "Q5", "settlement"), row(None, "country", "Q36", "country"), row("c", "place", "Q404", "other"), row("d", "place", "Q5", "settlement"), row("d", "province", "Q2", "province"),
    ]
    got = {(r.entry_id, r.source_role): r.review_flags for r in places.review_flags(place_rows(spark, rows), entities).collect()}
    assert got == {
        ("a", "place"): "", ("a", "province"): "", ("a", "country"): "", ("b", "place"): "place_country_mismatch;place_qid_conflict", ("b", "country"): "", (None, "place"): "place_country_unresolved",
        (None, "country"): "", ("c", "place"): "needs_manual_type_review;qid_lookup_missing", ("d", "place"): "place_province_mismatch", ("d", "province"): "",
    }


def test_states_become_cities_and_places_explode(spark):
    df = place_rows(spark, [("e1", "b", "place", "Q7", "province", "", "", "Lodz", "", False), ("e2", "b", "country", "Q7", "province", "", "", "Lodz", "", False), ("e3", "b", "place", "Q8", "province", "", "", "Nowhere", "", False)])
    found = spark.createDataFrame([("Lodz", 2, "Q998", "x", "town", None), ("Lodz", 1, "Q999", "Lodz City", "city in Poland", None), ("Nowhere", 1, "Q5", "n", "river", None)], "label string, rank int, qid string, title string, description string, types string")
    got = {r.entry_id: r for r in places.state_to_city(df, found).collect()}
    assert (got["e1"].qid, got["e1"].settlement, got["e1"].correction_applied) == ("Q999", "Lodz City", "state_to_city")
    assert (got["e2"].qid, got["e2"].correction_applied) == ("Q7", "") and got["e3"].qid == "Q8"
    cells = spark.createDataFrame([("e", "q07;Q7", "Q8", None, "Q36"), ("f", "", "Q8", "", "")], "id string, initial string, dodgy string, province_qid string, country_qid string")
    assert sorted(map(tuple, places.explode_places(cells, ["id"]).collect())) == [("e", "country", "Q36", "country", False), ("e", "place", "Q7", "initial", True), ("f", "place", "Q8", "dodgy", False)]


def test_record_fields(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert one(D.location_key(lit("ניו-יאָרקער"))) == one(T.normalize_yiddish(lit("ניויאָרק")))
    assert one(D.org_type(lit(" Theater "))) == "theatre" and one(D.org_type(lit("School"))) == "school"
    assert one(D.inferred_type(lit("ליבערטי-טעאַטער"))) == "theatre" and one(D.inferred_type(lit(None).cast("string"))) == ""
    assert one(D.adjective_place(lit("ווילנער טרופּע"))) == D.folded("ווילנע")
    assert one(D.name_variants(lit("A - B-C -  "))) == ["A", "B-C"]
    assert one(D.entity_url(lit("nan"))) == "" and one(D.entity_url(lit("http://x"))) == "http://x"
    assert one(D.without_tags(lit("see [city: Lodz] this"), ["city"])) == "see this" and one(D.note_tag(lit("see [city: Lodz]"), "city")) == "Lodz"
    assert one(D.with_tags(lit("n"), city=lit("Lodz"), street=lit(""))) == "n [city: Lodz]"
    assert one(D.first_score(lit("0.91 | 0.8"))) == 0.91 and one(D.first_score(lit("x"))) == 0.0
    assert one(D.authority_number(lit("12 | x"))) == 12 and one(D.authority_number(lit("x"))) is None
    assert one(D.locations(lit("bad"), lit("Lodz"), lit("A 1")))[0].settlement == "Lodz"
    assert one(D.geo_status(lit(""), lit(""), lit(None).cast("string"), lit("Lodz"), lit(""))) == "has_settlement"
    assert set(one(T.aliases(lit("Adler's troupe")))) == {"adler's troupe", "adler's", "adler troupe", "adler"}
    assert set(one(T.aliases(lit("טרופע פון אַדלער")))) == {"טרופע פונ אדלער", "אדלער"}


def test_tables_by_ending(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x "y"'), ("b", "")], "k string, v string")
    for kind in ("csv", "tsv", "parquet"):
        tables.write_table(df, f"{tmp_path}/t.{kind}")
        assert sorted(map(tuple, tables.read_table(spark, f"{tmp_path}/t.{kind}").collect())) == [("a", 'x "y"'), ("b", "")]
    with pytest.raises(ValueError):
        tables.read_table(spark, "t.xls")


def test_phonetic_codes_of_long_names():
    from itertools import product

    from tallygrove.functions import phonetic

    assert phonetic.codes_of("C" * 1000) and phonetic.codes_of("aeiou" * 60 + "Cholz") == phonetic.codes_of("aeiou" * 60 + "Cholz" + "!")
    for name in ("CJCH", "RZCKJ", "Peterson", "Jackson", "Schwarzenegger", "CHRZCKJM", "MNNM"):
        at, sounds = 0, []
        while at < len(name):
            n = next(n for n in range(phonetic.LONGEST, 0, -1) if name[at : at + n].upper() in phonetic.TABLE)
            after = name[at + n : at + n + 1].upper()
            sounds.append(phonetic.TABLE[name[at : at + n].upper()][0 if at == 0 else 1 if after and after in "AEIOU" else 2])
            at += n
        want = set()
        for choice in product(*sounds):
            digits, last = "", ""
            for code in choice:
                mark = "" if code == "-" else code
                digits += mark if mark and not (last.endswith(mark) and mark != "66") else ""
                last = mark
            want.add(digits[:6].ljust(6, "0"))
        assert phonetic.codes_of(name) == sorted(want)
