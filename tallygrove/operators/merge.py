"""Tables merged by a rule for each column, and cemetery records merged into the places."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text
from .packed import ordered_distinct
from .places import category, type_text

RULES = ("keep", "fill", "take", "flag")


def merge_columns(old: DataFrame, new: DataFrame, key: str, rules: Mapping[str, str], order: Sequence[str | Column], flags: str = "conflicts") -> DataFrame:
    """old's rows merged with new's of the same key, then the rows that only new has; flags: what differs, as `column:value` joined by semicolons.

    A rule for each column: keep the old value; fill it where it is blank; take the new one where that isn't blank; flag:
    fill it, and where both differ keep the old one and name the new one in flags. Columns without a rule are kept. Of
    new's rows of a key the first by `order` counts for each column in which it isn't blank, so they fill each other's
    gaps. A blank key matches nothing: such rows of old stay, those of new are added as they are.
    """
    unknown = [f"{c}: {r}" for c, r in rules.items() if r not in RULES] + [c for c in rules if c not in old.columns or c not in new.columns]
    if unknown:
        raise ValueError(f"no such rule or column: {', '.join(unknown)}")
    blank = lambda c: F.trim(text(c.cast("string"))) == ""
    keyed = new.where(~blank(F.col(key)))
    first = keyed.groupBy(F.col(key).alias("_k")).agg(*[F.min_by(c, F.when(~blank(F.col(c)), F.struct(*order))).alias(f"_new_{c}") for c in new.columns if c != key])
    first = first.select("_k", *[F.when(~blank(F.col(c)), F.col(c)).alias(c) for c in first.columns if c != "_k"])
    joined = old.join(first, old[key] == first["_k"], "left")

    def cell(c: str) -> Column:
        mine, other, rule = F.col(c), F.col(f"_new_{c}"), rules.get(c, "keep")
        if rule == "keep":
            return mine
        return F.coalesce(other, mine) if rule == "take" else F.when(blank(mine), F.coalesce(other, mine)).otherwise(mine)

    differs = [F.when(~blank(F.col(c)) & (F.col(c) != F.col(f"_new_{c}")), F.concat(F.lit(f"{c}:"), F.col(f"_new_{c}").cast("string"))) for c, r in rules.items() if r == "flag"]
    told = F.array_join(F.array_compact(F.array(*differs)), ";") if differs else F.lit("")
    merged = joined.select(*[cell(c).alias(c) for c in old.columns], told.alias(flags))
    kinds = {f.name: f.dataType for f in old.schema.fields}
    only = first.join(old.select(F.col(key).alias("_k")), "_k", "left_anti")
    added = only.select(*[(F.col("_k") if c == key else F.col(f"_new_{c}") if f"_new_{c}" in only.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
    loose = new.where(blank(F.col(key))).select(*[(F.col(c) if c in new.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
    return merged.unionByName(added.unionByName(loose).withColumn(flags, F.lit("")))


def cemetery_rows(sheet: DataFrame) -> DataFrame:
    """(entry_id, cem_name, cem_qid, cem_province, cem_country) of the cemeteries' spreadsheet; the id is taken out of its address."""
    names = {"entry_id": "unique-id", "cem_name": "_ - burial_place - name", "cem_province": "_ - burial_place - province", "cem_country": "_ - burial_place - country"}
    got = {n: text(F.col(f"`{c}`")) for n, c in names.items()}
    got["cem_qid"] = F.regexp_extract(text("wikidata"), r"(Q\d+)", 1)
    return sheet.select(*[got[n].alias(n) for n in ("entry_id", "cem_name", "cem_qid", "cem_province", "cem_country")])


def merge_cemeteries(places: DataFrame, sheet: DataFrame, entities: DataFrame, order: Sequence[str]) -> DataFrame:
    """places with the cemeteries merged in, by entry_id and the burial's place row.

    A row without an entity gets the cemetery's, with its labels and kind; one with another entity is flagged
    `ra_qid_conflict:<id>` and needs review. Entries without a burial place get a row for it, and one each for its province and country if they are
    told. Of several cemetery rows of an entry the first entity (by `order`) fills and all others that differ are
    flagged in order; an entry without a place gets rows for each. sheet: cemetery_rows() and the columns of order;
    entities: qid, label_en, label_yi, p31_labels. Entities that aren't known count as cemeteries without labels.
    """
    blank = lambda c: F.trim(text(c)) == ""
    e = entities.select(F.col("qid").alias("_q"), F.struct("label_en", "label_yi", "p31_labels", F.lit(True).alias("known")).alias("_e"))
    met = sheet.join(e, sheet["cem_qid"] == F.col("_q"), "left").drop("_q")
    kind = F.when(F.col("_e.known"), category(type_text("_e.p31_labels"))).otherwise("cemetery")
    label_types = F.coalesce(F.col("_e.p31_labels"), F.array().cast("array<string>"))
    first_type = F.get(F.filter(label_types, lambda x: F.trim(x) != ""), F.lit(0))
    other = F.when(F.col("_e.known") & (kind == "other"), F.coalesce(first_type, F.lit("unknown"))).otherwise("")
    label = F.coalesce(F.nullif(text("_e.label_en"), F.lit("")), text("cem_name"))
    told = {
        "qid": text("cem_qid"), "qid_source": F.when(blank("cem_qid"), "").otherwise("ra_cemetery"), "wikidata_label_en": text("_e.label_en"),
        "wikidata_label_yi": text("_e.label_yi"), "wikidata_type": F.array_join(label_types, ", "), "resolved_category": kind, "other_type": other,
        "cemetery": F.when(kind == "cemetery", label).otherwise(""),
    }
    known = met.select("entry_id", "cem_name", "cem_province", "cem_country", F.struct(*order).alias("_o"), F.struct(*[v.alias(k) for k, v in told.items()]).alias("_put"))

    mine = (F.col("context") == "burial") & (F.col("source_role") == "place")
    given = known.where("_put.qid <> ''")
    fill = given.groupBy(F.col("entry_id").alias("_id")).agg(F.min_by("_put", "_o").alias("_put"))
    listed = ordered_distinct(given, ["entry_id"], F.col("_put.qid"), ["_o"], "_qids").withColumnRenamed("entry_id", "_id")
    joined = places.join(fill.join(listed, "_id"), mine & (places["entry_id"] == F.col("_id")), "left")
    filled = F.col("_id").isNotNull() & blank("qid")
    held = F.when(filled, F.col("_put.qid")).otherwise(F.trim("qid"))
    # set apart first: names in lambdas would else mean the new columns of the same select
    joined = joined.withColumns({"_filled": filled, "_held": held, "_before": text("review_flags")})
    told_of = F.transform(F.filter("_qids", lambda q: q != F.col("_held")), lambda q: F.concat(F.lit("ra_qid_conflict:"), q))
    joined = joined.withColumn("_new", F.coalesce(F.filter(told_of, lambda f: ~F.contains(F.col("_before"), f)), F.array().cast("array<string>")))
    joined = joined.withColumn("_told", F.array_join(F.concat(F.filter(F.array("_before"), lambda x: x != ""), "_new"), ";"))
    filled, some = F.col("_filled"), F.size("_new") > 0
    put = {k: F.when(filled, F.col("_put")[k]).otherwise(F.col(k)) for k in told if k != "cemetery"}
    put["cemetery"] = F.when(filled & (F.col("_put.resolved_category") == "cemetery"), F.col("_put.cemetery")).otherwise(F.col("cemetery"))
    put["review_flags"] = F.when(some, F.col("_told")).otherwise(F.col("review_flags"))
    put["needs_review"] = some | F.coalesce("needs_review", F.lit(False))
    merged = joined.select(*[(put[c] if c in put else F.col(c)).alias(c) for c in places.columns])

    have = places.where(mine).select("entry_id")
    fresh = known.join(have, "entry_id", "left_anti")
    row = lambda role, value, more: F.struct(F.lit(role).alias("source_role"), value.alias("source_value"), value.alias("clustered_value"), *[(F.col("_put")[k] if more else F.lit("")).alias(k) for k in told])
    wanted = [row("place", text("cem_name"), True)] + [F.when(~blank(c) & (F.trim(c) != "nan"), row(r, text(c), False)) for r, c in (("province", "cem_province"), ("country", "cem_country"))]
    rows = fresh.select("entry_id", F.inline(F.array_compact(F.array(*wanted))))
    flags = ("place_qid_conflict", "needs_review", "death_burial_conflict")
    fixed = {"context": F.lit("burial")} | {c: F.lit(False) for c in flags}
    kinds = {f.name: f.dataType for f in places.schema.fields}
    added = rows.select(*[(fixed[c] if c in fixed else F.col(c) if c in rows.columns else F.lit("")).cast(k).alias(c) for c, k in kinds.items()])
    return merged.unionByName(added)
