"""Place records: kinds by their types, review flags of rows and groups, corrections, and rows for outside reviewers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import as_text, entity_url
from ..functions.text import qids, text
from .resolve import ancestors, flags, rules

#: Parts of type labels that tell a category.
CEMETERY = ("cemetery", "graveyard", "burial ground", "necropolis")
DEATH_SITE = ("concentration camp", "extermination camp", "ghetto", "massacre", "mass grave", "killing")
SETTLEMENT = ("human settlement", "city", "town", "village", "borough", "municipality", "commune")
NEIGHBORHOOD = ("neighborhood", "neighbourhood", "urban district", "district of", "quarter", "suburb")
PROVINCE = ("administrative territorial entity", "province", "governorate", "oblast", "voivodeship", "county", "region", "state", "guberniya", "district")
COUNTRY = ("country", "sovereign state", "empire", "kingdom", "republic")
SETTLEMENT_HINTS = ("city", "town", "village", "municipality", "borough", "commune", "settlement", "capital")
#: Columns that hold the label of a row of that category.
CATEGORIES = ("cemetery", "burial_city", "death_site", "settlement", "province", "country", "neighborhood", "other")
#: The columns of a place table in order, its booleans, and those that a reviewer's queue shows first.
UNIFIED = (
    "entry_id", "context", "source_role", "source_value", "clustered_value", "qid", "qid_source", "place_qid_conflict", "wikidata_label_en", "wikidata_label_yi", "wikidata_type",
    "resolved_category", "other_type", *CATEGORIES, "review_flags", "needs_review", "correction_applied", "death_burial_conflict",
)
BOOLEANS = ("place_qid_conflict", "needs_review", "death_burial_conflict")
QUEUE = (
    "entry_id", "context", "source_role", "source_value", "clustered_value", "qid", "wikidata_label_en", "wikidata_type", "resolved_category", "other_type", "review_flags",
    "qid_source", "place_qid_conflict", "wikidata_label_yi", *CATEGORIES, "needs_review",
)
CORRECTED = ("correction_applied", "death_burial_conflict")
#: Wrong entities by role, and categories that go before the rules.
QID_OVERRIDES = {("province", "Q1139315"): "Q7835"}
CATEGORY_OVERRIDES = {"Q7835": "province"}
#: Flags that call for the sibling rows, and names of sources for reviewers.
MISMATCHES = (
    "place_country_mismatch", "place_province_mismatch", "province_country_mismatch", "province_role_mismatch",
    "country_role_mismatch", "place_country_unresolved", "province_country_unresolved",
)
SOURCE_LABELS = {"initial": "automatic reconciliation", "dodgy": "reviewer reconciliation"}


def has_part(c: Column, parts: Sequence[str]) -> Column:
    return c.rlike("|".join(parts))


def type_text(labels: Column | str) -> Column:
    return F.lower(F.array_join(F.coalesce(F.col(labels) if isinstance(labels, str) else labels, F.array().cast("array<string>")), " "))


def category(types: Column) -> Column:
    """Category of lower-case type labels, by parts of words; settlements go before countries and provinces."""
    order = {"death_site": DEATH_SITE, "cemetery": CEMETERY, "neighborhood": NEIGHBORHOOD, "settlement": SETTLEMENT, "country": COUNTRY, "province": PROVINCE}
    return rules([(has_part(types, parts), name) for name, parts in order.items()], "other")


def is_settlement(description: Column, types: Column) -> Column:
    return has_part(F.lower(F.coalesce(description, F.lit(""))), SETTLEMENT_HINTS) | has_part(types, SETTLEMENT)


def one_hot(kind: Column, label: Column) -> list[Column]:
    """A column for each category: the label in that of the row, else blank."""
    return [F.when(kind == c, label).otherwise(F.lit("")).alias(c) for c in CATEGORIES]


def explode_places(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """keep columns, source_role, qid, qid_source and place_qid_conflict: a row for each entity of each role.

    Columns read: initial, dodgy, province_qid, country_qid. The place's entities are the initial ones, else the dodgy
    ones; both there and different is a conflict. Blank and null cells give no rows.
    """
    first, second = qids("initial"), qids("dodgy")
    has = F.size(first) > 0
    conflict = has & (F.size(second) > 0) & (F.array_sort(first) != F.array_sort(second))
    each = lambda ids, role, source, flag: F.transform(
        ids, lambda q: F.struct(F.lit(role).alias("source_role"), q.alias("qid"), source.alias("qid_source"), flag.alias("place_qid_conflict"))
    )
    place = each(F.when(has, first).otherwise(second), "place", F.when(has, "initial").otherwise("dodgy"), conflict)
    others = [each(qids(f"{r}_qid"), r, F.lit(r), F.lit(False)) for r in ("province", "country")]
    return rows.select(*keep, F.inline(F.concat(place, *others)))


def enrich(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """rows (qid, clustered_value, ...) with labels, type, resolved_category, other_type and the category columns.

    entities: one row per qid with label_en, label_yi and p31_labels. Unknown entities are `other` of type `unknown`.
    """
    e = entities.select(F.col("qid").alias("_q"), "label_en", "label_yi", "p31_labels")
    first = F.get(F.filter("p31_labels", lambda x: F.trim(x) != ""), F.lit(0))
    joined = rows.join(e, rows["qid"] == e["_q"], "left").withColumn("resolved_category", category(type_text("p31_labels")))
    joined = joined.withColumns({
        "wikidata_label_en": F.coalesce(F.nullif("label_en", F.lit("")), text("clustered_value")),
        "wikidata_label_yi": text("label_yi"),
        "wikidata_type": F.coalesce(first, F.lit("")),
        "other_type": F.when(F.col("resolved_category") == "other", F.coalesce(first, F.lit("unknown"))).otherwise(""),
    })
    return joined.select("*", *one_hot(F.col("resolved_category"), F.col("wikidata_label_en"))).drop("_q", "label_en", "label_yi", "p31_labels")


def review_flags(rows: DataFrame, entities: DataFrame, depth: int = 6) -> DataFrame:
    """rows with review_flags and needs_review, by the row and by its group (entry_id, context); null keys form groups.

    rows: entry_id, context, source_role, qid, resolved_category, place_qid_conflict; entities: qid, p17, p131,
    p31_labels. Groups are compared by joins on their entities, so no group is gathered in one row.
    """
    empty = F.array().cast("array<string>")
    up = ancestors(entities.select(F.col("qid").alias("node"), F.explode("p131").alias("parent")), depth)
    own = entities.select(F.col("qid").alias("node"), F.explode("p17").alias("land"))
    lands = up.join(own.withColumnRenamed("node", "ancestor"), "ancestor").select("node", "land").union(own).distinct()
    known = entities.select(F.col("qid").alias("_q"), has_part(type_text(F.coalesce("p31_labels", empty)), COUNTRY).alias("_is_country"))
    group = F.to_json(F.struct("entry_id", "context"), {"ignoreNullFields": "false"})
    r = rows.withColumn("_g", group)
    role = F.col("source_role")
    there = r.where("qid is not null").groupBy("_g").agg(F.bool_or(role == "country").alias("_countries"), F.bool_or(role == "province").alias("_provinces"))
    asked = r.where(role.isin("place", "province") & F.col("qid").isNotNull()).select("_g", F.col("qid").alias("node")).distinct()
    of = lambda name: r.where(role == name).select("_g", F.col("qid").alias("met")).where("met is not null").distinct()
    in_country = asked.join(lands.withColumnRenamed("land", "met"), "node").join(of("country"), ["_g", "met"])
    in_province = asked.join(up.withColumnRenamed("ancestor", "met"), "node").join(of("province"), ["_g", "met"])
    told = lambda d, flag: d.select("_g", F.col("node").alias("qid")).distinct().withColumn(flag, F.lit(True))
    full = r.join(there, "_g", "left").join(told(in_country, "_in_country"), ["_g", "qid"], "left").join(told(in_province, "_in_province"), ["_g", "qid"], "left")
    full = full.join(known, full["qid"] == F.col("_q"), "left").join(lands.select(F.col("node").alias("_n")).distinct(), full["qid"] == F.col("_n"), "left")
    kind, place, province, found = F.col("resolved_category"), role == "place", role == "province", F.col("_q").isNotNull()
    resolved, apart = F.col("_n").isNotNull(), F.col("_in_country").isNull()
    lands_known = found & F.col("_countries")
    out = flags(
        place_qid_conflict=F.col("place_qid_conflict"),
        province_role_mismatch=province & (kind != "province"),
        country_role_mismatch=(role == "country") & ~F.coalesce("_is_country", F.lit(False)),
        place_is_admin_region=place & (kind == "province"),
        needs_manual_type_review=kind == "other",
        qid_lookup_missing=(place | province) & ~found,
        province_country_mismatch=province & lands_known & resolved & apart,
        province_country_unresolved=province & lands_known & ~resolved,
        place_country_mismatch=place & lands_known & resolved & apart,
        place_country_unresolved=place & lands_known & ~resolved,
        place_province_mismatch=place & found & F.col("_provinces") & F.col("_in_province").isNull(),
    )
    return full.withColumn("review_flags", out).withColumn("needs_review", F.col("review_flags") != "").select(*rows.columns, "review_flags", "needs_review")


def override(rows: DataFrame, entities: DataFrame, wrong: Mapping[tuple[str, str], str] = QID_OVERRIDES, kinds: Mapping[str, str] = CATEGORY_OVERRIDES) -> DataFrame:
    """Rows without a stamp whose (role, qid) is known to be wrong get the right entity, label and category, stamped
    qid_override; then rows without a stamp of a listed entity get its category, stamped category_override.

    entities: qid, label_en. rows hold the category columns, source_role, qid, clustered_value, wikidata_label_en,
    resolved_category, other_type and correction_applied.
    """
    table = F.create_map(*[F.lit(x) for (role, bad), good in wrong.items() for x in (f"{role}|{bad}", good)])
    listed = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    free = text("correction_applied") == ""
    right = F.when(free, F.try_element_at(table, F.concat_ws("|", "source_role", "qid")))
    e = entities.select(F.col("qid").alias("_q"), F.col("label_en").alias("_label"), category(type_text("p31_labels")).alias("_found"))
    met = rows.withColumn("_right", right).join(e, F.col("_right") == F.col("_q"), "left")
    swapped = F.col("_q").isNotNull()
    label = F.when(swapped, F.col("_label")).otherwise(F.coalesce(F.nullif("wikidata_label_en", F.lit("")), text("clustered_value")))
    kind = F.coalesce(F.try_element_at(listed, F.when(swapped, F.col("_q")).otherwise(F.when(free, F.col("qid")))), F.when(swapped, F.col("_found")), F.col("resolved_category"))
    moved = swapped | (free & (kind != F.col("resolved_category")))
    met = met.withColumns({"_kind": kind, "_moved": moved, "_name": label})
    new = {
        "qid": F.when(swapped, F.col("_q")).otherwise(F.col("qid")),
        "clustered_value": F.when(swapped, F.col("_label")).otherwise(F.col("clustered_value")),
        "wikidata_label_en": F.when(swapped, F.col("_label")).otherwise(F.col("wikidata_label_en")),
        "resolved_category": F.col("_kind"),
        "other_type": F.when(F.col("_moved"), "").otherwise(F.col("other_type")),
        "correction_applied": F.when(swapped, "qid_override").when(F.col("_moved"), "category_override").otherwise(F.col("correction_applied")),
    } | {c: F.when(F.col("_moved"), F.when(F.col("_kind") == c, F.col("_name")).otherwise("")).otherwise(F.col(c)) for c in CATEGORIES}
    return met.select(*[(new[c] if c in new else F.col(c)).alias(c) for c in rows.columns])


def reassign_role(rows: DataFrame, is_country: Column) -> DataFrame:
    """Rows without a stamp whose category belongs to another role get that role and the stamp moved_to_<role>.

    Places move to province or country; countries to any category that isn't one, unless their type is unsaid; provinces
    to country. Settlements in the province role stay for a reviewer. Null categories count as blank.
    """
    role, kind, other = F.col("source_role"), text("resolved_category"), text("other_type")
    as_country = (kind == "country") | ((kind == "other") & (other == "country"))
    typed = (role == "province") & ~as_country & (kind != "province") & F.coalesce(is_country, F.lit(False))
    to = F.when((role == "place") & (kind == "province"), "province").when(role.isin("place", "province") & as_country, "country").when(typed, "country")
    to = to.when((role == "country") & ~kind.isin("country", "other", ""), kind).when((role == "country") & (kind == "other") & ~other.isin("", "country"), "other")
    label = F.coalesce(F.nullif("wikidata_label_en", F.lit("")), text("clustered_value"))
    met = rows.withColumns({"_to": F.when(text("correction_applied") == "", to), "_typed": typed, "_name": label})
    relabel = F.col("_to").isNotNull() & (F.col("_typed") | ((role == "country") & (F.col("_to") != "province")))
    new = {
        "source_role": F.coalesce("_to", "source_role"),
        "resolved_category": F.when(F.col("_typed") & F.col("_to").isNotNull(), "country").otherwise(F.col("resolved_category")),
        "other_type": F.when(F.col("_typed") & F.col("_to").isNotNull(), "").otherwise(F.col("other_type")),
        "correction_applied": F.coalesce(F.concat(F.lit("moved_to_"), F.col("_to")), F.col("correction_applied")),
    } | {c: F.when(relabel, F.when(F.col("_to") == c, F.col("_name")).otherwise("")).otherwise(F.col(c)) for c in CATEGORIES if c in rows.columns}
    return met.select(*[(new[c] if c in new else F.col(c)).alias(c) for c in rows.columns])


def state_to_city(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Places that resolved to a province get the first candidate of their label that is a settlement, stamped state_to_city.

    candidates: label, rank, qid, title, description, types (lower-case labels; null where the entity is unknown).
    """
    good = candidates.where(is_settlement(F.col("description"), text("types")))
    best = good.groupBy(F.col("label").alias("_label")).agg(F.min_by(F.struct(F.col("qid").alias("_q"), F.col("title").alias("_title")), F.struct("rank", "qid")).alias("_b")).select("_label", "_b.*")
    label = F.coalesce(F.nullif("wikidata_label_en", F.lit("")), text("clustered_value"))
    fits = (F.col("source_role") == "place") & (F.col("resolved_category") == "province") & (text("correction_applied") == "")
    met = rows.withColumn("_key", F.when(fits, label)).join(best, F.col("_key") == F.col("_label"), "left")
    hit = F.col("_q").isNotNull()
    new = {
        "qid": F.coalesce("_q", "qid"),
        "wikidata_label_en": F.when(hit, F.coalesce("_title", "wikidata_label_en")).otherwise(F.col("wikidata_label_en")),
        "resolved_category": F.when(hit, "settlement").otherwise(F.col("resolved_category")),
        "correction_applied": F.when(hit, "state_to_city").otherwise(F.col("correction_applied")),
    } | {c: F.when(hit, F.coalesce("_title", "wikidata_label_en") if c == "settlement" else F.lit("")).otherwise(F.col(c)) for c in CATEGORIES if c in rows.columns}
    return met.select(*[(new[c] if c in new else F.col(c)).alias(c) for c in rows.columns])


def reviewer_rows(rows: DataFrame, position: str) -> DataFrame:
    """Rows that need review in order of `position`; after a group's first with a mismatch, its other rows as context.

    Context rows are blank in entry_id and review_flags. Sort by anchor, row_order, then the columns to write them.
    """
    key = ["entry_id", "context", "source_role", "source_value", "clustered_value", "qid"]
    clean = rows.withColumns({c: as_text(c) for c in key})
    asked = clean.where("needs_review")
    marked = F.arrays_overlap(F.transform(F.split(text("review_flags"), ";"), lambda x: F.trim(x)), F.array(*[F.lit(x) for x in MISMATCHES]))
    anchors = asked.where(marked).groupBy("entry_id", "context").agg(F.min(position).alias("anchor"))
    siblings = clean.join(asked.select(*key).distinct(), key, "left_anti").join(anchors, ["entry_id", "context"])
    flagged = asked.withColumns({"anchor": F.col(position), "row_type": F.lit("flagged"), "row_order": F.lit(0)})
    around = siblings.withColumns({"entry_id": F.lit(""), "review_flags": F.lit(""), "row_type": F.lit("context"), "row_order": F.lit(1)})
    source = as_text("qid_source")
    labelled = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SOURCE_LABELS.items() for x in kv]), source), source)
    out = flagged.unionByName(around)
    return out.select("anchor", "row_order", "row_type", *key[:5], entity_url("qid").alias("wikidata_url"), "resolved_category", "review_flags", labelled.alias("qid_source"))


def unified(rows: DataFrame) -> DataFrame:
    """rows with the columns of a place table in their order: missing ones are blank or false, null booleans false, others left out."""
    have = set(rows.columns)
    false = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) if c in have else F.lit(False)
    return rows.select(*[(false(c) if c in BOOLEANS else F.col(c) if c in have else F.lit("")).alias(c) for c in UNIFIED])


def review_queue(rows: DataFrame, corrections: bool | None = None) -> DataFrame:
    """Rows of a place table that need review, what a reviewer needs first; with the columns of corrections if asked, or if rows have them."""
    shown = corrections if corrections is not None else set(CORRECTED) <= set(rows.columns)
    return unified(rows).where("needs_review").select(*QUEUE, *(CORRECTED if shown else ()))


def legacy(rows: DataFrame, corrections: bool = False) -> tuple[DataFrame, DataFrame]:
    """The two tables that older readers expect: all rows, and those that need review."""
    more = CORRECTED if corrections else ()
    return unified(rows).select(*[c for c in UNIFIED if c not in CORRECTED], *more), review_queue(rows, corrections)


def mirror(rows: DataFrame) -> DataFrame:
    """Place rows with a death site or a burial city alone get it in both, stamped death_burial_mirrored if they have no stamp.

    Where both are told and differ, both stay and death_burial_conflict is set. Other roles are left alone.
    """
    death, burial = F.trim(text("death_site")), F.trim(text("burial_city"))
    place, stamp = F.coalesce(F.col("source_role") == "place", F.lit(False)), F.col("correction_applied") if "correction_applied" in rows.columns else F.lit("")
    clash = F.coalesce(F.col("death_burial_conflict"), F.lit(False)) if "death_burial_conflict" in rows.columns else F.lit(False)
    down, up = place & (death != "") & (burial == ""), place & (burial != "") & (death == "")
    new = {
        "burial_city": F.when(down, F.col("death_site")).otherwise(F.col("burial_city")), "death_site": F.when(up, F.col("burial_city")).otherwise(F.col("death_site")),
        "correction_applied": F.when((down | up) & (text(stamp) == ""), "death_burial_mirrored").otherwise(stamp),
        "death_burial_conflict": clash | (place & (death != "") & (burial != "") & (death != burial)),
    }
    return rows.select(*[(new[c] if c in new else F.col(c)).alias(c) for c in dict.fromkeys([*rows.columns, *CORRECTED])])


def kind_counts(rows: DataFrame) -> DataFrame:
    """(total, kind, n): rows of each category, each stamp that isn't blank, and how many need review."""
    counts = lambda what, c: rows.where(text(c) != "").groupBy(F.lit(what).alias("total"), F.col(c).alias("kind")).agg(F.count("*").alias("n"))
    review = rows.agg(F.count_if(F.lower(F.col("needs_review").cast("string")) == "true").alias("n")).select(F.lit("needs_review").alias("total"), F.lit("").alias("kind"), "n")
    return counts("category", "resolved_category").unionByName(counts("correction", "correction_applied")).unionByName(review)
