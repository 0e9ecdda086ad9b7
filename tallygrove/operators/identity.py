"""Merging authorities: chains of merges followed to their end, and the tables that name them rewritten from one map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cells, text
from ..session import written
from .packed import ordered_distinct

#: The fields of a confirmed location, the columns that hold those of the first, and the flags of a card.
FIELDS = ("settlement", "settlement_yiddish", "address", "address_romanized", "lat", "lon")
COLUMNS = ("confirmed_settlement", "confirmed_settlement_yiddish", "confirmed_address", "confirmed_address_romanized", "lat", "lon")
FLAGS = ("is_generic", "is_exploded")
LOCATIONS = "array<struct<" + ", ".join(f"{f}: string" for f in FIELDS) + ">>"


def follow(merges: DataFrame, loser: str = "loser", survivor: str = "survivor", order: str = "n") -> DataFrame:
    """(loser, survivor, came, cyclic) of each loser: the end of its chain of merges, and by which merges it came there.

    Every loser counts with its first merge in that order. Steps double each round, so a chain takes as many rounds as
    its length has bits; losers whose chain runs into a cycle have no end: cyclic is true for them and survivor null.
    came holds the orders of the merges on the way from the end down, but for those that a later one below has overtaken:
    compared as arrays they put what a survivor takes in, in the order in which it comes in.
    """
    m = merges.select(F.col(loser).alias("loser"), F.col(survivor).alias("to"), F.col(order).cast("long").alias("n"))
    m = m.where("loser is not null and to is not null and trim(loser) <> '' and trim(to) <> '' and loser <> to")
    first = m.groupBy("loser").agg(F.min(F.struct("n", "to")).alias("m")).select("loser", F.col("m.to").alias("to"), F.array("m.n").alias("came"))
    at, open_before = written(first, "chains"), None
    while True:
        ahead = at.select(F.col("loser").alias("to"), F.col("to").alias("_next"), F.col("came").alias("_came"))
        joined = at.join(ahead, "to", "left")
        open_ = joined.where("_next is not null").count()
        if not open_ or open_ == open_before:
            break
        open_before = open_
        # a merge of this loser's way that came later than one further up has carried it past that one
        passed = F.filter("_came", lambda x: x > F.array_max("came"))
        step = joined.select("loser", F.coalesce("_next", "to").alias("to"), F.when(F.col("_next").isNull(), F.col("came")).otherwise(F.concat(passed, "came")).alias("came"))
        at = written(step, "chains")
    cyclic = F.col("_next").isNotNull()
    return joined.select("loser", F.when(~cyclic, F.col("to")).alias("survivor"), F.when(~cyclic, F.col("came")).alias("came"), cyclic.alias("cyclic"))


def repoint(rows: DataFrame, chains: DataFrame, column: str) -> DataFrame:
    """rows with the named ids replaced by what they were merged into, and `repointed`, whether it was."""
    to = chains.where("not cyclic").select(F.col("loser").alias("_loser"), F.col("survivor").alias("_to"))
    joined = rows.join(to, F.trim(column) == F.col("_loser"), "left")
    return joined.select(*[F.coalesce("_to", c).alias(c) if c == column else F.col(c) for c in rows.columns], F.col("_to").isNotNull().alias("repointed"))


def confirmed(raw: Column, first: dict[str, Column]) -> Column:
    """The locations of a card: its JSON list, or if that is blank, broken or empty the one of its own columns, if any."""
    parsed = F.from_json(F.when(F.ltrim(text(raw)).startswith("["), raw), LOCATIONS)
    own = F.struct(*[text(first[f]).alias(f) for f in FIELDS])
    some = F.greatest(*[F.length(F.trim(text(first[f]))) for f in FIELDS]) > 0
    return F.when(F.size(parsed) > 0, parsed).when(some, F.array(own)).otherwise(F.array().cast(LOCATIONS))


def taken(members: DataFrame, values: Column, key: Column | None, name: str) -> DataFrame:
    """(survivor, name): the values of all members in their order, the first of each key."""
    each = members.select("survivor", "came", F.posexplode(values).alias("_at", "_v"))
    return ordered_distinct(each, ["survivor"], F.col("_v"), ["came", "_at"], name, key)


def merge_cards(cards: DataFrame, chains: DataFrame, reviewer: str, at: str) -> DataFrame:
    """Cards after the merges: losers are gone, survivors hold what both had, and sub-entries name the survivor as parent.

    A survivor's linked ids and locations come first, its losers' after it in the order of the merges, each once (locations by
    settlement and address). Its location columns are those of the first location, blanks filled by the losers' in order.
    Losers' notes are added under a line with their id, a flag that any has is set, and the survivor is stamped. A merge
    that names no card on one side changes no card but the sub-entries of a loser. Cards need db_id, parent_db_id,
    linked_cluster_ids, confirmed_locations, reviewer_notes, reviewer, reviewed_at and the columns and flags above; others stay.
    """
    ends = chains.where("not cyclic")
    have = cards.select(F.col("db_id").alias("survivor"))
    lost = ends.join(have, "survivor", "left_semi").join(cards, ends["loser"] == cards["db_id"])
    lost = lost.select("survivor", "came", *cards.columns)
    kept = cards.join(lost.select("survivor").distinct(), cards["db_id"] == F.col("survivor"), "left_semi")
    kept = kept.select(F.col("db_id").alias("survivor"), F.array().cast("array<bigint>").alias("came"), *cards.columns)
    members = written(kept.unionByName(lost), "members")

    linked = taken(members, cells("linked_cluster_ids"), None, "_linked")
    places = confirmed(F.col("confirmed_locations"), dict(zip(FIELDS, map(F.col, COLUMNS), strict=True)))
    located = taken(members, places, F.struct(*[F.trim(text(F.col("_v")[f])).alias(f) for f in ("settlement", "address")]), "_places")

    own = F.size("came") == 0
    said = F.trim(text("reviewer_notes"))
    note = F.when(own, said).otherwise(F.concat(F.lit("[merged from db_id "), F.col("db_id"), F.lit("] "), said))
    notes = members.where(said != "").groupBy("survivor").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("came", note.alias("note")))), lambda x: x["note"]), "\n---\n").alias("_note"))
    blank = lambda c: F.trim(text(c)) == ""
    # the losers' first that isn't blank, by the order in which they came
    fill = [F.min(F.when(~own & ~blank(c), F.struct("came", F.col(c).alias("v")))).alias(f"_fill_{c}") for c in COLUMNS]
    rest = members.groupBy("survivor").agg(*fill, *[F.bool_or(~own & (F.trim(text(c)) == "TRUE")).alias(f"_set_{c}") for c in FLAGS])
    put = rest.join(linked, "survivor", "left").join(located, "survivor", "left").join(notes, "survivor", "left")

    gone = ends.join(cards.select(F.col("db_id").alias("loser")), "loser", "left_semi").join(have, "survivor", "left_semi")
    rows = cards.join(gone.select(F.col("loser").alias("db_id")), "db_id", "left_anti").select(*cards.columns)
    rows = repoint(rows, chains, "parent_db_id").drop("repointed")
    joined = rows.join(put, rows["db_id"] == put["survivor"], "left")
    hit, some = F.col("survivor").isNotNull(), F.size(F.coalesce("_places", F.array())) > 0
    new = {"linked_cluster_ids": F.array_join(F.coalesce("_linked", F.array().cast("array<string>")), "|"), "reviewer": F.lit(reviewer), "reviewed_at": F.lit(at)}
    new["confirmed_locations"] = F.when(some, F.to_json("_places")).otherwise(F.col("confirmed_locations"))
    new["reviewer_notes"] = F.coalesce("_note", "reviewer_notes")
    for c, f in zip(COLUMNS, FIELDS, strict=True):
        first = F.when(some, text(F.col("_places")[0][f])).otherwise(text(c))
        new[c] = F.when(F.trim(first) == "", F.coalesce(F.col(f"_fill_{c}")["v"], F.lit(""))).otherwise(first)
    for c in FLAGS:
        new[c] = F.when(F.trim(text(c)).isin("", "FALSE") & F.col(f"_set_{c}"), F.lit("TRUE")).otherwise(F.col(c))
    return joined.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in cards.columns])


def merge_core(core: DataFrame, chains: DataFrame) -> DataFrame:
    """The authority table after the merges: losers are gone, survivors hold their linked ids too; losers without a survivor here stay."""
    have = core.select(F.col("db_id").alias("survivor"))
    ends = written(chains.where("not cyclic").join(have, "survivor", "left_semi").select("loser", "survivor", "came"), "ends")
    lost = ends.join(core, ends["loser"] == core["db_id"]).select("survivor", "came", "linked_cluster_ids")
    kept = core.join(lost.select("survivor").distinct(), core["db_id"] == F.col("survivor"), "left_semi")
    kept = kept.select(F.col("db_id").alias("survivor"), F.array().cast("array<bigint>").alias("came"), "linked_cluster_ids")
    linked = taken(kept.unionByName(lost), cells("linked_cluster_ids"), None, "_linked").withColumnRenamed("survivor", "_id")
    rows = core.join(ends.select(F.col("loser").alias("db_id")), "db_id", "left_anti").select(*core.columns)
    joined = rows.join(linked, rows["db_id"] == linked["_id"], "left")
    return joined.select(*[F.coalesce(F.array_join("_linked", "|"), c).alias(c) if c == "linked_cluster_ids" else F.col(c) for c in core.columns])


def merge_authorities(cards: DataFrame, alignment: DataFrame, core: DataFrame, merges: DataFrame, reviewer: str, at: str) -> dict[str, DataFrame]:
    """The three tables that name authorities after the merges (loser, survivor, n), all from one map, and `chains`, the map."""
    chains = written(follow(merges), "chains")
    return {
        "cards": merge_cards(cards, chains, reviewer, at),
        "alignment": repoint(alignment, chains, "aligned_db_id"),
        "core": merge_core(core, chains),
        "chains": chains,
    }
