"""An audit of place names from a rule file: normalised names, flags and whether a reviewer must look."""

from __future__ import annotations

from collections.abc import Mapping

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import text

#: The settings of a rule file and what holds where it says nothing.
DEFAULTS = {
    "required_columns": ["place"], "source_place_column": "place",
    "normalization": {"trim_whitespace": True, "collapse_internal_spaces": True},
    "flags": {"empty_place_name": True, "duplicate_exact": True, "suspicious_characters_regex": None, "very_short_threshold": 2},
}
#: What a reviewer's queue shows first, and the flags of an audit.
QUEUE = (
    "source_id", "place_name", "place_name_normalized", "language", "context", "page_ref", "flag_empty_place_name", "flag_duplicate_exact", "flag_very_short",
    "flag_suspicious_characters", "review_status", "canonical_name", "review_notes",
)
FLAGS = ("flag_empty_place_name", "flag_duplicate_exact", "flag_very_short", "flag_suspicious_characters")
#: White space as str.split() knows it.
SPACE = r"[\s\x{1C}-\x{1F}]+"


def settings(raw: Mapping | None) -> dict:
    """The settings of a rule file, with defaults; a key that has no meaning, or a value of a wrong kind, is an error."""
    raw = dict(raw or {})
    unknown = [k for k in raw if k not in DEFAULTS] + [f"{g}.{k}" for g in ("normalization", "flags") for k in (raw.get(g) or {}) if k not in DEFAULTS[g]]
    if unknown:
        raise ValueError(f"unknown rules: {', '.join(sorted(unknown))}")
    got = {k: {**v, **(raw.get(k) or {})} if isinstance(v, dict) else raw.get(k, v) for k, v in DEFAULTS.items()}
    if not isinstance(got["required_columns"], list):
        raise ValueError("required_columns is no list")
    if isinstance(got["flags"]["very_short_threshold"], bool) or not isinstance(got["flags"]["very_short_threshold"], int):
        raise ValueError("very_short_threshold is no whole number")
    return got


def load_rules(spark: SparkSession, path: str) -> dict:
    """The settings of a YAML file in any store that Spark reads."""
    return settings(yaml.safe_load(spark.read.text(path, wholetext=True).first()[0]))


def normalised(c: Column, rules: Mapping) -> Column:
    how, value = rules["normalization"], text(c.cast("string"))
    if how["collapse_internal_spaces"]:  # which trims too
        return F.trim(F.regexp_replace(value, f"(?U){SPACE}", " "))
    return F.regexp_replace(value, f"(?U)^{SPACE}|{SPACE}$", "") if how["trim_whitespace"] else value


def pattern(raw: str) -> str:
    """A rule's pattern for Spark: word characters are letters, digits and the underscore, of any script."""
    return "(?U)" + raw.replace(r"\w", r"\p{L}\p{N}_")


def audit(rows: DataFrame, rules: Mapping) -> DataFrame:
    """rows with place_name_original, place_name_normalized, the four flags and needs_review, whether any is set.

    A flag that the rules turn off is false. Missing columns are an error. Names found more than once are counted in
    an aggregate that combines before the shuffle, and joined; so is the blank name, however many rows have it.
    """
    missing = [c for c in rules["required_columns"] if c not in rows.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    place, on = rules["source_place_column"], rules["flags"]
    if place not in rows.columns:
        raise ValueError(f"the configured place column is not there: {place}")
    name, off = F.col("place_name_normalized"), F.lit(False)
    out = rows.withColumns({"place_name_original": F.col(place), "place_name_normalized": normalised(F.col(place), rules)})
    repeated = off
    if on["duplicate_exact"]:
        often = out.groupBy("place_name_normalized").agg(F.count("*").alias("_n")).where("_n > 1")
        out, repeated = out.join(often, "place_name_normalized", "left"), F.col("_n").isNotNull()
    seen = on["suspicious_characters_regex"]
    told = {
        "flag_empty_place_name": name == "" if on["empty_place_name"] else off,
        "flag_duplicate_exact": repeated,
        "flag_very_short": F.length(name) <= on["very_short_threshold"],
        "flag_suspicious_characters": (name != "") & name.rlike(pattern(seen)) if seen else off,
    }
    flagged = out.withColumns(told)
    return flagged.withColumn("needs_review", F.greatest(*FLAGS)).select(*rows.columns, "place_name_original", "place_name_normalized", *FLAGS, "needs_review")


def review_queue(audited: DataFrame) -> DataFrame:
    """Rows that need review, pending, with room for a name and notes; what a reviewer needs comes first, all else after it."""
    asked = audited.where("needs_review").withColumns({"review_status": F.lit("pending"), "canonical_name": F.lit(""), "review_notes": F.lit("")})
    first = [c for c in QUEUE if c in asked.columns]
    return asked.select(*first, *[c for c in asked.columns if c not in first])
