"""Rule classifier of mentions: proper names, descriptive terms, or ambiguous."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_key, text, tokens
from .resolve import ratio_join

#: Word lists of the classifier.
POSSESSIVES = ("מיין", "מײַן", "זיין", "זײַן", "איר", "אונדזער", "אונדזערע", "זייער")
PLURALS = ("טרופּעס", "טרופעס", "טעאַטערס", "טעאטערס", "שולן", "קרייזן", "געזעלשאַפֿטן")
GENERIC = (
    "בינע", "דראַמקרייז", "דראמקרייז", "וואַנדערטרופּע", "וואנדערטרופע", "קרייז", "טרופּע", "טרופע", "טעאַטער", "טעאטער", "שול",
    "קאָנסערוואַטאָריע", "קאָנסערוואטאריע", "קונסטקרייז", "פֿאַרלאַג", "פארלאג", "צייטונג", "געזעלשאַפֿט", "געזעלשאפט", "פֿאַראיין", "פאראיין",
    "ארגאניזאציע", "אָרגאַניזאַציע", "organization", "theatre", "theater", "troupe", "group", "school", "publisher", "newspaper", "union",
)
STOPWORDS = ("דער", "די", "דאָס", "דאס", "פון", "אין", "אויף", "ביי", "און", "צו", "מיט", "אַן", "אן", "a", "an", "the", "of", "in", "for")
INSTITUTIONS = (
    "טעאַטער", "טעאטער", "טרופּע", "טרופע", "קאָנסערוואַטאָריע", "קאָנסערוואטאריע", "שול", "בינע", "קרייז", "געזעלשאַפֿט", "געזעלשאפט",
    "פֿאַראיין", "פאראיין", "theatre", "theater", "troupe", "academy", "conservatory", "school", "union", "society",
)
WORKPLACES = ("factory", "workplace")
SURNAME_ENDS = ("מאַן", "מאן", "בערג", "שטיין", "בוים", "פעלד", "וויטש", "סקי", "זאָן", "זון")
LATIN_NAME = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"


def any_of(words: Column, known: tuple[str, ...]) -> Column:
    return F.exists(words, lambda w: w.isin(*known))


def generic_only(words: Column, generic: tuple[str, ...] = GENERIC) -> Column:
    """Words other than stop words are there, and all are generic."""
    telling = F.filter(words, lambda w: ~w.isin(*STOPWORDS))
    return (F.size(telling) > 0) & F.forall(telling, lambda w: w.isin(*generic))


def points(**signals: tuple[Column, int]) -> Column:
    return sum((F.when(F.coalesce(c, F.lit(False)), n).otherwise(0) for c, n in signals.values()), F.lit(0))


def known_names(rows: DataFrame, names: DataFrame, columns: tuple[str, ...], least: float = 0.93) -> DataFrame:
    """(key): the different keys of the columns that equal an authority name's key or have a ratio with one of at least so much."""
    ours = rows.select(F.explode(F.array(*[match_key(c) for c in columns])).alias("key")).where("key <> ''").distinct()
    theirs = names.select(match_key(names.columns[0]).alias("name")).where("name <> ''").distinct()
    near = ratio_join(theirs, ours, "name", "key", least).select("key")
    return ours.join(theirs, ours["key"] == theirs["name"], "left_semi").unionByName(near).distinct()


def classify(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows (org_type, title, clustered, descriptive, settlement, venue and any others) with name_type and confidence.

    names: one column with the authority's names. Nulls count as blank; names of an authority without any row match
    nothing. A mention whose key is an authority's is a proper name for sure; all others go by the points of signals.
    """
    known = known_names(rows, names, ("clustered", "title"))
    a, b = known.select(F.col("key").alias("_a")), known.select(F.col("key").alias("_b"))
    met = rows.join(a, match_key("clustered") == F.col("_a"), "left").join(b, match_key("title") == F.col("_b"), "left")
    kind = F.lower(F.trim(text("org_type")))
    has = lambda c: F.trim(text(c)) != ""
    title_words, words = tokens(F.trim(text("title"))), F.concat(tokens("title"), tokens("descriptive"))
    descriptive = points(
        untitled=(~has("title") & has("descriptive"), 2),
        owned=(any_of(words, POSSESSIVES + PLURALS), 3),
        generic=(generic_only(words), 2),
        workplace=(kind.isin(*WORKPLACES) & generic_only(F.concat(words, tokens("org_type"))), 1),
    )
    surname = (F.size(title_words) >= 2) & F.exists(title_words, lambda w: w.rlike(f"(?:{'|'.join(SURNAME_ENDS)})$"))
    proper = points(
        renamed=(has("clustered") & (match_key("clustered") != match_key("descriptive")), 2),
        person=(F.trim(text("title")).rlike(LATIN_NAME) | surname, 2),
        placed=(has("settlement") & any_of(F.concat(words, tokens("clustered")), INSTITUTIONS), 2),
        venue=(has("venue"), 1),
    )
    scored = met.withColumns({"_p": proper, "_d": descriptive})
    p, d = F.col("_p"), F.col("_d")
    verdict = lambda t, c: F.struct(F.lit(t).alias("name_type"), F.lit(c).alias("confidence"))
    told = (
        F.when(F.col("_a").isNotNull() | F.col("_b").isNotNull(), verdict("proper_name", "high"))
        .when((d == 0) & (p >= 4), verdict("proper_name", "high"))
        .when((p == 0) & (d >= 4), verdict("descriptive_term", "high"))
        .when((p <= 1) & (d >= 2), verdict("descriptive_term", "medium"))
        .when((d <= 1) & (p >= 2), verdict("proper_name", "medium"))
        .otherwise(verdict("ambiguous", "low"))
    )
    return scored.withColumn("_t", told).select(*rows.columns, "_t.name_type", "_t.confidence")


def crosstab(rows: DataFrame) -> DataFrame:
    """Rows of each name type by confidence, zeros included."""
    return rows.groupBy("name_type").pivot("confidence", ["high", "medium", "low"]).count().na.fill(0)
