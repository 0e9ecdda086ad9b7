"""Text normalisers, array cells and similarities as Column expressions; blank and null are both the empty string."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that mean "missing".
MISSING = ("", "na", "n/a", "null", "none", "-", "--", "_")
#: Final letters of the Hebrew script and their medial forms.
FINALS, MEDIALS = "ךןףץם", "כנפצמ"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_text(c: Column | str) -> Column:
    """Lower case; whatever is no letter, digit, underscore, geresh or apostrophe becomes a space."""
    return squeeze(F.regexp_replace(F.lower(text(c)), r"[^\p{L}\p{N}_\s׳']+", " "))


def match_key(c: Column | str) -> Column:
    return F.translate(clean_text(c), "׳'", "")


def tokens(c: Column | str) -> Column:
    return F.filter(F.split(clean_text(c), " "), lambda t: t != "")


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str]:
    """From and to strings for translate(): marks that NFD separates are dropped, letters lose theirs."""
    one, gone = [], []
    for k in range(0x80, 0x10000):
        if 0xD800 <= k < 0xE000 or 0xAC00 <= k < 0xD7A4:
            continue
        ch = chr(k)
        base = "".join(x for x in unicodedata.normalize("NFD", ch) if unicodedata.category(x) != "Mn")
        if not base:
            gone.append(ch)
        elif base != ch and len(base) == 1:
            one.append((ch, base))
    return "".join(a for a, _ in one) + "".join(gone), "".join(b for _, b in one)


def normalize_name(c: Column | str) -> Column:
    """Without combining marks, in lower case, white space squeezed."""
    return F.lower(squeeze(F.translate(text(c), *fold_table())))


def normalize_yiddish(c: Column | str) -> Column:
    return F.translate(F.replace(normalize_name(c), F.lit("וו"), F.lit("ו")), FINALS, MEDIALS)


def is_missing(c: Column | str, names: tuple[str, ...] = MISSING) -> Column:
    return F.lower(F.trim(text(c))).isin(*names)


def best_name(*columns: str) -> Column:
    """The first that is not missing, trimmed; else empty."""
    return F.coalesce(*[F.when(~is_missing(c), F.trim(F.col(c))) for c in columns], F.lit(""))


def summary(*columns: str, sep: str = " · ") -> Column:
    """The different values that are not missing, in order, joined."""
    return F.array_join(F.array_distinct(F.array_compact(F.array(*[F.when(~is_missing(c), F.trim(F.col(c))) for c in columns]))), sep)


def split_place(c: Column | str) -> tuple[Column, Column]:
    """(name, place) of `Name (Place)` or `Name אין Place`; the place is empty where there is none."""
    whole, paren, word = F.trim(text(c)), r"^(.*?)\s*\(([^)]+)\)\s*$", r"^(.*)\s+אין\s+(.+)$"
    pick = lambda k: F.when(whole.rlike(paren), F.regexp_extract(whole, paren, k)).when(whole.rlike(word), F.regexp_extract(whole, word, k))
    return F.coalesce(F.trim(pick(1)), whole), F.coalesce(F.trim(pick(2)), F.lit(""))


def cells(c: Column | str, sep: str = r"[|]") -> Column:
    """The parts of a packed cell, trimmed, without blanks."""
    return F.filter(F.transform(F.split(text(c), sep), lambda x: F.trim(x)), lambda x: x != "")


def qids(c: Column | str) -> Column:
    """Entity ids in a cell, as Q and a number without leading zeros, each once, in order."""
    found = F.filter(F.split(text(c), r"[|;,\s]+"), lambda t: t.rlike(r"^[Qq]\d+$"))
    return F.array_distinct(F.transform(found, lambda t: F.concat(F.lit("Q"), F.substring(t, 2, 18).cast("bigint").cast("string"))))


#: Articles and words for "of" in folded spelling.
ARTICLES = ("דער", "די", "דאס", "דעמ", "der", "di", "dos")
OF = ("פונ", "fun", "fon", "von", "of", "from")
#: Generic words of organisations in folded spelling.
GENERIC = ("טרופע", "טרופה", "טרופעע", "טעאטער", "טעאטער-טרופע", "troupe", "theatre", "theater", "פאריינ", "פארבאנד", "געזעלשאפט", "קאמיטעט", "שול", "סטודיע")


def aliases(c: Column | str, articles: tuple[str, ...] = ARTICLES, generic: tuple[str, ...] = GENERIC) -> Column:
    """A folded name, without its article, without a trailing generic word, without a leading generic word and `of`, and
    each of these without a possessive ending of its first word. Blank names have none."""
    base = normalize_yiddish(c)
    words = F.split(base, " ")
    n = F.size(words)
    part = lambda k, m: F.array_join(F.slice(words, k, m), " ")
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    plain = [base, F.when((n > 1) & first.isin(*articles), part(F.lit(2), n - 1))]
    if generic:
        plain.append(F.when((n > 1) & last.isin(*generic), part(F.lit(1), n - 1)))
        plain.append(F.when((n > 2) & first.isin(*generic) & F.get(words, F.lit(1)).isin(*OF), part(F.lit(3), n - 2)))
    found = F.array_compact(F.array(*plain))
    owned = F.filter(F.transform(found, lambda x: F.regexp_replace(x, "^([^ ]+)[׳'][sס](?= |$)", "$1")), lambda x: x != "")
    return F.filter(F.array_distinct(F.concat(found, owned)), lambda x: x != "")


def trigrams(c: Column) -> Column:
    """The different three-character pieces of a normalised name; empty if it is shorter."""
    n = F.length(c)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda k: F.substring(c, k, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of trigram sets of normalised names; of token sets where one is shorter than three characters."""
    short = (F.length(a) < 3) | (F.length(b) < 3)
    words = lambda x: F.array_distinct(F.split(x, " "))
    x, y = F.when(short, words(a)).otherwise(trigrams(a)), F.when(short, words(b)).otherwise(trigrams(b))
    ratio = F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(ratio)
