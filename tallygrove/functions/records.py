"""Fields of curated records: locations, organisation types, notes, entity ids, packed cells and geography."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import FINALS, MEDIALS, cells, normalize_yiddish, text

#: Spellings of organisation types.
TYPES = {
    "theater": "theatre",
    "theatre": "theatre",
    "טעאטער": "theatre",
    "טעאַטער": "theatre",
    "troupe": "troupe",
    "טרופע": "troupe",
    "טרופּע": "troupe",
    "טרופה": "troupe",
    "טרופעע": "troupe",
    "טעאטער-טרופע": "troupe",
    "טעאַטער-טרופע": "troupe",
    "טעאַטער-טרופּע": "troupe",
}
#: Adjectives of cities and the cities.
CITY_ADJECTIVES = {
    "ניו-יאָרקער": "ניו-יאָרק",
    "ברוקלינער": "ברוקלין",
    "וואַרשעווער": "וואַרשע",
    "לאָנדאָנער": "לאָנדאָן",
    "אָדעסער": "אָדעס",
    "מאָסקווער": "מאָסקווע",
    "קיעווער": "קיעוו",
    "וויענער": "וויען",
    "בוענאָס-איירעסער": "בוענאָס-איירעס",
    "פּאַריזער": "פּאַריז",
    "ווילנער": "ווילנע",
    "מינסקער": "מינסק",
    "ליטווישער": "ליטע",
    "באַקוער": "באַקו",
}
#: Types that have no settlement of their own.
ITINERANT = ("troupe", "טרופּע", "טעאַטער-טרופּע", "travelling company", "traveling company", "army", "ארמיי", "אַרמיי", "אַרמעע", "military", "expedition")


def folded(word: str) -> str:
    """normalize_yiddish of a constant."""
    bare = "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn")
    return " ".join(bare.split()).lower().replace("וו", "ו").translate(str.maketrans(FINALS, MEDIALS))


def lookup(values: Mapping[str, str], key: Column) -> Column:
    """values[key], or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def key(c: Column | str) -> Column:
    """Lower case, white space squeezed."""
    return F.lower(F.trim(F.regexp_replace(text(c), r"(?U)\s+", " ")))


def location_key(c: Column | str) -> Column:
    """A place name without the ending of its adjective, hyphens and spaces."""
    return normalize_yiddish(F.regexp_replace(F.regexp_replace(F.trim(text(c)), "ער$", ""), r"(?U)[-\s]+", ""))


def org_type(c: Column | str) -> Column:
    """The type in its usual spelling; others in lower case."""
    k = F.lower(F.trim(text(c)))
    return F.coalesce(lookup(TYPES, k), k)


def inferred_type(c: Column | str) -> Column:
    """The type that the first telling word of a name, or a part of it between hyphens, gives; else empty."""
    known = {folded(k): v for k, v in TYPES.items()}
    parts = F.flatten(F.transform(F.split(normalize_yiddish(c), " "), lambda w: F.concat(F.array(w), F.split(w, "-"))))
    return F.coalesce(F.get(F.filter(F.transform(parts, lambda w: lookup(known, w)), lambda x: x.isNotNull()), F.lit(0)), F.lit(""))


def adjective_place(c: Column | str) -> Column:
    """The settlement of a name that starts with a city's adjective; else empty."""
    return F.coalesce(lookup({folded(k): folded(v) for k, v in CITY_ADJECTIVES.items()}, F.split(normalize_yiddish(c), " ")[0]), F.lit(""))


def itinerant(c: Column | str) -> Column:
    return F.lower(F.trim(text(c))).isin(*ITINERANT)


def block_key(kind: Column | str, settlement: Column | str, city: Column | str) -> Column:
    """(type, settlement): where the settlement is blank, the city named in the name, but for types without one."""
    place = key(settlement)
    return F.struct(F.lower(F.trim(text(kind))).alias("kind"), F.when((place == "") & ~itinerant(kind), location_key(city)).otherwise(place).alias("place"))


def name_variants(c: Column | str) -> Column:
    """Parts of a name between spaced hyphens."""
    return F.filter(F.transform(F.split(text(c), r"(?U)\s+-\s+"), lambda x: F.trim(x)), lambda x: x != "")


def latin_words(c: Column | str) -> Column:
    return F.array_join(F.regexp_extract_all(text(c), F.lit("([A-Za-z]+)"), F.lit(1)), " ")


def as_text(c: Column | str) -> Column:
    """Trimmed; `nan` in any case is empty."""
    return F.when(F.lower(text(c)) == "nan", F.lit("")).otherwise(F.trim(text(c)))


def entity_url(c: Column | str, base: str = "https://www.wikidata.org/wiki/") -> Column:
    """Entity ids as addresses; everything else as it is."""
    t = as_text(c)
    return F.when(t.rlike(r"^Q\d+$"), F.concat(F.lit(base), t)).otherwise(t)


def first_qid(c: Column | str) -> Column:
    """The first Q and digits anywhere in a cell, or empty."""
    return F.regexp_extract(text(c), r"Q\d+", 0)


def note_tag(c: Column | str, tag: str) -> Column:
    """What stands in the note's `[tag: ...]`, or empty."""
    return F.trim(F.regexp_extract(text(c), rf"\[{tag}:\s*([^\]]*)\]", 1))


def without_tags(c: Column | str, tags: Sequence[str]) -> Column:
    return F.trim(F.regexp_replace(text(c), rf"\s*\[(?:{'|'.join(tags)}):[^\]]*\]", ""))


def with_tags(c: Column | str, **tags: Column) -> Column:
    """A note followed by a `[tag: value]` for each value that isn't blank."""
    marks = [F.when(F.trim(text(v)) != "", F.concat(F.lit(f"[{k}: "), F.trim(v), F.lit("]"))) for k, v in tags.items()]
    return F.concat_ws(" ", F.when(F.trim(text(c)) != "", F.trim(text(c))), *marks)


def first_score(c: Column | str) -> Column:
    """The first of packed scores as a number; zero where it is none."""
    return F.coalesce(F.get(cells(c), F.lit(0)).try_cast("double"), F.lit(0.0))


def authority_number(c: Column | str) -> Column:
    """The number before the first bar of a cell, or null."""
    head = F.trim(F.split(text(c), r"[|]")[0])
    return F.when(head.rlike(r"^\d+$"), head.try_cast("long"))


def xml_id(c: Column | str) -> Column:
    """What follows the first hyphen of a unique id; the whole where there is none."""
    t = F.trim(text(c))
    return F.when(F.instr(t, "-") > 0, F.regexp_replace(t, r"^[^-]*-", "")).otherwise(t)


def street_query(address: Column | str, city: Column | str) -> tuple[Column, Column]:
    """(query, fallback) for a geocoder: corners with an ampersand; then the first street alone."""
    a, c = F.trim(text(address)), F.trim(text(city))
    corner = F.regexp_replace(a, r"(?i)\b(?:and|und|corner(?:\s+of)?)\b", "&")
    return F.concat_ws(", ", F.nullif(corner, F.lit("")), F.nullif(c, F.lit(""))), F.concat_ws(", ", F.nullif(F.trim(F.split(corner, "&")[0]), F.lit("")), F.nullif(c, F.lit("")))


def deep_link(path: str, **fields: Column | str) -> Column:
    """A relative address with the fields as its query."""
    return F.concat(F.lit(f"{path}?"), F.concat_ws("&", *[F.concat(F.lit(f"{k}="), F.url_encode(text(v))) for k, v in fields.items()]))


def locations(packed: Column | str, settlement: Column | str, address: Column | str) -> Column:
    """Locations of a JSON cell; where it holds none, the one of the older columns."""
    kind = "array<struct<settlement: string, settlement_yiddish: string, address: string, address_romanized: string, lat: string, lon: string>>"
    got = F.from_json(text(packed), kind)
    old = F.struct(text(settlement).alias("settlement"), F.lit("").alias("settlement_yiddish"), text(address).alias("address"), F.lit("").alias("address_romanized"), F.lit("").alias("lat"), F.lit("").alias("lon"))
    return F.when(F.coalesce(F.size(got), F.lit(0)) > 0, got).otherwise(F.array(old).cast(kind))


def geo_status(lat: Column | str, lon: Column | str, address: Column | str, settlement: Column | str, country: Column | str) -> Column:
    has = lambda c: F.trim(text(c)) != ""
    return F.when(has(lat) & has(lon), "geolocated").when(has(address), "has_address").when(has(settlement), "has_settlement").when(has(country), "has_country").otherwise("none")


def score_band(c: Column) -> Column:
    return F.when(c >= 0.90, "high").when(c >= 0.85, "medium").otherwise("low")
