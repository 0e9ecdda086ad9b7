"""Quality rules: counts of each whole text, and a hashed n-gram log-likelihood ratio against a trusted target.

Words and neighbouring word pairs are hashed into a fixed number of buckets. Two multinomials over the buckets are
counted over every document: one of the trusted documents, one of the whole corpus. A document's score is the sum of
its n-grams' log ratios over their number; it is kept if it passes the base rules and scores at least the threshold,
which is read from the scores of all trusted documents, so every document meets the same fixed number. Weights and
scores are whole numbers, so sums don't depend on their order.

DataFrame functions only. Nulls count as empty texts, which fail the base rules. Each row, repeated or not, gives a
row; null ids are never trusted; labels may repeat an id (one good label is enough). Other columns are not carried by
scored(), and all are by keep(). An empty table gives no rows; with no trusted document all that pass the base rules
are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

BUCKETS = 8192
#: Weights are log ratios times this; scores per n-gram are counted in steps of 1 / STEPS.
UNIT, STEPS = 1_000_000, 1000
#: The share of trusted documents' scores below which a document is unlike them, and a margin below that score.
SHARE, MARGIN = 0.002, 0.02
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def line_repeats(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def with_ngrams(df: DataFrame, text: str = "text") -> DataFrame:
    """df with _words, the hashes of words (_one) and of neighbouring words (_two)."""
    df = df.withColumn("_words", words(F.col(text)))
    df = df.withColumn("_one", F.transform("_words", lambda w: F.xxhash64(w)))
    return df.withColumn("_two", pairs(F.col("_one"), F.size("_one") - 1))


def pairs(hashes: Column, n: Column) -> Column:
    """A hash of each of the first n elements with the element after it."""
    n = F.greatest(n, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(2), n), lambda a, b: F.xxhash64(a, b))


def repeated_words(df: DataFrame, out: str) -> DataFrame:
    """df of with_ngrams() with the number of words within 3-word windows that are found twice or more in the text.

    Windows are sorted by their hash, so that equal ones are neighbours; texts without any are told by a distinct count.
    """
    n = F.greatest(F.size("_one") - 2, F.lit(0))
    df = df.withColumn("_three", F.zip_with(F.slice("_two", F.lit(1), n), F.slice("_one", F.lit(3), n), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_three")) < F.size("_three"),
            F.sort_array(F.arrays_zip(F.col("_three").alias("h"), F.sequence(F.lit(0), F.size("_three") - 1).alias("i"))),
        ),
    )
    m = F.size("_sorted") - 1
    twins = F.zip_with(
        F.slice("_sorted", F.lit(1), m), F.slice("_sorted", F.lit(2), m), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))
    )
    df = df.withColumn("_at", F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull())))))
    m = F.size("_at") - 1
    gaps = F.zip_with(F.slice("_at", F.lit(1), m), F.slice("_at", F.lit(2), m), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.aggregate(gaps, F.lit(3).cast("long"), lambda s, x: s + x)
    return df.withColumn(out, F.when(F.col("_sorted").isNull(), F.lit(0).cast("long")).otherwise(covered)).drop("_three", "_sorted", "_at")


def bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("_id")).distinct()


def trusted_texts(labels: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _t1, _t2): trusted ids with the keys of their texts in `labelled`, whose rows the labels name."""
    k1, k2 = text_key(F.col(text))
    rows = labelled.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("_id"), k1.alias("_t1"), k2.alias("_t2"))
    return rows.join(trusted_ids(labels), "_id", "left_semi").distinct()


def is_trusted(trusted: DataFrame, key: str) -> Column:
    """Whether a row with the columns `key`, _k1 and _k2 is one of trusted_ids() or of trusted_texts()."""
    found = F.col(key) == F.col("_id")
    return found & (F.col("_k1") == F.col("_t1")) & (F.col("_k2") == F.col("_t2")) if "_t1" in trusted.columns else found


def weights(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> list[int]:
    """The log ratio of each bucket in units, from all n-grams of all documents; at most BUCKETS rows reach the driver."""
    chosen = docs.select(F.col(doc_id).cast("long").alias("_key"), F.col(text).alias("_text"))
    chosen = chosen.select("*", *text_key(F.col("_text"))) if "_t1" in trusted.columns else chosen
    marked = chosen.join(trusted.withColumn("_good", F.lit(1)).hint("merge"), is_trusted(trusted, "_key"), "left").select("_text", "_good")
    grams = with_ngrams(marked, "_text").select("_good", F.explode(F.concat("_one", "_two")).alias("h"))
    counts = grams.groupBy(bucket(F.col("h")).alias("b")).agg(F.count("*").alias("raw"), F.count("_good").alias("good"))
    total = F.broadcast(counts.agg(F.sum("raw").alias("all_raw"), F.sum("good").alias("all_good")).withColumn("one", F.lit(1)))
    told = counts.withColumn("one", F.lit(1)).join(total, "one")
    ratio = F.log((F.col("good") + 1) / (F.col("all_good") + BUCKETS)) - F.log((F.col("raw") + 1) / (F.col("all_raw") + BUCKETS))
    out = [0] * BUCKETS
    for r in told.select("b", F.when(F.col("all_good") > 0, F.round(ratio * UNIT)).otherwise(0).cast("long").alias("w")).collect():
        out[r.b] = r.w
    return out


def text_key(text: Column) -> list[Column]:
    """A text's 128-bit key in two numbers."""
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(7), text).alias("_k2")]


def scored(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, the four counts, base_failed, llr (per n-gram), kept."""
    return judged(docs, trusted_ids(labels), doc_id, text).drop("_k1", "_k2")


def judged(docs: DataFrame, trusted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """scored() with the key of each row's text."""
    table = F.expr(f"cast(split('{','.join(map(str, weights(docs, trusted, doc_id, text)))}', ',') as array<bigint>)")
    df = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    df = repeated_words(with_ngrams(df, "_text"), "n_repeat_words")
    n = F.size("_one").cast("long")
    whole = F.coalesce(F.col("_text"), F.lit(""))
    total = F.aggregate(F.concat("_one", "_two"), F.lit(0).cast("long"), lambda s, h: s + F.get(table, bucket(h)))
    count = (F.size("_one") + F.size("_two")).cast("long")
    df = df.select(
        "doc_id",
        *text_key(F.col("_text")),
        n.alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        line_repeats(F.col("_text")).alias("n_dup_lines"),
        "n_repeat_words",
        F.floor(total * STEPS / (F.greatest(count, F.lit(1).cast("long")) * UNIT)).cast("long").alias("_score"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    df = written(df.withColumn("base_failed", failed), "quality")
    least = threshold(df, trusted)
    kept = ~F.col("base_failed") & (F.col("_score") >= F.lit(least))
    return df.select(*[c for c in df.columns if c != "_score"], (F.col("_score") / STEPS).alias("llr"), kept.alias("kept"))


def threshold(scores: DataFrame, trusted: DataFrame) -> int:
    """The score that all but SHARE of the trusted documents that pass the base rules reach, less the margin, in steps.

    The scores are counted by step first, so a bounded number of rows reaches the driver.
    """
    good = scores.where("not base_failed").join(trusted, is_trusted(trusted, "doc_id"), "left_semi")
    counts = sorted((r["_score"], r["count"]) for r in good.groupBy("_score").count().collect())
    below, least = SHARE * sum(n for _, n in counts), -(10**9)
    for score, n in counts:
        least, below = score, below - n
        if below < 0:
            break
    return least - round(MARGIN * STEPS)


def keep(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """docs without the rows whose own text the rules reject: rows that share an id are each judged by their text. Rows with a null id stay.

    The labels name rows of `labelled` (doc_id, text; None: docs): a row of docs with one's id and another text isn't trusted.
    """
    trusted = trusted_ids(labels) if labelled is None else written(trusted_texts(labels, labelled, doc_id, text), "trusted")
    gone = judged(docs, trusted, doc_id, text).where("not kept").select("_k1", "_k2").distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *text_key(F.col(f"`{text}`")))
    rejected = (whole["_k1"] == gone["_k1"]) & (whole["_k2"] == gone["_k2"]) & F.col("_row")[doc_id].isNotNull()
    return whole.join(gone, rejected, "left_anti").select("_row.*")
