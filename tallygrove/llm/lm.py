"""Document likelihood over subword lattices.

The pieces and ranks of an existing vocabulary give the arcs of a word's lattice: every segmentation of the word into
pieces, with single bytes as the last resort. Their scores start from the vocabulary's ranks and are re-estimated once
from the expected uses over all different words of the training documents. The forward recursion, in log space, gives
the probability of a word summed over its segmentations. Words of the training documents also have an arc of their own
with the share they have there; the pieces' part has the share of words met for the first time (Witten and Bell).
What a text has said already makes it likelier again: its tokens come from an urn that starts with CONCENTRATION parts
of these shares and gets one part of each token drawn (Polya), so the model gives each text, as a sequence of words and
an end, a proper probability: that is `score`. The base score isn't one of texts: all words that it doesn't know are one
class to it, at the price of a word met once. `closed_score` is the model's probability of just what the base scores,
words with all unknown ones as one class, and so the one to compare with the base.

Counts cover all documents; the driver only sees one row per piece and the words that are at least one in HOT of all.
Those are looked up in the tasks; other words are joined by shuffles, after counting them within each document.

Nulls count as empty texts: just an end. A null id is part of the training. Each row gives a row, whatever its id;
other columns are not carried. Without training documents words have their pieces' probability alone. An empty table
gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Words that are at least one in so many tokens are looked up in tasks: so many words at most.
HOT = 60_000
#: Different words counted by a task before it hands its counts on.
FLUSH = 200_000
#: Parts of the corpus' shares in a text's urn.
CONCENTRATION = 1000
LOG10 = math.log(10)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[bytes, float]:
    """Log probability of each piece by the vocabulary's own ranks (Zipf's law); single bytes come last."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    rank: dict[bytes, int] = {}
    for k in range(m.get_piece_size()):
        if not (m.is_control(k) or m.is_unknown(k) or m.is_byte(k)):
            piece = m.id_to_piece(k).encode()
            rank[piece] = min(rank.get(piece, 1 << 30), int(-m.get_score(k)))
    for b in range(256):
        rank.setdefault(bytes([b]), m.get_piece_size())
    total = sum(1 / (r + 10) for r in rank.values())
    return {x: math.log(1 / (r + 10) / total) for x, r in rank.items()}


class Lattice:
    """Lattices of words: a mark for the word's begin, then its bytes.

    The recursions over words of so few bytes that no product can come near the smallest float (`short`) go by
    probabilities themselves, the others by logarithms.
    """

    def __init__(self, pieces: dict[bytes, float], stop: float):
        import ahocorasick

        self.find = ahocorasick.Automaton()
        for x, p in pieces.items():
            p += math.log1p(-stop)
            self.find.add_word(x.decode("latin-1"), (x, len(x), p, math.exp(p)))
        self.find.make_automaton()
        self.short = int(600 / max(1.0, -min(pieces.values()) - math.log1p(-stop)))
        self.last = math.log(stop) - math.log1p(-stop)

    def plainly(self, raw: bytes) -> tuple[list[float], list]:
        """Probabilities of the prefixes, over all segmentations, and the arcs in order of their ends."""
        a = [0.0] * (len(raw) + 1)
        a[0] = 1.0
        arcs = list(self.find.iter(raw.decode("latin-1")))
        for end, (_, n, _, q) in arcs:
            a[end + 1] += a[end + 1 - n] * q
        return a, arcs

    def forward(self, raw: bytes) -> tuple[list[float], list]:
        """plainly() with the logarithms of the probabilities."""
        a = [-math.inf] * (len(raw) + 1)
        a[0] = 0.0
        arcs = list(self.find.iter(raw.decode("latin-1")))
        exp, log1p = math.exp, math.log1p
        for end, (_, n, p, _) in arcs:
            x, y = a[end + 1 - n] + p, a[end + 1]
            if x > y:
                x, y = y, x
            a[end + 1] = y if x == -math.inf else y + log1p(exp(x - y))
        return a, arcs

    def log_probability(self, word: str) -> float:
        raw = b"\xe2\x96\x81" + word.encode()
        return (math.log(self.plainly(raw)[0][-1]) if len(raw) <= self.short else self.forward(raw)[0][-1]) + self.last

    def expected(self, word: str, into: Counter, times: int = 1) -> None:
        """Adds the expected number of times that each piece is used in the word."""
        raw = b"\xe2\x96\x81" + word.encode()
        if len(raw) <= self.short:
            a, arcs = self.plainly(raw)
            b = [0.0] * len(a)
            b[-1] = times / a[-1]
            for end, (piece, n, _, q) in reversed(arcs):
                x = b[end + 1] * q
                if x:
                    start = end + 1 - n
                    b[start] += x
                    into[piece] += a[start] * x
            return
        a, arcs = self.forward(raw)
        b = [-math.inf] * len(a)
        b[-1] = 0.0
        for end, (piece, n, p, _) in reversed(arcs):
            start, x = end + 1 - n, b[end + 1] + p
            if a[start] > -math.inf and x > -math.inf:
                into[piece] += times * math.exp(a[start] + x - a[-1])
                y = b[start]
                if x > y:
                    x, y = y, x
                b[start] = y if x == -math.inf else y + math.log1p(math.exp(x - y))


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for x >= 1: Stirling's series at x + 7, to ten digits."""
    x = x.cast("double")
    z, below = x + 7, x
    for k in range(1, 7):
        below = below * (x + k)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - F.log(below)


def words(text: str | None) -> list[str]:
    """Words of a text with A-Z in lower case."""
    return [w.decode() for w in (text or "").encode().lower().split()]


def is_held_out(doc_id: int | None, modulus: int, rest: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == rest


def word_counts(docs: DataFrame, modulus: int, rest: int) -> DataFrame:
    """(word, c): every word of all documents with its count in the training documents; null stands for the end."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = Counter(), Counter()

        def rows() -> pa.RecordBatch:
            every = list(held.keys() | seen.keys())
            batch = pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([seen[w] for w in every], pa.int64())], names=["word", "c"])
            held.clear()
            seen.clear()
            return batch

        for b in batches:
            for key, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                into = held if is_held_out(key, modulus, rest) else seen
                into.update(words(text))
                into[None] += 1
                if len(held) + len(seen) > FLUSH:
                    yield rows()
        yield rows()

    return docs.mapInArrow(each, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def scored(docs: DataFrame, modulus: int = 7, rest: int = 2, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and closed_score, all logarithms to base 10."""
    path = path or default_path()
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counted = written(word_counts(docs, modulus, rest), "words")
    total = counted.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.expr("c > 0 and word is not null")).alias("types")).first()
    n, v = total.n or 0, total.v or 0
    new = v / (n + v) if n else 1.0
    vocabulary_, lattice = vocabulary(path), None

    def uses(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, into = Lattice(vocabulary(path), 0.25), Counter()
        for b in batches:
            for w in b["word"].to_pylist():
                model.expected(w, into)
        yield pa.RecordBatch.from_arrays([pa.array(list(into), pa.binary()), pa.array(list(into.values()), pa.float64())], names=["piece", "n"])

    known = counted.where("c > 0 and word is not null").select("word")
    found = {bytes(r.piece): r.n for r in known.mapInArrow(uses, "piece binary, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()}
    all_uses = sum(found.values()) + 0.1 * len(vocabulary_)
    pieces = {x: math.log((found.get(x, 0.0) + 0.1) / all_uses) for x in vocabulary_}
    stop = min(0.9, max(0.01, total.types / all_uses)) if total.types else 0.25

    def chances(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Lattice(pieces, stop)
        for b in batches:
            out = []
            for w, c in zip(b["word"].to_pylist(), b["c"].to_pylist(), strict=True):
                own = math.log((1 - new) * c / n) if c else -math.inf
                spelt = -math.inf if w is None else model.log_probability(w) + math.log(new)
                x, y = min(own, spelt), max(own, spelt)
                out.append((y + math.log1p(math.exp(x - y)) if y > -math.inf else math.log(new)) / LOG10)
            yield pa.RecordBatch.from_arrays([b["word"], b["c"], pa.array(out, pa.float64())], names=["word", "c", "p"])

    told = written(counted.mapInArrow(chances, "word string, c long, p double"), "chances")
    base = -math.log10(n + v + 1)
    own = math.log10((1 - new) / n) if n else 0.0  # of a known word, besides its count
    hot = {
        r.word: (int(r.c > 0), math.log10(r.c + 1), math.log10(max(r.c, 1)), r.p * LOG10 + math.log(CONCENTRATION))
        for r in told.where(((F.col("c") > 0) & (F.col("c") * HOT >= F.lit(n))) | F.col("word").isNull()).collect()
    }
    end = hot.get(None, (0, 0.0, 0.0, math.log(new * CONCENTRATION)))

    def terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with what its end and hot words give, and a row for each of its other words."""
        from pyspark import TaskContext

        row, exp, lgamma, get = TaskContext.get().partitionId() << 36, math.exp, math.lgamma, hot.get
        for b in batches:
            for k in range(0, b.num_rows, 500):
                s = b.slice(k, 500)
                rows, rare, times, got = [], [], [], []  # of its other words; of documents
                for key, text in zip(s["doc_id"].to_pylist(), s["text"].to_pylist(), strict=True):
                    tokens, (known, low, met, high) = 1, end
                    for w, m in Counter(words(text)).items():
                        tokens += m
                        if told := get(w):
                            known += m
                            low += m * told[1]
                            met += m * told[2]
                            if m == 1:
                                high += told[3]
                            else:
                                parts = exp(told[3])
                                high += lgamma(parts + m) - lgamma(parts)
                        else:
                            rare.append(w)
                            times.append(m)
                    rows += [row] * (len(rare) - len(rows))
                    got.append((row, key, None, tokens, known, low, met, high))
                    row += 1
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                names = ["row", "doc_id", "word", "m", "known", "low", "met", "high"]
                for n_rows, columns in ((len(rare), (rows, None, rare, times, None, None, None, None)), (len(got), zip(*got, strict=True))):
                    made = [pa.nulls(n_rows, k) if x is None else pa.array(x, k) for x, k in zip(columns, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(made, names=names)

    found = written(docs.mapInArrow(terms, "row long, doc_id long, word string, m long, known long, low double, met double, high double"), "terms")
    rare = found.where("word is not null").select("row", "word", "m").join(told, "word")
    parts = CONCENTRATION * F.pow(F.lit(10.0), "p")  # of the urn
    again = F.when(F.col("m") > 1, log_gamma(parts + F.col("m")) - log_gamma(parts + 1)).otherwise(0.0)
    rare = rare.select(
        "row", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("tokens"), F.when(F.col("c") > 0, F.col("m")).otherwise(0).alias("known"),
        (F.col("m") * F.log10(F.col("c") + 1)).alias("low"), (F.col("m") * F.log10(F.greatest("c", F.lit(1)))).alias("met"),
        (F.col("p") * LOG10 + math.log(CONCENTRATION) + again).alias("high"),
    )
    whole = found.where("word is null").select("row", "doc_id", F.col("m").alias("tokens"), "known", "low", "met", "high")
    names = ("tokens", "known", "low", "met", "high")
    sums = whole.unionByName(rare).groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in names])
    drawn = log_gamma(F.lit(CONCENTRATION) + F.col("tokens")) - math.lgamma(CONCENTRATION)
    unknown = F.col("tokens") - F.col("known")
    return sums.select(
        "doc_id", held_out(F.col("doc_id"), modulus, rest).alias("held_out"), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("low") + F.col("tokens") * F.lit(base)).alias("base_score"),
        ((F.col("high") - drawn) / LOG10).alias("score"), (F.col("met") + F.col("known") * F.lit(own) + unknown * F.lit(math.log10(new))).alias("closed_score"),
    )


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == rest, F.lit(False))
