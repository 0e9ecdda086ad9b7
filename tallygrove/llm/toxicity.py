"""Toxicity by a gap-weighted subsequence kernel with Nyström landmarks and a linear support vector machine.

The kernel compares two strings by the three-character subsequences that they share, each weighted by a decay to the
power of the stretch it spans (seven characters at most) and divided by both strings' norms, so characters
put into or left out of an insult lower the similarity a little instead of hiding it. The letters a to z have numbers of
their own; all other characters share 36, so words of other scripts may be taken for one another. Landmarks are the words that
tell the labelled documents apart best, chosen to differ from one another. A sentence's similarity to a landmark is
that of its closest word, or run of single characters; the Nyström map whitens these similarities, and the machine is
trained on labelled sentences: all that come near a landmark, with the label of their document, and one without for each
document that has none or is clean. A document's score is the calibrated decision on its worst sentence.

The machine is fitted on a bounded sample of labelled rows (TRAIN_DOCS, by hash of the id). Everything
else reads whole texts of all rows. Nulls count as empty texts, which score as a sentence near no landmark. Rows with
a null id are scored and never trained on; repeated ids each give a row; labels that repeat an id count as toxic if
one of them does. Columns of other names are not carried by score(), and all are by keep(). An empty table gives no
rows; without labels of both classes every score is 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .rows import map_batches

#: Labelled rows that the machine is fitted on, at most; they keep the classes' shares.
TRAIN_DOCS = 10_000
#: Candidate words that reach the driver, landmarks, and the similarity above which one landmark stands for another.
CANDIDATES, LANDMARKS, ALIKE = 600, 96, 0.8
DECAY, SPAN = 0.8, 7
#: A word counts as far from all landmarks if none of its similarities reaches this.
FAINT = 0.5
#: The kernel's power: a product of the kernel with itself, which is a kernel too and tells a letter more or less from other words.
POWER = 5
#: A landmark is a known insult if this share of the toxic training documents hold it (three of them at least), and so many times as many as
#: clean ones. With LETTERS put between its letters, or one of them left out, it is a toxic training sentence of its own, counted BENT times, which
#: tells the machine how far to bend; in the calibration these weigh as much as this share of the toxic documents.
KNOWN, TIMES, LETTERS, BENT, SHARE = 0.05, 9, "aext", 3, 0.2
#: The machine's cost of a training sentence on the wrong side.
COST = 300.0
#: Longest word looked at as one; longer ones are cut to pieces that overlap by half.
LONGEST = 32
#: Words kept by a task before its store is emptied.
STORE_WORDS = 280_000
#: Signs that stand for letters.
LOOKS = str.maketrans("0134578@$", "oieastbas")
_edges = re.compile(r"^[\W_]+|[\W_]+$")
_sentence = re.compile(r"(?<=[.!?])\s+|\n+")
_inside = re.compile(r"(?<=\w)[\W_]+(?=\w)")
_again = re.compile(r"(.)\1+")
_single = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")


def symbols(words: list[str]) -> np.ndarray:
    """Rows of character numbers (2 to 63, 1 before the first), filled up with 0; a to z have numbers of their own."""
    codes = np.array(words)
    codes = codes.view("<u4").reshape(len(words), -1).astype(np.int32) if codes.itemsize else np.zeros((len(words), 1), np.int32)
    letter = (codes >= 97) & (codes <= 122)
    number = np.where(letter, codes - 95, np.where(codes > 0, 28 + codes % 36, 0))
    return np.hstack([np.ones((len(words), 1), np.int32), number])


def subsequences(s: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each stretch and middle place, the numbers of the subsequences that begin at each column (0: none) and their weight."""
    n = s.shape[1]
    for b in range(2, min(SPAN, n)):
        first, last = s[:, : n - b], s[:, b:]
        for a in range(1, b):
            middle = s[:, a : n - b + a]
            yield np.where(last > 0, (first << 12) | (middle << 6) | last, 0), DECAY ** (b + 1)


@lru_cache(maxsize=1)
def lengths_weight(n: int = LONGEST + 2) -> np.ndarray:
    """By number of symbols, the norm of a string whose subsequences all differ; no string's is less."""
    out = np.ones(n + 1)
    for k in range(3, n + 1):
        out[k] = np.sqrt(sum((k - b) * (b - 1) * DECAY ** (2 * b + 2) for b in range(2, min(SPAN, k))))
    return out


def norms(s: np.ndarray) -> np.ndarray:
    """The norm of each string, equal subsequences taken together; 1 for strings without any."""
    keys, weights = [np.zeros(0, np.int64)], [np.zeros(0)]
    for ids, weight in subsequences(s):
        who, _ = at = np.nonzero(ids)
        keys.append(who << 18 | ids[at])
        weights.append(np.full(len(who), weight))
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    out = np.sqrt(np.bincount(key >> 18, np.bincount(place, np.concatenate(weights), len(key)) ** 2, len(s)))
    return np.where(out > 0, out, 1.0)


class Kernel:
    """Similarities of words to landmarks; a word with none of `faint` or more counts as near none."""

    def __init__(self, landmarks: list[str], faint: float = FAINT):
        self.landmarks, self.faint = landmarks, faint
        found: dict[int, np.ndarray] = {}
        s = symbols(landmarks)
        norm = norms(s)
        for ids, weight in subsequences(s):
            for row, column in zip(*np.nonzero(ids), strict=True):
                found.setdefault(int(ids[row, column]), np.zeros(len(landmarks)))[row] += weight / norm[row]
        self.row = np.zeros(1 << 18, dtype=np.int32)
        self.table = np.zeros((len(found) + 1, len(landmarks)), dtype=np.float32)
        for k, (x, v) in enumerate(found.items(), 1):
            self.row[x] = k
            self.table[k] = v

    def __call__(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.landmarks)), dtype=np.float32)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))  # words of like length need little filling up
        for k in range(0, len(words), 2048):
            some = order[k : k + 2048]
            found = np.zeros((len(some), len(self.landmarks)), dtype=np.float32)
            self._some([words[x] for x in some], found)
            out[some] = found
        return out

    def _some(self, words: list[str], out: np.ndarray) -> None:
        s = symbols(words)
        hits = [[], [], []]
        for ids, weight in subsequences(s):
            rows = self.row[ids]
            who, _ = at = np.nonzero(rows)
            for x, v in zip(hits, (who, rows[at], np.full(len(who), weight, np.float32)), strict=True):
                x.append(v)
        if not hits[0]:
            return
        who, rows, weight = (np.concatenate(x) for x in hits)
        # only words with enough shared weight can come near a landmark
        most = np.bincount(who, weight * self.table.max(axis=1)[rows], len(words)) / lengths_weight()[(s > 0).sum(axis=1)]
        near = np.flatnonzero(most >= self.faint)
        place = np.full(len(words), -1)
        place[near] = np.arange(len(near))
        keep = place[who] >= 0
        who, rows, weight = place[who[keep]], rows[keep], weight[keep]
        order = np.argsort(who, kind="stable")
        who, rows, weight = who[order], rows[order], weight[order]
        begins = np.searchsorted(who, np.arange(len(near)))
        ends = np.searchsorted(who, np.arange(len(near)), side="right")
        for k, (a, b) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
            out[near[k]] = weight[a:b] @ self.table[rows[a:b]]
        out[near] /= norms(s[near])[:, None].astype(np.float32)
        out[out.max(axis=1) < self.faint] = 0
        np.power(out, POWER, out=out)


def cut(word: str) -> list[str]:
    return [word] if len(word) <= LONGEST else [word[k : k + LONGEST] for k in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def forms(word: str) -> Iterator[str]:
    """A word without marks at its ends; where it differs, also with letters once that are repeated, without marks inside, and with letters for signs that look like them."""
    if word.isalpha():
        yield from cut(word)
        if (once := _again.sub(r"\1", word)) != word:
            yield from cut(once)
        return
    bare = _edges.sub("", word)
    yield from cut(bare)
    if not bare.isalnum() and bare:
        yield from cut(_inside.sub("", bare))
    if (told := _edges.sub("", word.translate(LOOKS))) != bare and not bare.isdecimal():
        yield from cut(told)


def gapped(text: str) -> list[str]:
    """Runs of three single characters or more."""
    return [m[0] for m in _single.finditer(text)]


@dataclass
class Machine:
    """A trained machine; plain arrays, so it travels to tasks as a value of bounded size."""

    landmarks: list[str]
    whiten: np.ndarray
    weight: np.ndarray
    bias: float
    decision: np.ndarray
    chance: np.ndarray

    def decide(self, features: np.ndarray) -> np.ndarray:
        return features @ (self.whiten @ self.weight) + self.bias

    def probability(self, decision: np.ndarray) -> np.ndarray:
        return np.interp(decision, self.decision, self.chance)


class Features:
    """Sentence features in a task; words far from all landmarks are only remembered as such."""

    def __init__(self, landmarks: list[str]):
        self.kernel = Kernel(landmarks)
        self.far: set[str] = set()
        self.near: dict[str, np.ndarray] = {}

    def look_at(self, words: list[str], of) -> dict[str, np.ndarray]:
        """The similarities of those words that come near a landmark in any of their forms, which of() gives."""
        owner, found = [], []
        for k, w in enumerate(words):
            for u in of(w):
                owner.append(k)
                found.append(u)
        out: dict[str, np.ndarray] = {}
        if found:
            v = self.kernel(found)
            for j in np.flatnonzero(v.any(axis=1)).tolist():
                w = words[owner[j]]
                out[w] = np.maximum(out[w], v[j]) if w in out else v[j].copy()  # a view would keep all rows of v
        return out

    def learn(self, texts: list[str]) -> None:
        if len(self.far) + len(self.near) > STORE_WORDS:
            self.far, self.near = set(), {}
        new = list(set().union(*map(str.split, texts)).difference(self.far).difference(self.near))
        found = self.look_at(new, forms)
        self.near.update(found)
        self.far.update(w for w in new if w not in found)

    def sentences(self, text: str) -> np.ndarray:
        """A row for each sentence with a word near a landmark; text is lower-cased and learnt."""
        words, near, rows = set(text.split()), self.near, []
        single = any(len(w) == 1 for w in words)
        if single or not words.isdisjoint(near):
            for x in _sentence.split(text):
                hot = [near[w] for w in x.split() if w in near]
                if single and (runs := gapped(x)):
                    hot += self.look_at(runs, lambda run: cut("".join(run.split()))).values()
                if hot:
                    rows.append(hot[0] if len(hot) == 1 else np.max(hot, axis=0))
        return np.array(rows, dtype=np.float32).reshape(-1, len(self.kernel.landmarks))


@lru_cache(maxsize=1)
def features(landmarks: tuple[str, ...]) -> Features:
    return Features(list(landmarks))


def sample(docs: DataFrame, labels: DataFrame, train) -> DataFrame:
    """(text, toxic) of a bounded sample of the labelled rows that `train`, a condition on _id, allows; labels but 0 and 1 count as none."""
    told = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    told = told.where(train)
    ids = F.broadcast(told.orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_DOCS))  # so many rows of two numbers at most
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(ids, "_id").select("text", "toxic")


def choose_landmarks(rows: DataFrame) -> tuple[list[str], list[str]]:
    """Landmarks, and those of them that are known insults: words of toxic documents that tell the classes apart beyond chance (likelihood ratio), best first, each unlike those before it."""
    word = F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("word")
    bare = F.regexp_replace("word", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").alias("word")
    found = rows.select("toxic", word).select("toxic", bare).where(F.length("word").between(3, LONGEST))
    counts = found.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).where("bad + good >= 3")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    every = n[0] + n[1]
    share = lambda seen, of, size: F.when(seen > 0, 2 * seen * F.log(seen * every / (of * size))).otherwise(0.0)
    bad, good = F.col("bad"), F.col("good")
    met, not_met = bad + good, every - bad - good
    gain = share(bad, met, n[1]) + share(good, met, n[0]) + share(n[1] - bad, not_met, n[1]) + share(n[0] - good, not_met, n[0])
    # of as many words as are looked at, about one would come so far by chance
    tested = counts.count()
    best = counts.where(bad * n[0] > good * n[1]).select("word", "bad", "good", gain.alias("gain")).where(F.col("gain") > 2 * np.log(max(tested, 1)))
    found_rows = best.orderBy(F.desc("gain"), "word").limit(CANDIDATES).collect()
    names = [r.word for r in found_rows]
    if not names:
        return [], []
    alike, chosen = Kernel(names)(names), []
    for k in range(len(names)):
        if all(alike[k, j] < ALIKE for j in chosen):
            chosen.append(k)
        if len(chosen) == LANDMARKS:
            break
    told = {r.word: r for r in found_rows}
    known = [names[k] for k in chosen if told[names[k]].bad >= max(3, KNOWN * n[1], TIMES * told[names[k]].good)]
    return [names[k] for k in chosen], known


def damaged(word: str) -> list[str]:
    """The word with a letter put between two of its letters, or one of its inner letters left out."""
    return [word[:k] + x + word[k:] for k in range(1, len(word)) for x in LETTERS] + [word[:k] + word[k + 1 :] for k in range(1, len(word) - 1)]


Sums = tuple[float, np.ndarray, np.ndarray]


def hinge(a: np.ndarray, y: np.ndarray, c: np.ndarray, w: np.ndarray) -> Sums:
    """The squared hinge loss of rows with a column of ones, and on the rows within the margin the sums that a Newton step needs."""
    short = np.maximum(0, 1 - y * (a @ w))
    on = short > 0
    return float((c * short**2).sum() / 2), (a[on] * c[on, None]).T @ y[on], (a[on] * c[on, None]).T @ a[on]


def newton(sums: Callable[[np.ndarray], Sums], n: int, steps: int = 60) -> np.ndarray:
    """The weights, the bias last, of the least squared hinge loss with a ridge; sums() gives hinge() of all rows at some weights."""
    ridge = np.diag([1.0] * (n - 1) + [1e-3])
    w = np.zeros(n)
    loss, g, h = sums(w)
    for _ in range(steps):
        move, size = np.linalg.solve(h + ridge, g) - w, 1.0
        while size > 1e-3:
            at = w + size * move
            new, g2, h2 = sums(at)
            if new + at @ ridge @ at / 2 <= loss + w @ ridge @ w / 2:
                break
            size /= 2
        else:
            break
        before, after = loss + w @ ridge @ w / 2, new + at @ ridge @ at / 2
        w, loss, g, h = at, new, g2, h2
        if before - after < 1e-4 * before:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, train) -> Machine | None:
    """A machine from the labels that `train` allows, or None without both classes."""
    rows = written(sample(docs, labels, train), "train")
    if rows.select("toxic").distinct().count() < 2:
        return None
    landmarks, known = choose_landmarks(rows)
    if not landmarks:
        return None

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = features(tuple(landmarks))
        for b in batches:
            for k in range(0, b.num_rows, 200):
                texts = [x.lower() for x in b["text"].slice(k, 200).to_pylist()]
                f.learn(texts)
                for text, toxic in zip(texts, b["toxic"].slice(k, 200).to_pylist(), strict=True):
                    x = np.unique(f.sentences(text), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array([toxic], pa.int32()), pa.array([x.astype("<f4").tobytes()])], names=["toxic", "x"])

    bags = written(rows.repartition(16).mapInArrow(each, "toxic int, x binary"), "bags")
    m = len(landmarks)
    gram = Kernel(landmarks, 0.0)(landmarks).astype(float)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    good = value > 1e-3 * value.max()
    whiten = vector[:, good] / np.sqrt(value[good])
    bent = Kernel(landmarks)([v for w in known for v in damaged(w)]) if known else np.zeros((0, m), np.float32)
    bent = bent[bent.any(axis=1)]
    # a toxic document's sentences near a landmark are toxic, or it has one without; a clean document has one without besides its own
    n, toxic = F.octet_length("x") / (4 * m), F.col("toxic") == 1
    many = bags.agg(F.sum(F.when(toxic, F.greatest(n, F.lit(1)))).alias("bad"), F.sum(F.when(~toxic, n + 1)).alias("good")).first()
    bad, clean = many.bad + BENT * len(bent), many.good
    cost = {1: COST * (bad + clean) / (2 * bad), 0: COST * (bad + clean) / (2 * clean)}
    ones = lambda x: np.hstack([x @ whiten, np.ones((len(x), 1))])
    told = lambda rows, t, w: hinge(ones(rows), np.full(len(rows), 2.0 * t - 1), np.full(len(rows), cost[t]), w)

    passes = bags.coalesce(4)  # rows of a few megabytes: more tasks would cost more than they share

    def sums(w: np.ndarray) -> Sums:
        """hinge() of all training sentences, summed by the tasks; a row of fixed size comes from each."""

        def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, g, h = 0.0, np.zeros(len(w)), np.zeros((len(w), len(w)))
            for b in batches:
                for toxic, raw in zip(b["toxic"].to_pylist(), b["x"].to_pylist(), strict=True):
                    x = np.frombuffer(raw, "<f4").reshape(-1, m)
                    x = x if toxic and len(x) else np.concatenate([np.zeros((1, m), np.float32), x])
                    one = told(x, toxic, w)
                    loss, g, h = loss + one[0], g + one[1], h + one[2]
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([g.tobytes()]), pa.array([h.tobytes()])], names=["loss", "g", "h"])

        parts = [(r.loss, np.frombuffer(r.g), np.frombuffer(r.h).reshape(len(w), -1)) for r in passes.mapInArrow(part, "loss double, g binary, h binary").collect()]
        own = told(bent, 1, w)
        parts.append(tuple(BENT * v for v in own))
        return tuple(sum(v) for v in zip(*parts, strict=True))

    w = newton(sums, whiten.shape[1] + 1)
    machine = Machine(landmarks, whiten, w[:-1], float(w[-1]), np.zeros(1), np.zeros(1))

    def worst(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [float(machine.decide(np.concatenate([np.zeros((1, m), np.float32), np.frombuffer(x, "<f4").reshape(-1, m)])).max()) for x in b["x"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["toxic"], pa.array(found, pa.float64())], names=["toxic", "worst"])

    found = np.array(sorted(map(tuple, bags.mapInArrow(worst, "toxic int, worst double").collect())))  # two numbers for each of TRAIN_DOCS rows
    weight = np.concatenate([np.ones(len(found)), np.full(len(bent), SHARE * found[:, 0].sum() / max(1, len(bent)))])
    decision = np.concatenate([found[:, 1], machine.decide(bent)])
    machine.decision, machine.chance = calibrated(decision, np.concatenate([found[:, 0], np.ones(len(bent))]), weight, ends=True)
    return machine


def calibrated(decision: np.ndarray, toxic: np.ndarray, weight: np.ndarray | None = None, ends: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Decisions and the chances there: the share of toxic rows by weight (1, if none is given), rising with the decision (pooled where it wouldn't).

    A pool stands at its mean decision, or with `ends` at its least and its greatest: then its chance holds all over it.
    """
    weight = np.ones(len(decision)) if weight is None else weight
    at, where = np.unique(decision, return_inverse=True)
    pools: list[list[float]] = []  # sum of decisions, of toxic rows, rows
    edges: list[list[float]] = []
    for z, t, n in zip(at.tolist(), np.bincount(where, toxic * weight).tolist(), np.bincount(where, weight).tolist(), strict=True):
        pools.append([z * n, t, n])
        edges.append([z, z])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
            edges[-2:] = [[edges[-2][0], edges[-1][1]]]
    z, t, n = np.array(pools).T
    chance = np.maximum.accumulate((t + 0.5) / (n + 1))
    return (np.array(edges).ravel(), np.repeat(chance, 2)) if ends else (z / n, chance)


def chances(machine: Machine, texts: list[str | None]) -> list[float]:
    """The probability for each text that its worst sentence is toxic."""
    f = features(tuple(machine.landmarks))
    direction, empty = machine.whiten @ machine.weight, machine.bias
    found = []
    for k in range(0, len(texts), 300):
        some = [(x or "").lower() for x in texts[k : k + 300]]
        f.learn(some)
        found += [max(empty, float((x @ direction).max()) + machine.bias) if len(x := f.sentences(t)) else empty for t in some]
    return machine.probability(np.array(found)).tolist()


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """(doc_id, score) of every row: the probability that its worst sentence is toxic."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    if machine is None:
        return chosen.select("doc_id", F.lit(0.0).alias("score"))

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 300):
                s = b.slice(k, 300)
                yield pa.RecordBatch.from_arrays([s["doc_id"], pa.array(chances(machine, s["text"].to_pylist()), pa.float64())], names=["doc_id", "score"])

    return chosen.mapInArrow(each, "doc_id long, score double")


def keep(docs: DataFrame, labels: DataFrame, train=None, learn_from: DataFrame | None = None) -> DataFrame:
    """docs without the rows whose own text a machine, fitted on the labels that `train` allows (None: all), finds toxic.

    The labels name rows of `learn_from` (None: docs). Rows that share an id are each judged by their text. Rows with a null id stay.
    """
    machine = fit(docs if learn_from is None else learn_from, labels, F.lit(True) if train is None else train)
    if machine is None:
        return docs
    name = "_score"
    while name in (c.lower() for c in docs.columns):
        name += "_"

    def run(b: pa.RecordBatch) -> Iterator[dict]:
        yield {name: chances(machine, b["text"].to_pylist())}

    scored = map_batches(docs, run, {name: "double"})
    return scored.where((F.col(name) < 0.5) | F.col("doc_id").isNull()).drop(name)
