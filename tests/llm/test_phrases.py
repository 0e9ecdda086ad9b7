"""Operator 11 against counting every phrase in memory."""

import random
import re
from collections import Counter, defaultdict

from tallygrove.llm import phrases, registry

NAMES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def plain(rows, least=10, top=2000):
    """rows: (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n["und" if lang is None else lang] += len(w)
            for size in (1, 2, 3):
                f["und" if lang is None else lang].update(tuple(w[k : k + size]) for k in range(len(w) - size + 1))
    out = []
    for lang, seen in f.items():
        within = Counter()
        for p, c in seen.items():
            if len(p) == 3 and c >= least:
                for part in (p[:2], p[1:]):
                    within[part] = max(within[part], c)
        got = []
        for p, a in seen.items():
            if len(p) > 1 and a >= least and not (within[p] and 100 * within[p] >= 50 * a):
                cuts = [(1_000_000 * a * a // (seen[p[:k]] * seen[p[k:]]), k, seen[p[:k]], seen[p[k:]]) for k in range(1, len(p))]
                score, _, l, r = min(cuts)
                got.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(got)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def told(df):
    return sorted(tuple(r[k] for k in NAMES) for r in df.collect())


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()]
    got = told(registry.op11_phrases(spark, sf))
    assert got == plain(rows) and len(got) > 100


def odd_rows():
    rnd = random.Random(4)
    few = "New York City a b c the of and é É ÄB x-y <|z|> 日本 .. ? \t \r\n \x0b, ; :".split(" ")
    rows = [(rnd.choice(["en", "de", None, "", "und"]), " ".join(rnd.choice(few) for _ in range(rnd.randrange(60)))) for _ in range(300)]
    return rows + [("en", None), ("en", ""), (None, None), ("de", "a b " * 4000), ("xx", "one"), ("yy", "new york city. " * 12), ("yy", "New York, " * 8), ("zz", "A B\xa0C " * 20)]


def test_odd_rows(spark, monkeypatch):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], "lang string, text string, phrase string, range long").repartition(6)
    want = plain(rows)
    assert told(phrases.collocations(df)) == want
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(phrases, "LEAST_BITS", phrases.RANGE_BITS)
    assert told(phrases.collocations(df, least=3, top=7)) == plain(rows, 3, 7)
    assert phrases.collocations(df.limit(0)).count() == 0


def test_large_counts(spark):
    """Products beyond 64 bits stay exact."""
    a, l, r = 3_000_000_001, 4_000_000_007, 5_000_000_029
    frame = lambda rows: spark.createDataFrame(rows, "lang string, phrase string, f long")
    got = phrases.scored([frame([("en", "x", l), ("en", "y", r)]), frame([("en", "x y", a)])]).collect()
    assert [tuple(x) for x in got] == [("en", "x y", a, l, r, 1_000_000 * a * a // (l * r))]
