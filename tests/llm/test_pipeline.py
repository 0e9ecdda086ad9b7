"""Each stage of the pipeline against a plain version of it on that stage's own input."""

import re
from collections import Counter

import corpus_pipeline
from test_ids import check_packing
from test_simhash import plain_print

from tallygrove.llm import quality, toxicity
from tallygrove.session import written


def kept_of_near_copies(texts):
    """Ids left of every pair compared: linked by fingerprints of at most 4 bits' difference or a similarity of 0.8 of five-word shingles."""
    prints = {k: plain_print(x, 5) for k, x in texts.items()}
    found = {k: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for k, x in texts.items() if (w := (x or "").encode().lower().split())}
    alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    left, kept = set(texts), set()
    for k in sorted(texts):
        if k in left:
            kept.add(k)
            todo = [k]
            left.remove(k)
            while todo:
                j = todo.pop()
                more = {x for x in left if (prints[j] ^ prints[x]).bit_count() <= 4 or (j in found and x in found and alike(found[j], found[x]))}
                left -= more
                todo += more
    return kept


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = written(stage(spark, docs, sf), name)
        after = {r.doc_id: r for r in out.collect()}
        if name != "packing":
            assert out.columns == columns
        if name == "toxicity":
            scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels, "true")).collect()}
            assert set(after) == {k for k in before if scores[k] < 0.5}
            bad = re.compile("trash|pathetic|idiot|disgusting|worthless|stupid|moron")
            left = sum(bool(bad.search(r.text or "")) for r in after.values())
            assert left < 0.1 * sum(bool(bad.search(r.text or "")) for r in before.values())
        elif name == "quality":
            assert set(after) == {r.doc_id for r in quality.scored(docs, labels).collect() if r.kept}
        elif name == "simhash":
            assert set(after) == kept_of_near_copies({k: r.text for k, r in before.items()}) and all(after[k] == before[k] for k in after)
        elif name == "suffix":
            assert set(after) == set(before)
            raws = {k: (r.text or "").encode() for k, r in before.items()}
            windows = Counter(x[k : k + 200] for x in raws.values() for k in range(len(x) - 199))
            for k, x in raws.items():
                gone = bytearray(len(x))
                for j in range(len(x) - 199):
                    if windows[x[j : j + 200]] > 1:
                        gone[j : j + 200] = b"\x01" * 200
                kept = bytes(c for c, g in zip(x, gone, strict=True) if not g).decode("utf-8", errors="ignore")
                assert after[k].text == kept and after[k].n_chars == len(kept)
        else:
            check_packing(out.collect(), [(k, r.text) for k, r in before.items()])
        seen[name] = (len(before), len(after))
        docs = out
    assert all(a < b for b, a in (seen[k] for k in ("toxicity", "quality", "simhash")))
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_stages_on_odd_rows(spark):
    """Null ids and texts, empty and long texts, repeated rows, an empty table, and columns named like those in the operators."""
    sf = "/root/testdata/sf0.001"
    names = ["n_chars", "_id", "_toxic", "_gone", "_raw", "_k1", "_kept", "_good", "_text", "print", "root", "score", "kept", "same"]
    good = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en' and length(text) > 2000").limit(3).collect()
    texts = [(r.doc_id, r.text) for r in good] + [(good[0].doc_id, good[0].text), (None, good[1].text), (None, None), (7001, None), (7002, ""), (7003, "word " * 60000), (None, "")]
    df = spark.createDataFrame([(k, x, *[0] * len(names)) for k, x in texts], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name == "packing":
                assert out.count() >= docs.count()
            else:
                rows = out.collect()
                assert out.columns == docs.columns and len(rows) <= docs.count()
                docs = written(out, name)
        if docs.count():
            assert sum(r.doc_id is None for r in rows) == 3 and len({r.doc_id for r in rows} & {r.doc_id for r in good}) > 0


def test_rows_that_share_an_id(spark):
    """Rows with one id and different texts are judged by their text; of each group of near copies a text always stays."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en' and length(text) between 1500 and 9000").join(labels.where("quality = 1 and toxic = 0"), "doc_id").orderBy("doc_id").limit(2).collect()]
    a, b = good
    frame = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string, lang string, source string, n_chars long")
    row = lambda k, t: (k, t, "en", "s", len(t))
    stages = dict(corpus_pipeline.STAGES)
    near = frame(row(1, a), row(5, b), row(5, a), row(7, b), row(7, b))
    left = [(r.doc_id, r.text) for r in stages["simhash"](spark, near, sf).collect()]
    assert sorted(left) == sorted([(1, a), (5, b)])
    both = frame(row(3, a), row(3, b), row(9, b))
    assert sorted((r.doc_id, r.text) for r in stages["simhash"](spark, both, sf).collect()) == sorted([(3, a), (3, b)])
    rude = frame(row(1, a), row(1, "you worthless idiot, you stupid trash"), row(2, b))
    assert sorted((r.doc_id, r.text) for r in stages["toxicity"](spark, rude, sf).collect()) == sorted([(1, a), (2, b)])
    poor = frame(row(1, a), row(1, "too short"), row(2, b), row(3, "same same same " * 40))
    assert sorted((r.doc_id, r.text) for r in stages["quality"](spark, poor, sf).collect()) == sorted([(1, a), (2, b)])
