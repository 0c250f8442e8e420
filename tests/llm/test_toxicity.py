import random

import numpy as np
from pyspark.sql import functions as F

from strider.llm import toxicity


def test_search_is_exact():
    rnd = random.Random(1)

    def vector(n):
        d = {t: rnd.random() + 0.1 for t in rnd.sample(range(200), n)}
        size = sum(x * x for x in d.values()) ** 0.5
        return {t: x / size for t, x in d.items()}

    rows = [vector(rnd.randint(1, 8)) for _ in range(700)]
    rows[5], rows[600] = rows[4], rows[4]  # ties
    flat = [(t, i, w) for i, r in enumerate(rows) for t, w in r.items()]
    index, dense = toxicity.Index(*(np.array(x) for x in zip(*flat)), 700, 200), np.zeros((700, 200))
    for i, r in enumerate(rows):
        dense[i, list(r)] = list(r.values())
    for at in range(100):
        q = vector(rnd.randint(1, 6)) if at else rows[4]
        scores = dense[:, list(q)] @ np.array(list(q.values()))
        want = sorted(-x for x in scores if x > 0)[: toxicity.NEIGHBOURS]
        got, found = index.search(np.array(list(q)), np.array(list(q.values())), toxicity.NEIGHBOURS)
        assert np.allclose(-got, want, atol=1e-6)
        assert np.allclose(scores[found], got, atol=1e-6)
        if not at:
            assert found[:3].tolist() == [4, 5, 600]


def test_isotonic_fit_is_monotone():
    rng = np.random.default_rng(3)
    x = rng.random(300)
    at, p = toxicity.isotonic(x, (rng.random(300) < x).astype(float))
    assert (np.diff(at) > 0).all() and (np.diff(p) >= 0).all() and p[0] < 0.3 and p[-1] > 0.7


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    assert scored.where("score < 0 OR score > 1 OR predicted <> int(score >= 0.7)").count() == 0
    held = scored.where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    right = sum(r.predicted == r.toxic for r in held)
    assert right >= 0.9 * len(held)
    assert sum(r.predicted for r in held if r.toxic == 0) <= 0.03 * len(held)


def test_held_out_recall_by_language(spark):
    """Nine of ten toxic documents are caught, in every language, and under one clean one in a hundred."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    held = scored.select("predicted", "toxic", "lang").collect()
    for langs in (["en"], ["de"], ["fr"], ["es"], ["en", "de", "fr", "es"]):
        toxic = [r.predicted for r in held if r.toxic == 1 and r.lang in langs]
        assert sum(toxic) >= 0.9 * len(toxic), (langs, sum(toxic), len(toxic))
    assert sum(r.predicted for r in held if r.toxic == 0) < 0.01 * sum(r.toxic == 0 for r in held)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1), (1, 0), (4, 1), (4, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd_docs, labels)
    assert toxicity.score(odd_docs, model).count() == odd_docs.count()
    assert toxicity.score(no_docs, model).count() == 0
    assert toxicity.score(odd_docs, toxicity.fit(no_docs, labels.where(F.lit(False)))).where("score between 0 and 1").count() == odd_docs.count()


def brute_scores(docs, labels):
    """Scores and the three nearest examples, from the docstring alone: all pairs, dictionaries."""
    import math
    import re
    import zlib
    from collections import Counter

    def parts(text, stems=True):
        n = Counter(re.findall(r"[^\W\d_]+", (text or "").lower()))
        for w, k in list(n.items()) if stems else ():
            for size in (2, 3, 4, 5, 6):
                if len(w) > size:
                    n[w[:size] + "*"] += k
        return n

    train = {i: y for i, y in labels.items() if zlib.crc32(str(i).encode()) % 3 != 1 and i in docs}
    counts = {i: parts(docs[i]) for i in docs}
    n, n1 = len(train), sum(train.values())
    df, df1 = Counter(), Counter()
    for i, y in train.items():
        df.update(counts[i].keys())
        df1.update(counts[i].keys() if y else ())
    weight, every = {}, Counter(t for c in counts.values() for t in c)
    for t, k in df.items():
        a, b = df1[t], k - df1[t]
        phi = abs(a * (n - n1 - b) - b * (n1 - a)) / math.sqrt(max(1, n1 * (n - n1)) * k * max(1, n - k))
        if k >= 2 and (not t.endswith("*") or k >= 5 and phi * phi * n >= 15) and (k <= max(50, 0.01 * n) or phi >= 0.05):
            weight[t] = (math.log((1 + len(docs)) / (1 + every[t])) + 1) * max(phi, 0.003)

    def unit(i):
        v = {t: (1 + math.log(k)) * weight[t] for t, k in counts[i].items() if t in weight}
        size = math.sqrt(sum(x * x for x in v.values())) or 1
        return {t: x / size for t, x in v.items()}

    units, base = {i: unit(i) for i in docs}, (n1 + 0.5) / (n + 1)

    def nearest(i, but=None):
        cosines = [(sum(x * units[e].get(t, 0) for t, x in units[i].items()), e) for e in train if e != but]
        return sorted((x for x in cosines if x[0] > 0), key=lambda x: -x[0])[:15]

    def vote(found):
        return (sum(c * c * train[e] for c, e in found) + 0.01 * base) / (sum(c * c for c, _ in found) + 0.01)

    knots = toxicity.isotonic(np.array([vote(nearest(i, i)) for i in train]), np.array([train[i] for i in train], float))
    out = {}
    for i in docs:
        v = vote(nearest(i))
        out[i] = (base if not units[i] else 0.98 * float(np.interp(v, *knots)) + 0.02 * v, [c for c, _ in nearest(i)[:3]])
    return out


def test_scores_and_evidence_against_brute_force(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    want = brute_scores({r.doc_id: r.text for r in documents.collect()}, {r.doc_id: r.toxic for r in labels.collect()})
    scored = toxicity.score(documents, toxicity.fit(documents, labels)).collect()
    assert len(scored) == len(want)
    for r in scored:
        assert abs(r.score - want[r.doc_id][0]) < 1e-4, r
        assert np.allclose([e.similarity for e in r.evidence], want[r.doc_id][1], atol=1e-5)
    assert sum(not r.evidence for r in scored) <= 0.1 * len(scored)


def test_filter_judges_rows_by_their_own_text(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    scored = {r.doc_id: r.predicted for r in toxicity.score(documents, toxicity.fit(documents, labels)).collect()}
    bad = next(i for i, p in scored.items() if p)
    twice = documents.unionByName(documents.where(F.col("doc_id") == bad).withColumn("text", F.lit("a clean text"))).withColumn("_gone", F.lit(1))
    left = toxicity.drop_toxic(twice, labels)
    assert left.columns == twice.columns
    assert [r.text for r in left.where(F.col("doc_id") == bad).collect()] == ["a clean text"]
    assert left.count() == len(scored) - sum(scored.values()) + 1
