import random

import numpy as np
from pyspark.sql import functions as F

from strider.llm import near_dedup
from strider.llm.components import connected


def brute(rows, k, num, den):
    """Components over all pairs, on the shingles themselves."""
    sets = {}
    for i, t in rows:
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        w = [x for x in low.translate({c: " " for c in range(9, 14)}).split(" ") if x]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) * den >= max(len(a), len(b)) * num:
                n = len(a & b)
                if den * n >= num * (len(a) + len(b) - n):
                    p, q = sorted((find(i), find(j)))
                    root[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


def run(df, **how):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(df, **how).collect()}


def test_documents_against_all_pairs(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert run(documents) == brute(rows, 3, 85, 100)


def test_chains_and_large_groups_of_near_copies(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choices("abcdefgh", k=5))
    base = [word() for _ in range(120)]
    rows, now = [], list(base)
    for i in range(60):  # a chain: each close to the one before it, ends far apart
        rows.append((i, " ".join(now)))
        now = list(now)
        now[rnd.randrange(120)] = word()
        now[rnd.randrange(120)] = word()
    for i in range(60, 160):  # near copies of one text, most pairs near the threshold
        copy = list(base)
        for _ in range(rnd.choice([1, 2, 3, 4])):
            copy[rnd.randrange(120)] = word()
        rows.append((i, " ".join(copy)))
    rows += [(200 + i, " ".join(word() for _ in range(30))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df) == brute(rows, 3, 85, 100)
    assert run(df, words=5, num=80) == brute(rows, 5, 80, 100)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.where("doc_id is not null").collect()]
    assert run(odd_docs.where("doc_id is not null")) == brute(rows, 3, 85, 100)
    assert near_dedup.near_groups(odd_docs).count() == odd_docs.count()
    assert near_dedup.near_groups(no_docs).count() == 0


def test_one_row_of_a_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(4, base), (4, base), (4, base + " tail"), (9, base + " end"), (4, "far away from it all"), (None, base + " no id"), (None, ""), (None, ""), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_gone", F.lit(1))
    left = near_dedup.drop_near_copies(docs)
    assert left.columns == docs.columns
    got = sorted((str(r.doc_id), str(r.text)[:8]) for r in left.collect())
    assert got == [("4", "far away"), ("4", "w0 w1 w2"), ("7", "None"), ("None", "")]


def test_estimate_is_close(spark):
    rng = np.random.default_rng(1)
    for share in (0.5, 0.85, 0.95):
        n = int(2000 * share)
        both = rng.integers(0, 2**63, n, dtype=np.uint64)
        x, y = (np.concatenate([both, rng.integers(0, 2**63, (2000 - n) // 2, dtype=np.uint64)]) for _ in range(2))
        bits = [near_dedup.packed_bits(near_dedup.minima(s)).view(np.int64).tolist() for s in (x, y)]
        got = spark.createDataFrame([bits], "x array<long>, y array<long>").select(near_dedup.estimate(F.col("x"), F.col("y"))).first()[0]
        assert abs(got - share) < 0.15


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.node: r.label for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_exact_round_follows_star_rounds_without_pairs(spark, monkeypatch):
    called, across = [], near_dedup._across
    monkeypatch.setattr(near_dedup, "_across", lambda *a: called.append(1) or across(*a))
    text = " ".join(f"w{i}" for i in range(200))
    df = spark.createDataFrame([(1, text), (2, text + " tail")], "doc_id long, text string")
    assert {r.component_id for r in near_dedup.near_groups(df, words=3, num=85, den=100).collect()} == {1} and called
