import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

from strider.llm import mixing


def filled(sizes, weights, total, epochs):
    """Water-filling as told: clamp whoever exceeds, share the excess among the others, again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    clamped = {}
    while True:
        free = [s for s in order if s not in clamped]
        left = total - sum(clamped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > epochs * sizes[s]]
        if not over:
            return clamped | share
        clamped |= {s: epochs * sizes[s] for s in over}


def check(rows, got, weights=(3, 1, 2), percent=150, epochs=2, seed=13):
    """Targets, the counts of repetitions, and the choice by hash against brute force."""
    sizes, by_source = defaultdict(int), defaultdict(list)
    for doc_id, source, text in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] += n
        by_source[source].append((hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest(), n, doc_id))
    goal = filled(sizes, weights, sum(sizes.values()) * percent / 100, epochs)
    want = []
    for source, docs in by_source.items():
        times = math.floor(goal[source] / sizes[source]) if sizes[source] else 0
        rest, upto = goal[source] - times * sizes[source], 0
        for _, n, doc_id in sorted(docs, key=lambda d: d[:2]):
            upto += n
            want.append((str(doc_id), n, sizes[source], round(goal[source], 6), (times + (upto - n / 2 < rest)) * n))
    assert sorted((str(r.doc_id), r["size"], r.source_size, round(r.target, 6), r.taken) for r in got) == sorted(want)
    for r in got:
        assert r.taken <= epochs * r["size"]


def test_documents(spark, documents, odd_docs, no_docs):
    for docs in (documents, odd_docs):
        rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
        check(rows, mixing.mix(docs).collect())
    check(rows, mixing.mix(docs.repartition(7), (1, 5), 120, 3, 4, broadcast_sources=0).collect(), (1, 5), 120, 3, 4)
    assert mixing.mix(no_docs).count() == 0


def test_repeats_null_sources_and_a_hot_source(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["hot", "hot", "b", None, "é", "z"]), "w " * rnd.randint(0, 40)) for i in range(600)]
    rows += [(1, "hot", "x y z")] * 500 + [(2, "one", "only these words")] * 40 + [(None, "b", "a b")] * 30 + [(3, "empty", None)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    for limit in (1000, 0):
        got = mixing.mix(frame, broadcast_sources=limit).collect()
        check(rows, got)
    assert len({r.target for r in got}) == 7


def test_caps_bind_and_excess_is_shared(spark):
    """The small source stops at its cap, the others share what it leaves by weight."""
    rows = [(i, "a", "w " * 10) for i in range(10)] + [(100 + i, "b", "w " * 10) for i in range(100)] + [(300 + i, "c", "w " * 10) for i in range(100)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    goal = {r.source_size: r.target for r in got}
    assert goal[100] == 200 and {round(r.target, 3) for r in got} == {200, round((3150 - 200) / 3, 3), round((3150 - 200) / 3 * 2, 3)}
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), total_percent=250)
