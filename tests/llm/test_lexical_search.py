import math
import re
from collections import Counter

import pytest
from conftest import SF

from strider.llm import lexical_search as search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, queries, k=10):
    """The ranking by its definition, over all documents for each query."""
    docs = [(i, Counter(ws), len(ws)) for i, t in docs if (ws := words(t))]
    n, total = len(docs), sum(d[2] for d in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in queries:
        found = []
        for i, c, size in docs:
            m = 100 - 75 + 75 * size * n // total
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, q in Counter(words(text)).items() if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(map(str, out))


def rows(df):
    return sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in df.collect())


def test_terms_are_those_of_the_pattern():
    for text in (None, "", "Aé_b-9 ÀÉ\x7fz\x00q", "a\x1cb\x85c 漢字😀 'tis", "[x]{y}`~"):
        assert [w.decode() for w in search.terms(text)] == words(text)


@pytest.mark.parametrize("shard_postings,block_bytes", [(1 << 21, 4 << 20), (3000, 1500)])
def test_whole_tables_like_brute_force(spark, documents, shard_postings, block_bytes):
    """Small shards and blocks give the same ranks as one of each."""
    queries = spark.read.parquet(f"{SF}/benchmark.parquet").limit(12)
    index = search.build_index(documents, shard_postings=shard_postings)
    assert index.shards.count() > (1 if shard_postings == 3000 else 0)
    want = brute([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in queries.collect()])
    assert rows(search.search(index, queries, block_bytes=block_bytes)) == want


def test_ties_nulls_and_repeats(spark, odd_docs, no_docs):
    docs = [(i, "same text here") for i in range(40, 0, -1)] + [(None, "same text here"), (7, "same same"), (99, None), (98, "")]
    docs += [(r.doc_id, r.text) for r in odd_docs.collect()]
    queries = [("b", "Same TEXT text"), ("b", "Same TEXT text"), (None, "word"), ("none", None), ("empty", ""), ("unknown", "zzzz"), ("long", "word here " * 20_000)]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string").repartition(3)
    asked = spark.createDataFrame([(*q, 1) for q in queries], "item_id string, text string, rank int")
    index = search.build_index(frame, shard_postings=20)
    for k, block_bytes in ((3, 100), (100, 1 << 20)):
        assert rows(search.search(index, asked, k=k, block_bytes=block_bytes)) == brute(docs, queries, k)
    assert search.search(search.build_index(no_docs), asked).count() == 0
    assert search.search(index, asked.where("false")).count() == 0
