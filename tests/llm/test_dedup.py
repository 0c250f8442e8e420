import hashlib
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from strider.llm import decontaminate, exact_dedup, line_dedup
from strider.llm.line_index import Shard

SPACES = " \t\n\x0b\x0c\r"
LOW = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_lines(rows, least):
    found = defaultdict(set)
    for n, (_, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            found[line.strip(SPACES).translate(LOW)].add(n)
    common = {k for k, ns in found.items() if k and len(ns) >= least}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if x.strip(SPACES).translate(LOW) not in common]
        out.append((str(i), len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out)


def test_lines_by_broadcast_and_by_routing(spark, documents, odd_docs):
    for docs, least in ((documents, 10), (documents, 2), (odd_docs, 2)):
        want = brute_lines([(r.doc_id, r.text) for r in docs.collect()], least)
        for limit in (1 << 26, 0):
            got = line_dedup.drop_common_lines(docs, least, broadcast_bytes=limit, shard_keys=64).collect()
            assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in got) == want


def test_lines_of_no_documents(spark, no_docs):
    assert line_dedup.drop_common_lines(no_docs).count() == 0
    assert line_dedup.drop_common_lines(no_docs, broadcast_bytes=-1).count() == 0


def test_perfect_hash_finds_its_keys_and_no_others():
    rng = np.random.default_rng(5)
    hi, lo, n = rng.integers(0, 2**63, 20_000, dtype=np.uint64), rng.integers(0, 2**63, 20_000, dtype=np.uint64), rng.integers(1, 9, 20_000)
    shard = Shard.from_bytes(Shard.build(hi, lo, n).to_bytes())
    assert (shard.counts_of(hi, lo) == n).all()
    assert (shard.counts_of(rng.integers(0, 2**63, 9000, dtype=np.uint64), lo[:9000]) == 0).all()
    assert (shard.counts_of(hi, lo + np.uint64(1)) == 0).all()
    assert len(shard.to_bytes()) < 20_000 * 14


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        norm = "".join(c for c in t or "" if c not in SPACES)
        groups[norm].append((-len(t or ""), i is None, i))
    return sorted((str(i), str(min(g)[2]), len(g), i == min(g)[2], sha(n)) for n, g in groups.items() for _, _, i in g)


def test_exact_groups(spark, documents, odd_docs, no_docs):
    rnd = random.Random(1)
    many = spark.createDataFrame([(i, rnd.choice(["hot text", "hot  text", "hot te xt ", f"own {i}"])) for i in range(600)], "doc_id long, text string")
    for docs in (documents, odd_docs, many):
        got = exact_dedup.exact_groups(docs).collect()
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == brute_exact([(r.doc_id, r.text) for r in docs.collect()])
    assert exact_dedup.exact_groups(no_docs).count() == 0
    left = exact_dedup.drop_copies(many)
    assert left.columns == many.columns and left.count() == len({r[4] for r in brute_exact([(r.doc_id, r.text) for r in many.collect()])})


def test_merge_rounds_of_any_fan_in(spark):
    rows = spark.range(500).selectExpr("id as doc_id", "cast(id % 7 as string) as digest", "id % 7 as verify", "cast(id % 3 as int) as size", "id as h", "cast(id % 23 as int) as run")
    for fan_in in (2, 3, 8, 64):
        leaves, root = exact_dedup.merge_tree(rows, fan_in)
        got = {r.digest: (r.best.doc_id, r.n) for r in root.collect()}
        assert got == {str(d): (min((-(i % 3), i) for i in range(d, 500, 7))[1], len(range(d, 500, 7))) for d in range(7)}
        assert leaves.count() == len({(i % 7, i % 23) for i in range(500)})


def test_repeated_rows_and_ids(spark):
    rows = [(1, "same text"), (1, "same text"), (1, "same  text"), (1, "another"), (2, "same text"), (None, "no id"), (None, "no id"), (None, "n o id"), (None, None), (3, ""), (3, ""), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_gone", F.lit(1)).withColumn("_key", F.lit("x"))
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in left.collect()) == [("1", "another"), ("1", "same  text"), ("3", ""), ("None", "n o id")]


def words(t):
    low = (t or "").translate(LOW)
    return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in low).split(" ")


def brute_hits(docs, items):
    windows = []
    for i, t in items:
        w = [x for x in words(t) if x]
        n = min(13, len(w))
        windows += [(i, n, w[k : k + n]) for k in range(len(w) - n + 1)] if n else []
    out = []
    for i, t in docs:
        w = [x for x in words(t) if x]
        hit, found = set(), set()
        for item, n, g in windows:
            for k in range(len(w) - n + 1):
                if w[k : k + n] == g:
                    hit |= set(range(k, k + n))
                    found.add(item)
        ids = ",".join(sorted(map(str, found)))
        out.append((str(i), len(w), len(hit), len(found), sha(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_contamination_with_short_items_ties_and_repeats(spark, odd_docs, no_docs, monkeypatch):
    rnd = random.Random(9)
    word = lambda: rnd.choice(["ab", "Cd", "é9", "x", "the"])
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([0, 1, 2, 5, 8, 12, 13, 14, 20, 40])] + [(20, None), (5, "repeated id of five words"), (9, "ab-Cd/é9")]
    docs = [(i, " ".join(word() for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    docs += [(100 + k, f"some other words, {t}! and more") for k, t in items] + [(100, "twice"), (None, "ab cd")]
    a = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    read = lambda df: sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.report(df).collect())
    assert read(decontaminate.contamination(a, b)) == brute_hits(docs, items)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)  # the shuffle join finds the same
    assert read(decontaminate.contamination(a, b)) == brute_hits(docs, items)
    assert decontaminate.report(decontaminate.contamination(no_docs, b)).count() == 0
    assert decontaminate.contamination(odd_docs, b.where("false")).where("contaminated OR n_hit > 0").count() == 0


def test_contaminated_documents_go(spark, documents):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute_hits([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in bench.collect()])
    left = decontaminate.drop_contaminated(documents, bench)
    assert left.columns == documents.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == [w[0] for w in want if not w[5]]
