import hashlib

import corpus_pipeline as pipeline
import public_tokenizers
from conftest import SF
from test_near_dedup import brute as near_brute
from tokenizers import Tokenizer

from strider.llm import toxicity


def low_words(t, keep):
    low = (t or "").translate({c: c + 32 for c in range(65, 91)})
    return "".join(c if keep(c) else " " for c in low).split(" ")


def contaminated(text, windows):
    w = [x for x in low_words(text, lambda c: c.isascii() and c.isalnum() or ord(c) > 127) if x]
    hit = set()
    for n, g in windows:
        hit |= {p for i in range(len(w) - n + 1) if w[i : i + n] == g for p in range(i, i + n)}
    return bool(hit) and 20 * len(hit) >= len(w)


def test_stages_against_brute_force(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r.text for r in documents.collect()}
    toxic = {r.doc_id for r in toxicity.score(documents, toxicity.fit(documents, labels)).where("score >= 0.7").collect()}
    rows = {i: t for i, t in rows.items() if i not in toxic}
    groups = {}
    for i, t in rows.items():
        groups.setdefault("".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r"), []).append((-len(t or ""), i))
    rows = {min(g)[1]: rows[min(g)[1]] for g in groups.values()}
    near = near_brute([*rows.items()], 5, 80, 100)
    rows = {i: t for i, t in rows.items() if near[i][1] == i}
    windows = []
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = [x for x in low_words(r.text, lambda c: c.isascii() and c.isalnum() or ord(c) > 127) if x]
        n = min(13, len(w))
        windows += [(n, w[i : i + n]) for i in range(len(w) - n + 1)] if n else []
    rows = {i: t for i, t in rows.items() if not contaminated(t, windows)}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in rows.items()}
    got = pipeline.run(spark, SF).collect()
    assert {r.doc_id: list(r.ids) for r in got} == want
    assert all(r.decoded_sha256 == hashlib.sha256((rows[r.doc_id] or "").encode()).hexdigest() for r in got)


def test_stages_keep_the_columns_of_documents(spark, documents):
    docs = documents.limit(40)
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == documents.columns


def test_odd_rows_run_through_all_stages(spark, odd_docs, tmp_path):
    docs = odd_docs.withColumn("_gone", odd_docs.doc_id).withColumn("_key", odd_docs.text)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    got = pipeline.run(spark, str(tmp_path)).collect()
    # By hand: empty texts of several kinds are one group, of which the longest, then the smallest
    # id stays; "A A" and "a" differ; rows that repeat stand once; the row without an id stays.
    texts = {}
    for r in odd_docs.collect():
        key = "".join(c for c in r.text or "" if c not in " \t\n\x0b\x0c\r")
        texts[key] = min(texts.get(key, ((1,),)), ((-len(r.text or ""), r.doc_id is None, r.doc_id), r.text))
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((str(k[2]), t.encode(x or "", add_special_tokens=False).ids) for k, x in texts.values())
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == want


def test_empty_table(spark, no_docs, tmp_path):
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
