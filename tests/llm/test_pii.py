import hashlib
import random
import re
from math import log2

from strider.llm import pii

RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def ok(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        s = sum((x * 2 - 9 * (x * 2 > 9)) if i % 2 else x for i, x in enumerate(map(int, reversed(d))))
        return 12 <= len(d) <= 19 and s % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    return sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(RULES) for m in re.finditer(p, text or "") if ok(k, m[0]))


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in spans).encode()).hexdigest()


def same(df):
    rows = pii.report(pii.find(df)).join(df.select("doc_id", "text"), "doc_id").collect()
    for r in rows:
        want = brute(r.text)
        assert r.base_sha256 == digest(want), r.text[:200]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[3] for x in want) for k, _ in RULES]
        assert {f"{k}:{s}:{e}" for s, _, e, k in want} <= set(r.spans.split(",")) | {""} - ({""} if want else set())
    return len(rows)


def test_documents_against_brute_force(spark, documents):
    assert same(documents) == documents.count()


def test_random_texts_against_brute_force(spark):
    rnd = random.Random(11)
    rows = [(i, "".join(rnd.choices("ab.@@..-_%+ 0123456789()  é😀\n", k=rnd.randint(0, 60)))) for i in range(3000)]
    rows += [(9000, "4111 1111-1111 1111"), (9001, "a@b.c_x@y.z.é@q.r"), (9002, "1.2.3.4.5.6.7.8 0255.1.1.1 256.1.1.1 " + "9" * 30 + ".1.1.1"), (9003, "+1 (212) 555-0100 +" + "1 " * 40)]
    rows += [(9004, "a" * 50_000), (9005, "1 " * 50_000), (9006, "é" * 20 + "x@y.zz"), (9007, "+1" + " " * 50_000)]
    assert same(spark.createDataFrame(rows, "doc_id long, text string")) == len(rows)


def test_terms_that_give_an_entity_away(spark):
    rows = [(i, f"common words stand here\nthe quirkmaster wrote to ann{i % 2}@x.org today with common words") for i in range(8)]
    rows += [(100 + i, "common words stand here and today they write with other words") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    near = pii.contexts(pii.base_spans(df))
    got = {(r.entity, r.term): r.share for r in pii.disclosure(df, near).collect()}
    # Brute force: documents that hold the term, the entity, and the term near the entity.
    has = lambda t: sum(t in x.split() or f"{t}\n" in x for _, x in rows)
    for (e, t), share in got.items():
        n_e = 4
        want = log2(4 * len(rows) / (has(t) * n_e)) / log2(len(rows) / n_e)
        assert abs(share - min(1, want)) < 1e-9, (e, t)
    found = {r.doc_id: r.spans for r in pii.report(pii.find(df)).collect()}
    at = rows[0][1].index("quirkmaster")
    assert f"generalise:{at}:{at + 11}" in found[0].split(",") and found[100] == ""
    assert not any("common" in rows[0][1][int(s.split(":")[1]) : int(s.split(":")[2])] for s in found[0].split(",") if s[:4] in ("gene", "remo"))
    clean = {r.doc_id: r.sanitised_text for r in pii.sanitise(df, pii.find(df)).collect()}
    assert "ann" not in clean[0] and "quirkmaster" not in clean[0] and "[email]" in clean[0] and clean[100] == rows[8][1]


def test_odd_rows(spark, odd_docs, no_docs):
    assert pii.report(pii.find(odd_docs)).count() == odd_docs.count()
    assert pii.report(pii.find(no_docs)).count() == 0


def test_entities_of_one_and_two_documents(spark):
    once = "Zora Quill lives here\n\nreach me: z.q@x.org with common words"
    twice = "Ion Brask " + "common words " * 40 + "\nand then call +1 212 555 0100"
    rows = [(1, once), (2, twice), (3, "again " + twice), (None, "nobody")]
    rows += [(100 + i, "common words lives here reach me with and then call again other") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans.split(",") for r in pii.report(pii.find(df)).collect()}
    told = {d: {t[int(s.split(":")[1]) : int(s.split(":")[2])] for s in found[d] if s[:4] in ("gene", "remo")} for d, t in rows[:3]}
    assert told == {1: {"Zora", "Quill"}, 2: {"Ion", "Brask"}, 3: {"Ion", "Brask"}}
    assert found[None] == [""] and found[100] == [""]


def test_rows_that_repeat_count_each_everywhere(spark):
    rows = [(1, "the quirkmaster wrote to ann@x.org")] * 6 + [(100 + i, "other words stand here and there") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shares = {r.term: r.share for r in pii.disclosure(df, pii.contexts(pii.base_spans(df))).collect()}
    assert abs(shares["quirkmaster"] - 1) < 1e-9
    found = pii.find(df).where("doc_id = 1").collect()
    assert len(found) == 6 and len({str(r.spans) for r in found}) == 1 and len(found[0].spans) == 5
