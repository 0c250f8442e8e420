import hashlib
import random
import re

import pytest
from tokenizers import Regex, pre_tokenizers

from strider.llm import fill_middle as fim


def brute(doc_id, text, fim_percent=100, spm_percent=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, digest = len(units), hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= fim_percent:
        return doc_id, n, "plain", None, None, text
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm_percent:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows(df):
    return sorted(str((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in df.collect())


def test_line_ends_in_parts_are_those_of_the_whole():
    split, rnd = pre_tokenizers.Split(Regex(fim.LINE), "isolated"), random.Random(1)
    for _ in range(300):
        text = "".join(rnd.choices("ab\n\r é😀 \x00", k=rnd.randint(0, 40)))
        want = [m.end() for m in re.finditer(fim.LINE, text)]
        for part in (1, 7, 1 << 20):
            assert fim.line_ends(text, split, part).tolist() == want


def test_documents_and_odd_rows(spark, documents, odd_docs, no_docs):
    for docs in (documents, odd_docs):
        want = sorted(str(brute(r.doc_id, r.text)) for r in docs.collect())
        assert rows(fim.transform(docs)) == want
        assert rows(fim.transform(docs, part_chars=50)) == want
    half = sorted(str(brute(r.doc_id, r.text, 50, 10)) for r in documents.collect())
    assert rows(fim.transform(documents, fim_percent=50, spm_percent=10)) == half
    assert fim.report(fim.transform(no_docs)).count() == 0


def test_texts_come_back_from_output_and_form(spark, documents, odd_docs):
    rnd = random.Random(4)
    texts = ["".join(rnd.choices(["<", "P", "S", ">", "M", "\n", "<P", "S>", "é"], k=rnd.randint(0, 30))) for _ in range(500)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for docs in (documents.select("doc_id", "text"), odd_docs.select("doc_id", "text"), frame):
        found = fim.transform(docs).select("doc_id", "form", fim.restored().alias("text")).collect()
        assert sorted((str(r.doc_id), r.text) for r in found) == sorted((str(r.doc_id), r.text or "") for r in docs.collect())
        assert docs.count() < 50 or {r.form for r in found} >= {"psm", "spm"}


def test_sentinels_that_could_be_misread_are_refused(spark, no_docs):
    for bad in (("<P>", "<P>>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "", "<M>"), ("xy", "yz", "<M>")):
        with pytest.raises(ValueError):
            fim.transform(no_docs, sentinels=bad)
