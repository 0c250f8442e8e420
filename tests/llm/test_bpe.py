import hashlib
import random
from pathlib import Path

import numpy as np
import public_tokenizers
from conftest import ODD_TEXTS
from tokenizers import Tokenizer

from strider.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
RAW = Path(PATH).read_bytes()


def decoded(c, ids):
    return c.decode(np.array(ids, np.int64), np.array([0, len(ids)]))[0]


def test_same_ids_as_the_library_on_random_text():
    t, c, rnd = Tokenizer.from_file(PATH), bpe.Codec(RAW), random.Random(3)
    alphabet = "abc ABC  \t\n\r'sdtmrevll.,!?0123456789éßñ漢字😀  ́\x1c\x85\x00<|endoftext|>ªⅫ²"
    texts = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 60))) for _ in range(4000)]
    texts += [x or "" for x in ODD_TEXTS] + ["a <|endoftext|><|endoftext|> b"]
    for text, want in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        got = memoryview(c.encode(text)).cast("i").tolist()
        assert got == want.ids, repr(text[:80])
        assert decoded(c, got) == t.decode(want.ids, skip_special_tokens=False)


def test_partial_characters_decode_like_the_library():
    t, c, rnd = Tokenizer.from_file(PATH), bpe.Codec(RAW), random.Random(5)
    for _ in range(500):
        ids = [rnd.randrange(50257) for _ in range(rnd.randint(0, 8))]
        assert decoded(c, ids) == t.decode(ids, skip_special_tokens=False)


def test_documents_round_trip(spark, documents, odd_docs, no_docs):
    for docs in (documents, odd_docs):
        want = sorted((str(r.doc_id), r.text or "") for r in docs.collect())
        got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
        assert sorted((str(r.doc_id), r.decoded_text) for r in got) == want
        both = bpe.round_trip(docs, PATH)
        assert sorted((str(r.doc_id), list(r.ids), r.decoded_text) for r in both.collect()) == sorted((str(r.doc_id), list(r.ids), r.decoded_text) for r in got)
    assert bpe.report(bpe.decode(bpe.encode(no_docs, PATH), PATH)).count() == 0
    assert bpe.report(bpe.round_trip(no_docs, PATH)).count() == 0


def test_digests_are_those_of_the_library(spark, odd_docs):
    t = Tokenizer.from_file(PATH)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in odd_docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want.append((str(r.doc_id), len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    got = bpe.report(bpe.round_trip(odd_docs, PATH)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
