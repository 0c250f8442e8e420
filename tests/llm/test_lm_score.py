import time
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import xxhash

from strider.llm import lm_score


def words(t):
    low = (t or "").translate({c: c + 32 for c in range(65, 91)})
    return [x for x in low.translate({c: " " for c in range(9, 14)}).split(" ") if x] + [""]


def brute(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    return sorted((str(i), held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t)), 6)) for i, t in rows)


def check(df, **how):
    got = lm_score.score(df, **how).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == brute([(r.doc_id, r.text) for r in df.collect()])
    return got


def test_base_scores_and_gain_on_held_out_texts(spark, documents):
    got = check(documents)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_few_common_tokens_give_the_same(spark, documents):
    check(documents, common=50)


def test_odd_rows(spark, odd_docs, no_docs):
    check(odd_docs)
    assert lm_score.score(no_docs).count() == 0


def test_probabilities_sum_to_one():
    counts = np.sort(np.random.default_rng(2).integers(1, 500, 1500))[::-1]
    m = lm_score.Model(counts, int(counts.sum()) + 700, 2000)
    rng = np.random.default_rng(3)
    v = rng.integers(0, 1500, 5000).astype(np.uint64)
    m.learn(v, np.array([0, 2000]))
    rest = m.rest_mass
    total = 0.0
    for w in range(m.words):
        total += np.exp(m.log_probabilities(np.array([7, 9, w], np.uint64), np.array([0]))[2])
    last = np.exp(m.log_probabilities(np.array([7, 9, 1400], np.uint64), np.array([0]))[2])
    total += last * (counts[m.words :].sum() + 700 + 0.5 * (2000 - m.words + 1)) / rest
    assert abs(total - 1) < 1e-3


def test_texts_are_split_as_words_are():
    texts = [None, "", "  ", "a", " B  a\tb\x0b\x0c\r\n", "a\x1cb\x85c É é", "x" * 5000, "a b " * 2000, None, "end "]
    for column in (pa.array(texts), pa.array(["skipped", *texts, "too"]).slice(1, len(texts))):
        got = []
        for _, hashes, at, starts in lm_score._slices(column):
            got += [p.tolist() for p in np.split(hashes[at], starts[1:])]
        assert got == [[lm_score._hash(w) for w in lm_score.tokens(t)] for t in texts]


def test_scores_without_features_are_the_counts(spark, documents, odd_docs):
    """Of every token: frequent ones, those of the tree, those that tasks do not hold, unknown ones."""
    for df, common in ((documents, 200_000), (documents, 1500), (documents, 50), (odd_docs, 5)):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
        c = Counter(w for i, t in rows if not held(i) for w in words(t))
        counts = sorted(c.values(), reverse=True)
        got = lm_score.score(df, rounds=0, common=common).collect()
        # All tokens of a count are sent to the tasks or none: the least count of which all fit.
        least = min((k for k in set(counts) if sum(x >= k for x in counts) <= common), default=float("inf"))
        in_classes = min(1024, sum(x >= least for x in counts))
        border = counts[in_classes - 1] if in_classes else float("inf")
        if 0 < in_classes < len(counts) and counts[in_classes] == border:
            # Tied tokens at the border count c or c + 0.5 by their hash: allow either.
            slack = log10((border + 0.5) / border)
        else:
            slack = 0.0
        z = sum(c.values()) + 0.5 * (len(c) - in_classes + 1)
        want = {}
        for i, t in rows:
            x = sum(log10((c[w] + (0.5 if c[w] < border or not in_classes else 0)) / z) for w in words(t))
            want.setdefault((str(i), len(words(t))), []).append((x, x + slack * sum(c[w] == border for w in words(t))))
        assert all(any(a - 1e-4 * r.n_tokens - 1e-3 <= r.score <= b + 1e-4 * r.n_tokens + 1e-3 for a, b in want[(str(r.doc_id), r.n_tokens)]) for r in got)


def test_context_tells_words_apart_beyond_the_first_classes(spark):
    """Which word of a pair follows is learnt for words that are rarer than the 1 024 of the first classes."""
    rng = np.random.default_rng(5)
    rows = [(int(i), " ".join(f"w{w}" for w in rng.permutation(1100))) for i in range(1000, 1040)]
    rows += [(int(i), " ".join(f"a{k} b{k}" for k in rng.permutation(300))) for i in range(2000, 2030)]
    order = rng.permutation(300)
    known = next(i for i in range(5000, 6000) if zlib.crc32(str(i).encode()) % 5 == 1)
    mixed = next(i for i in range(6000, 7000) if zlib.crc32(str(i).encode()) % 5 == 1)
    rows += [(known, " ".join(f"a{k} b{k}" for k in order)), (mixed, " ".join(f"a{k} b{j}" for k, j in zip(order, np.roll(order, 1))))]
    got = {r.doc_id: r for r in check(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert abs(got[known].base_score - got[mixed].base_score) < 1e-6
    # 300 pairs; the classes alone, which see that pairs are known, make a difference of 12, the tree 38.
    assert got[known].score > got[mixed].score + 25


def test_probabilities_of_the_whole_vocabulary_sum_to_one():
    rng = np.random.default_rng(7)
    counts = np.sort(rng.integers(1, 300, 6000))[::-1]
    hashes = rng.integers(0, 1 << 63, 6000).astype(np.uint64) | np.uint64(1 << 63)
    rare = np.s_[4000:]  # tokens that tasks know by their hash alone
    leaf = (hashes >> np.uint64(lm_score.LEAF_SHIFT)) & np.uint64(255)
    masses = np.bincount(leaf[1024:].astype(np.int64), counts[1024:] + 0.5, 256)
    m = lm_score.Model(counts[:4000], int(counts.sum()), 6000, hashes[:4000].view(np.int64), masses)
    everything = np.arange(6000, dtype=np.uint64)
    everything[rare] = hashes[rare]
    v = everything[rng.integers(0, 6000, 20_000)]
    m.learn(v, np.array([0, 7000]))
    assert np.abs(m.by_node).max() > 0
    after = np.stack([np.full(6000, v[3]), np.full(6000, v[4]), everything], axis=1).ravel()
    starts = np.arange(0, len(after), 3)
    p = m.log_probabilities(after, starts)[2::3]
    p[1024:] += m.tree_log_probabilities(after, starts)[2::3][1024:] + np.log(counts[1024:] + 0.5) + np.log(m.known_share)
    unknown = m.log_probabilities(np.array([v[3], v[4], hashes[-1]]), np.array([0]))[2] + np.log(0.5) - np.log(m.rest_mass)
    assert abs(np.exp(p).sum() + np.exp(unknown) - 1) < 1e-3


def plain_softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def plain_step(w, rows, gradient, prior=0.0):
    """Each row moves by the mean of its gradients, one row at a time."""
    for r in np.unique(rows):
        mine = gradient[rows == r]
        w[r, : gradient.shape[1]] -= lm_score.RATE * mine.sum(axis=0) / (len(mine) + prior)


def test_learning_is_the_plain_gradient_step():
    rng = np.random.default_rng(11)
    counts = np.sort(rng.integers(1, 300, 6000))[::-1]
    hashes = rng.integers(0, 1 << 63, 6000).astype(np.uint64) | np.uint64(1 << 63)
    leaf = (hashes >> np.uint64(lm_score.LEAF_SHIFT)) & np.uint64(255)
    m = lm_score.Model(counts, int(counts.sum()), 6000, hashes.view(np.int64), np.bincount(leaf[1024:].astype(np.int64), counts[1024:] + 0.5, 256))
    v = np.minimum(rng.zipf(1.2, 5000), 6000).astype(np.uint64) - np.uint64(1)
    starts = np.array([0, 1500, 1501])
    contexts, words, nodes = (x.astype(np.float64) for x in (m.by_context[:, :, :33], m.by_word, m.by_node))
    rows, word_rows = m._features(v, starts)
    for s in range(0, len(v), lm_score.BATCH):
        at = np.arange(s, min(s + lm_score.BATCH, len(v)))
        p = plain_softmax(m.class_bias[:33] + sum(w[r[at]] for w, r in zip(contexts, rows)))
        known = at[v[at] < 1024]
        c, i = np.divmod(v[known].astype(np.int64), 32)
        p[np.arange(len(at)), np.where(v[at] < 1024, v[at].astype(np.int64) // 32, 32)] -= 1
        for w, r in zip(contexts, rows):
            plain_step(w, r[at], p)
        q = plain_softmax(m.word_bias[c] + words[word_rows[known], c])
        q[np.arange(len(known)), i] -= 1
        plain_step(words.reshape(-1, 32), word_rows[known] * 32 + c, q)
    rest = np.flatnonzero(v >= 1024)
    last, of = lm_score._back(v, starts, 1), m._leaf(v)
    for s in range(0, len(rest), lm_score.BATCH):
        at = rest[s : s + lm_score.BATCH]
        for shift, width, bias in m.levels:
            node = of[at] >> (shift + width)
            r = (lm_score.mix(last[at] + (node + len(bias)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 22) % np.uint64(lm_score.NODE_ROWS)).astype(np.int64)
            p = plain_softmax(bias[node] + nodes[r, : 1 << width])
            p[np.arange(len(at)), (of[at] >> shift) & ((1 << width) - 1)] -= 1
            plain_step(nodes, r, p, lm_score.NODE_PRIOR)
    m.learn(v, starts)
    assert min(np.abs(w).max() for w in (m.by_context, m.by_word, m.by_node)) > 0.1
    assert np.abs(m.by_context[:, :, :33] - contexts).max() < 1e-4 and not m.by_context[:, :, 33:].any()
    assert np.abs(m.by_word - words).max() < 1e-4 and np.abs(m.by_node - nodes).max() < 1e-4


def test_logits_beyond_the_bounds_stay_finite():
    for far in (300.0, -300.0):
        z = np.full((3, 4), far, np.float32)
        z[1, 2] = -far
        p = lm_score._softmax(z.copy())
        assert np.isfinite(p).all() and np.abs(p.sum(axis=1) - 1).max() < 1e-6
        for k in range(4):
            got = lm_score._log_softmax(z.copy(), np.full(3, k))
            assert np.isfinite(got).all() and np.abs(np.exp(got) - p[:, k]).max() < 1e-6


def test_rare_tokens_are_summed_by_document():
    rng = np.random.default_rng(13)
    doc, v, way = np.sort(rng.integers(1, 40, 500)), rng.integers(0, 9, 500).astype(np.uint64) | np.uint64(1 << 63), rng.random(500)
    for n in (500, 0):
        want = {}
        for d, x, y in zip(doc[:n], v[:n], way[:n]):
            k, total = want.get((d, x), (0, 0.0))
            want[d, x] = k + 1, total + y
        rare, times, ways, ends = lm_score._by_document(doc[:n], v[:n], way[:n], 45)
        of = np.repeat(np.arange(45), np.diff(ends.to_numpy()))
        assert list(zip(of, rare)) == sorted(want)
        assert times.tolist() == [want[k][0] for k in sorted(want)] and np.allclose(ways, [want[k][1] for k in sorted(want)])


def test_words_are_hashed_together():
    """Splitting and coding a text costs about what a call for each of its words would (0.9 of it; 2.4 with such calls)."""
    text = " ".join(f"w{i}" for i in range(200_000))
    each, words = xxhash.xxh3_64_intdigest, [w.encode() for w in text.split()]

    def seconds(f):
        t = time.process_time()
        f()
        return time.process_time() - t

    ratios = [seconds(lambda: list(lm_score._slices(pa.array([text])))) / seconds(lambda: np.fromiter((each(w) | 1 << 63 for w in words), np.uint64, len(words))) for _ in range(5)]
    assert min(ratios) < 1.5
    odd = [b"", b"a\0b", b"a\0c", b"a", b"\xff\xfe", "é".encode()]
    assert len({lm_score._hash(w) for w in odd}) == len(odd)
