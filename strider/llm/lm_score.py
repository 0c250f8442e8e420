"""Language-model scores: a hashed maximum-entropy model over exact corpus counts.

Counts: a scan counts every token of the training documents; a token is a 64-bit hash. The
COMMON most frequent ones (a fixed bound) are sent to all tasks; what documents hold besides is
joined with the full count table, so that every token has its exact count.

Model: the VOCABULARY most frequent tokens in classes of equal size, all other tokens in one
class more, which is a tree of classes: each level is a softmax over the next bits of the token's
hash, started at the counts below, until about IN_CLASS tokens share a leaf. The tree is sized by
the distinct tokens, so that context chooses among all of them; a leaf's few tokens are told apart
by their exact counts. log p(token | context) = log softmax over classes + log softmax over the
class's tokens (in the last class: the levels' log softmax + log share of the leaf). Features are
hashed: the last word, the one before, both (n-grams), the third last (a skip), each with weights
for classes; the last word has weights for tokens and for the tree's nodes too. Every task makes
gradient steps over its own documents from the same start; the parameter blocks that tasks return
are averaged by Spark, weighted by tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strider.llm.line_index import mix
from strider.llm.shared import keep

COMMON = 200_000
CLASSES, IN_CLASS = 32, 32
VOCABULARY = CLASSES * IN_CLASS
WIDE = CLASSES + 2  # of class weights: one column for the last class, and an unused one that makes the width even (see _descend)
BOUND = np.float32(80)  # of logits
CONTEXT_ROWS, WORD_ROWS, NODE_ROWS = 1 << 13, 1 << 9, 1 << 15
LEVEL_BITS, LEAF_SHIFT = 5, 20  # at most 32 branches a node; the leaf is read from these bits of the hash
BATCH, RATE, NODE_PRIOR = 2048, 0.3, 3.0
SLICE_BYTES = 1 << 20  # text in one step of a task
BLOCK = 1 << 14  # parameters in a row that a task returns
_END = b""  # no word is empty, so this is the end token
_BOS = np.uint64(0xFFFFFFFFFFFFFFFF)
_TOP = 1 << 63
_SEEDS = (11, 12, 13, 14)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 1, F.lit(False))


def tokens(text: str | None) -> list[bytes]:
    """A-Z lowered, split at ASCII white space, then one end."""
    out = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out.append(_END)
    return out


def _hashes(words: np.ndarray) -> np.ndarray:
    """Of an array of bytes objects; never below COMMON."""
    return pd.util.hash_array(words, categorize=False) | np.uint64(_TOP)


def _hash(word: bytes) -> int:
    return int(_hashes(np.array([word], object))[0])


def token_counts(texts: DataFrame) -> DataFrame:
    """h, c for every distinct token of the column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, words, at, _ in _slices(b.column(0)):
                seen = np.bincount(at, minlength=len(words))
                yield pa.RecordBatch.from_arrays([pa.array(words[seen > 0].view(np.int64)), pa.array(seen[seen > 0])], names=["h", "c"])

    return texts.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


_SCRATCH: dict[str, np.ndarray] = {}


def _scratch(name: str, n: int, k: int, dtype: type = np.float32) -> np.ndarray:
    """An n x k array that the next call of this name writes over: a task's steps are many, and fresh
    memory for each costs more than its arithmetic."""
    if name not in _SCRATCH or len(_SCRATCH[name]) < n * k:
        _SCRATCH[name] = np.empty(max(n, BATCH) * max(k, WIDE), dtype)
    return _SCRATCH[name][: n * k].reshape(n, k)


class Model:
    """Parameters; bias starts at the counts, the weights of features at zero."""

    def __init__(self, counts: np.ndarray, total: int, distinct: int, hashes: np.ndarray | None = None, masses: np.ndarray | None = None):
        """masses: of the tree's leaves (see leaf_masses); without them the last class has no tree."""
        n = min(VOCABULARY, len(counts))
        known = np.zeros(VOCABULARY)
        known[:n] = counts[:n]
        rest = total - known.sum()
        self.rest_mass = float(rest + 0.5 * (max(0, distinct - n) + 1))
        self.words = n
        per_class = known.reshape(CLASSES, IN_CLASS)
        with np.errstate(divide="ignore"):
            self.class_bias = np.append(_below_zero(np.log(np.append(per_class.sum(axis=1), self.rest_mass) + 1e-9)), -BOUND)
            self.word_bias = _below_zero(np.where(known > 0, np.log(np.maximum(known, 1e-9)), -40.0).reshape(CLASSES, IN_CLASS))
        self.by_context = np.zeros((len(_SEEDS), CONTEXT_ROWS, WIDE), np.float32)
        self.by_word = np.zeros((WORD_ROWS, CLASSES, IN_CLASS), np.float32)
        self.by_node = np.zeros((NODE_ROWS, 1 << LEVEL_BITS), np.float32)
        self.hashes = np.zeros(0, np.uint64) if hashes is None else hashes.view(np.uint64)
        self.known_share = max(self.rest_mass - 0.5, 1e-9) / self.rest_mass  # of the last class: the rest is for unknown tokens
        self.leaves, self.levels = 0, []
        if masses is not None:
            self._plant(masses)

    def _plant(self, masses: np.ndarray) -> None:
        """The levels of the tree: (shift, width in bits, log masses of each node's branches)."""
        self.leaves, bits = len(masses), len(masses).bit_length() - 1
        self.leaf_log = np.log(np.maximum(masses, 1e-9))
        depth = -(-bits // LEVEL_BITS)
        for i, shift in enumerate(np.cumsum([bits * (k + 1) // depth - bits * k // depth for k in range(depth)])):
            width = bits * (i + 1) // depth - bits * i // depth
            below = masses.reshape(1 << int(shift), -1).sum(axis=1)
            self.levels.append((bits - int(shift), width, _below_zero(np.log(np.maximum(below, 1e-9)).reshape(-1, 1 << width))))

    def parameters(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in (self.by_context, self.by_word, self.by_node)])

    def put(self, flat: np.ndarray) -> None:
        n = np.cumsum([self.by_context.size, self.by_word.size])
        self.by_context, self.by_word, self.by_node = (x.reshape(w.shape).copy() for x, w in zip(np.split(flat, n), (self.by_context, self.by_word, self.by_node)))

    def _leaf(self, v: np.ndarray) -> np.ndarray:
        h = v.copy()
        common = np.flatnonzero(v < len(self.hashes))
        h[common] = self.hashes[v[common].astype(np.int64)]
        return ((h >> np.uint64(LEAF_SHIFT)) & np.uint64(self.leaves - 1)).astype(np.int64)

    def _walk(self, last: np.ndarray, leaf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each level: rows of the node's weights given the last word, logits of its branches, the branch taken."""
        for shift, width, bias in self.levels:
            node = leaf >> (shift + width)
            rows = _row(last + (node + len(bias)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 22, NODE_ROWS) << (LEVEL_BITS - width)
            z, more = _scratch("level", len(leaf), 1 << width), _scratch("more", len(leaf), 1 << width)
            np.take(bias, node, axis=0, out=z, mode="clip")
            z += np.take(self._nodes(width), rows, axis=0, out=more, mode="clip")
            yield rows, z, (leaf >> shift) & ((1 << width) - 1)

    def _nodes(self, width: int) -> np.ndarray:
        """The weights of nodes in rows of 1 << width: a node has the first of those that its row of by_node is cut into."""
        return self.by_node.reshape(-1, 1 << width)

    def tree_log_probabilities(self, v: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Natural logs, for tokens of the last class, of the way to the leaf over the leaf's mass: with
        log(count + 0.5) and log(known_share) it makes the token's share of the class. Others: 0."""
        out, last = np.zeros(len(v)), _back(v, starts, 1)
        rest = np.flatnonzero(v >= self.words)
        for s in range(0, len(rest), BATCH):
            at = rest[s : s + BATCH]
            leaf = self._leaf(v[at])
            x = -self.leaf_log[leaf]
            for _, z, branch in self._walk(last[at], leaf):
                x += _log_softmax(z, branch)
            out[at] = x
        return out

    def _features(self, v: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Rows of the hashed features of each token's context; starts are documents' first tokens."""
        p1, p2, p3 = (_back(v, starts, k) for k in (1, 2, 3))
        rows = [p1, p2, p1 * np.uint64(3) + p2, p3]
        return [_row(r, s, CONTEXT_ROWS) for r, s in zip(rows, _SEEDS)], _row(p1, 21, WORD_ROWS)

    def _forward(self, rows: list[np.ndarray], word_rows: np.ndarray, v: np.ndarray):
        """Logits of the classes, each token's class, and of those that are in the first classes their places,
        class, number in it and logits of the class's words."""
        z, more = _scratch("classes", len(v), WIDE), _scratch("more", len(v), WIDE)
        z[:] = self.class_bias
        for w, r in zip(self.by_context, rows):
            z += np.take(w, r, axis=0, out=more, mode="clip")
        known = np.flatnonzero(v < self.words)
        of = v[known].astype(np.int64)
        c, i = of // IN_CLASS, of % IN_CLASS
        y = np.full(len(v), CLASSES)
        y[known] = c
        inside, more = _scratch("inside", len(known), IN_CLASS), _scratch("more", len(known), IN_CLASS)
        if len(known):
            np.take(self.word_bias, c, axis=0, out=inside, mode="clip")
            inside += np.take(self.by_word.reshape(-1, IN_CLASS), word_rows[known] * CLASSES + c, axis=0, out=more, mode="clip")
        return z, y, known, c, i, inside

    def log_probabilities(self, v: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Natural logs; for tokens of the last class, of the class only."""
        rows, word_rows = self._features(v, starts)
        out = np.zeros(len(v))
        for s in range(0, len(v), BATCH):
            e = min(s + BATCH, len(v))
            z, y, known, c, i, inside = self._forward([r[s:e] for r in rows], word_rows[s:e], v[s:e])
            out[s:e] = _log_softmax(z, y)
            out[s + known] += _log_softmax(inside, i)
        return out

    def learn(self, v: np.ndarray, starts: np.ndarray) -> None:
        """One gradient step per batch of tokens; a feature moves by its mean gradient."""
        rows, word_rows = self._features(v, starts)
        for s in range(0, len(v), BATCH):
            e = min(s + BATCH, len(v))
            part = [r[s:e] for r in rows]
            z, y, known, c, i, inside = self._forward(part, word_rows[s:e], v[s:e])
            p = _softmax(z)
            p[:, CLASSES + 1 :] = 0
            p[np.arange(e - s), y] -= 1
            for w, r in zip(self.by_context, part):
                _descend(w, r, p)
            if len(known):
                p = _softmax(inside)
                p[np.arange(len(known)), i] -= 1
                _descend(self.by_word.reshape(-1, IN_CLASS), word_rows[s:e][known] * CLASSES + c, p)
        if self.levels:
            self._learn_tree(v, starts)

    def _learn_tree(self, v: np.ndarray, starts: np.ndarray) -> None:
        last, rest = _back(v, starts, 1), np.flatnonzero(v >= self.words)
        for s in range(0, len(rest), BATCH):
            at = rest[s : s + BATCH]
            for rows, z, branch in self._walk(last[at], self._leaf(v[at])):
                p = _softmax(z)
                p[np.arange(len(at)), branch] -= 1
                _descend(self._nodes(int(p.shape[1]).bit_length() - 1), rows, p, NODE_PRIOR)


def _below_zero(logs: np.ndarray) -> np.ndarray:
    """Logits of the same shares, of which the largest of each row is 0."""
    return (logs - logs.max(axis=-1, keepdims=True)).astype(np.float32)


def _bounded(z: np.ndarray) -> np.ndarray:
    """Logits between bounds, so that exp stays finite. They start at 0 or less and hardly ever reach one; to look
    costs a fraction of each row's maximum."""
    return np.clip(z, -BOUND, BOUND, out=z) if z.max(initial=0) > BOUND or z.min(initial=0) < -BOUND else z


def _softmax(z: np.ndarray) -> np.ndarray:
    """In the place of z."""
    np.exp(_bounded(z), out=z)
    z *= (1 / (z @ np.ones(z.shape[1], np.float32)))[:, None]
    return z


def _log_softmax(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each row, of one column alone. Overwrites z."""
    chosen = _bounded(z)[np.arange(len(z)), at].astype(np.float64)
    np.exp(z, out=z)
    return chosen - np.log((z @ np.ones(z.shape[1], np.float32)).astype(np.float64))


def _row(x: np.ndarray, seed: int, rows: int) -> np.ndarray:
    """x hashed to one of `rows` rows (a power of two)."""
    return (mix(x, seed) & np.uint64(rows - 1)).astype(np.int64)


def _back(v: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """A hash of the token k places before each, within its document."""
    out = np.full(len(v), _BOS)
    out[k:] = v[:-k]
    at = np.arange(len(v)) - np.repeat(starts, np.diff(np.append(starts, len(v))))
    out[at < k] = _BOS
    return mix(out, 50 + k)


def _descend(w: np.ndarray, rows: np.ndarray, gradient: np.ndarray, prior: float = 0.0) -> None:
    """Each row moves by the mean of its gradients (with a prior, by less where they are few).

    Widths are even: subtract.at then takes two numbers at a time, as one complex one."""
    pairs, times = gradient.shape[1] // 2, _scratch("times", len(w), 1, np.int64).reshape(-1)
    times[rows] = 0
    np.add.at(times, rows, 1)
    step, at = _scratch("step", *gradient.shape), _scratch("at", len(rows), pairs, np.int64)
    np.multiply(gradient, (RATE / (times[rows] + prior)).astype(np.float32)[:, None], out=step)
    np.add((rows * pairs)[:, None], np.arange(pairs), out=at)
    np.subtract.at(w.reshape(-1).view(np.complex64), at.reshape(-1), step.reshape(-1).view(np.complex64))


def _encoded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of tokens(), for many texts: hashes of distinct words, each token's word, starts."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary())
    hashes = _hashes(np.append(words.to_numpy(zero_copy_only=False), np.array([_END], object)))
    empty = pc.index(words, _END).as_py()  # stands for a text's edge or a run of white space; -1: there is none
    found = coded.indices.to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(column)), lists.value_lengths().to_numpy(zero_copy_only=False))
    rows, found = rows[found != empty], found[found != empty]
    n = np.bincount(rows, minlength=len(column)) + 1  # an end each
    at = np.full(n.sum(), len(words))
    at[np.arange(len(found)) + rows] = found
    return hashes, at, np.cumsum(n) - n


def _slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, hashes of distinct words, each token's word, starts) of about SLICE_BYTES of whole texts."""
    done = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(column):
        before = done[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(done, before + SLICE_BYTES, "right")))
        yield begin, *_encoded(column.slice(begin, end - begin))
        begin = end


class Common:
    """The common tokens' ranks: a token is its rank among them, or else its hash."""

    def __init__(self, hashes: np.ndarray):
        h = hashes.view(np.uint64)
        self.order = np.argsort(h)
        self.sorted = h[self.order]

    def values(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return hashes
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at].astype(np.uint64), hashes)


def common_tokens(counts: DataFrame, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of at most `most` tokens, the most frequent first. All tokens of a count
    are in or out, so that the rest is what is rarer than a number."""
    levels = counts.groupBy("c").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("c")).limit(most).collect()
    least, have = None, 0
    for r in levels:
        if have + r["k"] > most:
            break
        least, have = r["c"], have + r["k"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    got = counts.where(F.col("c") >= least).toPandas().sort_values(["c", "h"], ascending=[False, True])
    return got["h"].to_numpy(np.int64), got["c"].to_numpy(np.int64)


def _averaged(parts: DataFrame, model: Model) -> np.ndarray:
    """The token-weighted mean of the parameter blocks that tasks return (a fixed number of blocks)."""

    def average(p: pd.DataFrame) -> pd.DataFrame:
        total, out = float(p["tokens"].sum()), 0.0
        for w, x in zip(p["tokens"], p["values"]):
            out = out + np.frombuffer(x, np.float32) * (w / total)
        return pd.DataFrame({"block": [int(p["block"].iloc[0])], "values": [np.asarray(out, np.float32).tobytes()]})

    flat = model.parameters()
    for r in parts.groupBy("block").applyInPandas(average, "block int, values binary").collect():
        x = np.frombuffer(r["values"], np.float32)
        flat[r["block"] * BLOCK : r["block"] * BLOCK + len(x)] = x
    return flat


def leaf_masses(counts: DataFrame, hashes: np.ndarray, found: np.ndarray, distinct: int) -> np.ndarray:
    """For each leaf of the tree: sum of count + 0.5 over its tokens, without those of the first classes.

    As many leaves (a power of two) as leave IN_CLASS tokens or fewer in each, on average."""
    first = min(VOCABULARY, len(hashes))
    leaves = 1 << (max(0, -(-(distinct - first) // IN_CLASS) - 1)).bit_length()
    leaf = F.shiftrightunsigned("h", LEAF_SHIFT).bitwiseAND(F.lit(leaves - 1))
    got = counts.groupBy(leaf.alias("leaf")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).toArrow()
    twice = np.zeros(leaves, np.int64)  # whole numbers, so that what is taken away leaves no crumbs
    twice[got["leaf"].to_numpy()] = 2 * got["c"].to_numpy() + got["n"].to_numpy()
    of = (hashes[:first].view(np.uint64) >> np.uint64(LEAF_SHIFT)) & np.uint64(leaves - 1)
    np.subtract.at(twice, of.astype(np.int64), 2 * found[:first] + 1)
    return twice / 2


def train(texts: DataFrame, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int, rounds: int = 1, masses: np.ndarray | None = None) -> Model:
    """One pass over all training texts for each round."""
    spark, model = texts.sparkSession, Model(counts, total, distinct, hashes, masses)
    common = spark.sparkContext.broadcast(Common(hashes))
    for _ in range(rounds):
        start = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, seen = Model.__new__(Model), 0
            m.__dict__.update(start.value.__dict__)
            m.put(start.value.parameters())
            for b in batches:
                for _, words, at, starts in _slices(b.column(0)):
                    m.learn(common.value.values(words)[at], starts)
                    seen += len(at)
            if seen:
                flat = m.parameters()
                for k in range(0, len(flat), BLOCK):
                    yield pa.RecordBatch.from_pydict({"block": pa.array([k // BLOCK], pa.int32()), "tokens": pa.array([seen], pa.int64()), "values": pa.array([flat[k : k + BLOCK].tobytes()], pa.binary())})

        model.put(_averaged(texts.mapInArrow(run, "block int, tokens long, values binary"), model))
    return model


_PART = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<long>, times array<int>, ways array<double>"


def _by_document(doc: np.ndarray, v: np.ndarray, way: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The distinct (doc, v) by document, how often each occurs, the sum of its ways, and the offsets of the n
    documents. doc ascends."""
    order = np.argsort(v, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    doc, v = doc[order], v[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (v[1:] != v[:-1]))) if len(v) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(v)))
    ways = np.bincount(np.repeat(np.arange(len(first)), times), way[order], len(first))
    ends = np.append(0, np.cumsum(np.bincount(doc[first], minlength=n)))
    return v[first], times, ways, pa.array(ends, pa.int32())


def _parts(docs: DataFrame, hashes: np.ndarray, counts: np.ndarray, model: Model) -> DataFrame:
    """Per document: sums over common tokens, and its other tokens with how often each occurs and
    the sum of log10 of the ways to its leaf."""
    sc = docs.sparkSession.sparkContext
    ranks = sc.broadcast(Common(hashes))
    logs = sc.broadcast((np.log10(counts + 0.5), model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_c, m = logs.value
        share = np.log10(m.known_share)
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            for begin, words, at, starts in _slices(b.column(2)):
                v = ranks.value.values(words)[at]
                p = m.log_probabilities(v, starts) / np.log(10)
                way = m.tree_log_probabilities(v, starts) / np.log(10)
                n = len(starts)
                doc = np.repeat(np.arange(n), np.diff(np.append(starts, len(v))))
                common = v < len(log_c)
                rest = common & (v >= m.words)  # common, but in the model's last class
                logs_here = np.zeros(len(v))
                logs_here[common] = log_c[v[common].astype(np.int64)]
                p[rest] += logs_here[rest] + way[rest] + share
                rare, times, ways, ends = _by_document(doc[~common], v[~common], way[~common], n)
                ids, held = b.column(0).slice(begin, n), b.column(1).slice(begin, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n)),
                        ids,
                        held,
                        pa.array(np.bincount(doc, minlength=n)),
                        pa.array(np.bincount(doc, common, n).astype(np.int64)),
                        pa.array(np.bincount(doc, logs_here, n)),
                        pa.array(np.bincount(doc, p, n)),
                        pa.ListArray.from_arrays(ends, pa.array(rare.view(np.int64))),
                        pa.ListArray.from_arrays(ends, pa.array(times, pa.int32())),
                        pa.ListArray.from_arrays(ends, pa.array(ways)),
                    ],
                    names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "rare", "times", "ways"],
                )
                row += n

    return keep(docs.mapInArrow(run, _PART), "score_parts")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1, common: int = COMMON) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Learns from rows whose crc32(id) mod 5 is not 1 (rows without an id among them). Null and
    empty texts are an end token alone. Repeated rows count, and are scored, each. Without any
    training row every token is unknown. Other columns of docs are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    texts = rows.where(~F.col("held_out")).select("text")
    counts = keep(token_counts(texts), "token_counts")
    got = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = got["n"] or 0, got["v"]
    hashes, found = common_tokens(counts, common)
    model = train(texts, hashes, found, total, distinct, rounds, leaf_masses(counts, hashes, found, distinct))
    parts = _parts(rows, hashes, found, model)

    rare = parts.select("row", F.explode(F.arrays_zip("rare", "times", "ways")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("k"), F.col("x.ways").alias("way"))
    joined = rare.join(counts, "h", "left")
    known, logs = F.col("c").isNotNull(), F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    in_class = F.when(known, F.col("way") + F.col("k") * float(np.log10(model.known_share))).otherwise(-F.col("k") * float(np.log10(model.rest_mass)))
    sums = joined.groupBy("row").agg(F.sum(logs).alias("rare_logs"), F.sum(logs + in_class).alias("rare_score"), F.sum(F.when(known, F.col("k")).otherwise(0)).alias("rare_known"))
    out = parts.drop("rare", "times", "ways").join(sums, "row", "left")
    rare_logs = F.coalesce("rare_logs", F.lit(0.0))
    norm = float(np.log10(total + 0.5 * (distinct + 1)))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + rare_logs - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )
