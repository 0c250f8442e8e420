"""Toxicity by nearest labelled examples.

Fit, on at most MAX_EXAMPLES labelled rows (a documented bound; rows are taken by a hash of
their id): every word of two examples or more is a term, and so are the stems of 2 to 6 letters
that chi-square ties to the label (inflected languages say little by whole words). Examples, toxic and clean ones alike, become unit vectors of
(1 + log count) x IDF x relevance. Document frequencies are those of all documents. Relevance is
the term's phi coefficient with the label (RELEVANCE at least): without it the many rare words of
a text drown the few that matter, and neighbours share a topic instead of a tone. Terms of more
than STOP of the examples (STOP_LEAST at least) that the label says little about are stop words.

Search is exact: examples lie in blocks of BLOCK rows, and each term's postings are cut into
segments, one a block, that carry their largest weight. The blocks with the highest bounds are
scored first, then all whose bound reaches the k-th best cosine found. Votes are weighted by the
squared cosine and shrunk to the base rate; isotonic regression on left-one-out votes of the
examples turns them into probabilities.

Every document is scored in the scan, over its whole text; no text is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strider.llm.shared import give_back, keep, text_key

MAX_EXAMPLES = 16_000
CALIBRATION = 4_000
MIN_STEM_DOCS, MIN_CHI2 = 5, 15.0
#: The least relevance of a term; the share of examples that makes a stop word of a term whose
#: relevance is under STOP_RELEVANCE (a label that one language in ten holds gives its words half of the
#: usual bound of a small effect, 0.1).
RELEVANCE, STOP, STOP_LEAST, STOP_RELEVANCE = 0.003, 0.01, 50, 0.05
BLOCK, FIRST_BLOCKS, NEIGHBOURS, PRIOR_WEIGHT = 64, 4, 15, 0.01
STEMS = (2, 3, 4, 5, 6)
THRESHOLD = 0.7
_WORD = regex.compile(r"\p{L}+").findall


def stems_of(word: str) -> list[str]:
    return [f"{word[:n]}*" for n in STEMS if len(word) > n]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), then starts[1] and so on."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Index:
    """Block-max inverted index over unit vectors of examples."""

    def __init__(self, terms: np.ndarray, rows: np.ndarray, weights: np.ndarray, n: int, n_terms: int):
        """Parallel arrays with an entry per term of an example; n examples, n_terms terms."""
        key = terms.astype(np.int64) * n + rows
        order = np.argsort(key, kind="stable").astype(np.int32)
        key = key[order]
        self.n, self.blocks = n, -(-n // BLOCK)
        self.rows, self.weights = rows[order].astype(np.int32), weights[order].astype(np.float32)
        del order
        key //= max(1, n)  # terms, in order
        first = np.append(True, (key[1:] != key[:-1]) | (self.rows[1:] // BLOCK != self.rows[:-1] // BLOCK))[: len(key)]
        self.starts = np.flatnonzero(first).astype(np.int32)  # of segments
        terms = key[self.starts]
        self.sizes = np.diff(np.append(self.starts, len(key))).astype(np.int32)
        self.block = (self.rows[self.starts] // BLOCK).astype(np.int32)
        self.top = np.maximum.reduceat(self.weights, self.starts) if len(key) else np.zeros(0, np.float32)
        self.at = np.searchsorted(terms, np.arange(n_terms + 1)).astype(np.int32)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and rows of the k nearest examples, best first; ties by row."""
        if not len(terms):
            return np.zeros(0), np.zeros(0, np.int64)
        begin, sizes = self.at[terms], self.at[terms + 1] - self.at[terms]
        segments, w = _ranges(begin, sizes), np.repeat(weights, sizes)
        block = self.block[segments]
        bound = np.bincount(block, w * self.top[segments], self.blocks)
        first = np.argsort(-bound, kind="stable")[:FIRST_BLOCKS]
        chosen = np.zeros(self.blocks, bool)
        chosen[first] = bound[first] > 0
        score = self._score(segments, w, chosen[block], without)
        near = score[np.flatnonzero(score)]
        least = np.partition(near, len(near) - k)[len(near) - k] if len(near) >= k else 0.0
        more = (bound >= max(least - 1e-9, 1e-30)) & ~chosen
        if more.any():
            score = score + self._score(segments, w, more[block], without)
        # What is under the k-th best of the first blocks can't be among the best of all.
        found = np.flatnonzero(score >= max(least, 1e-30))
        found = found[np.lexsort((found, -score[found]))][:k]
        return score[found], found

    def _score(self, segments: np.ndarray, w: np.ndarray, chosen: np.ndarray, without: int) -> np.ndarray:
        segments = segments[chosen]
        sizes = self.sizes[segments]
        at = _ranges(self.starts[segments], sizes)
        score = np.bincount(self.rows[at], self.weights[at] * np.repeat(w[chosen], sizes), self.n)
        if without >= 0:
            score[without] = 0.0
        return score


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the best non-decreasing fit of y on x (pool adjacent violators), each pool
    smoothed by one pseudo-example of either label."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of y, n, sum of x
    for i in order:
        pools.append([float(y[i]), 1.0, float(x[i])])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    at = np.array([s / n for _, n, s in pools])
    p = np.maximum.accumulate(np.array([(s + 0.5) / (n + 1) for s, n, _ in pools]))
    return at, p


class Model:
    """What a fit leaves: bounded by the terms of MAX_EXAMPLES rows, so it can be sent to all tasks."""

    def __init__(self, number: dict[str, int], weights: np.ndarray, ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, base: float):
        """ids, labels and numbers of terms of the examples; terms and counts of all of them in a row."""
        self.number, self.term_weights, self.base, n = number, weights, base, len(ids)
        rows, starts = np.repeat(np.arange(n, dtype=np.int32), sizes), np.append(0, np.cumsum(sizes))
        w = np.log(counts, dtype=np.float32)
        w += 1
        w *= weights.astype(np.float32)[terms]
        # Like with like: examples with the same weightiest term are neighbours in their blocks.
        top = np.full(n, -1)
        for i in np.flatnonzero(sizes):
            own = slice(starts[i], starts[i + 1])
            w[own] /= max(float(np.sqrt(w[own] @ w[own])), 1e-30)
            top[i] = terms[own][np.argmax(w[own])]
        order = np.lexsort((ids, top))
        place = np.empty(n, np.int32)
        place[order] = np.arange(n, dtype=np.int32)
        self.ids, self.labels = ids[order], labels[order].astype(float)
        self.index = Index(terms, place[rows], w, n, len(number))
        # Every so many examples, CALIBRATION at most, are left out in turn to calibrate the votes.
        left_out, votes = range(0, n, -(-n // CALIBRATION) or 1), []
        for i in left_out:
            own = slice(starts[order[i]], starts[order[i] + 1])
            votes.append(self._vote(*self.index.search(terms[own], w[own].astype(float), NEIGHBOURS, i)))
        self.knots = isotonic(np.array(votes), self.labels[left_out]) if n else (np.array([0.0, 1.0]), np.array([base, base]))

    def _unit(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.term_weights[terms]
        return w / max(float(np.sqrt(w @ w)), 1e-30)

    def _vote(self, cosines: np.ndarray, rows: np.ndarray) -> float:
        w = cosines * cosines
        return float((w @ self.labels[rows] + PRIOR_WEIGHT * self.base) / (w.sum() + PRIOR_WEIGHT))

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The probability of label 1, and the cosines and rows of the neighbours that gave it."""
        if not len(terms):
            return self.base, np.zeros(0), np.zeros(0, np.int64)
        cosines, rows = self.index.search(terms, self._unit(terms, counts), NEIGHBOURS)
        vote = self._vote(cosines, rows)
        p = float(np.interp(vote, *self.knots))
        return min(1.0, max(0.0, 0.98 * p + 0.02 * vote)), cosines, rows


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 3 == 1


class _Terms:
    """Finds the known terms of a text."""

    def __init__(self, number: dict[str, int]):
        self.number = number
        self.stems = [(n, {t[:-1]: i for t, i in number.items() if len(t) == n + 1 and t[-1] == "*"}) for n in STEMS]

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The known terms of a whole text, ascending, and how often each occurs."""
        seen, number = Counter(_WORD((text or "").lower())), self.number
        out = {number[w]: k for w, k in seen.items() if w in number}
        for n, stems in self.stems:
            for w in [w for w in seen if w[:n] in stems and len(w) > n] if stems else ():
                i = stems[w[:n]]
                out[i] = out.get(i, 0) + seen[w]
        terms, counts = np.fromiter(out, np.int64, len(out)), np.fromiter(out.values(), np.int64, len(out))
        order = np.argsort(terms)
        return terms[order], counts[order]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def training_rows(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """doc_id, toxic, text: labelled rows outside the held-out third, at most about
    max_examples of them. Labels of a document that disagree count as 1; null labels don't count;
    of an id's texts the one with the least hash is the example."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = usable.count()
    share = min(1.0, max_examples / max(1, n))
    picked = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # At most about max_examples rows of 12 bytes, so the broadcast has a fixed bound.
    rows = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(text_key("text").alias("h"), "text")).alias("x"))
    return keep(rows.select("doc_id", "toxic", "x.text"), "examples")


def document_frequencies(docs: DataFrame, sent, n_terms: int) -> tuple[int, np.ndarray]:
    """The rows of docs, and how many of them hold each numbered term (sent: a broadcast dict),
    over every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, rows = _Terms(sent.value), np.zeros(n_terms, np.int64), 0
        for part in _slices(batches):
            rows += part.num_rows
            for text in part.column(0).to_pylist():
                seen[known.counts(text)[0]] += 1
        t = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, t).astype(np.int32)), pa.array(np.append(rows, seen[t]))], names=["t", "n"])
        give_back()

    found = docs.select("text").mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toPandas()
    out, terms = np.zeros(n_terms, np.int64), found["t"].to_numpy() >= 0
    out[found["t"][terms]] = found["n"][terms]
    return int(found["n"][~terms].sum()), out


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Model:
    """Learns from labels' toxic column; lang, source and ids are no inputs."""
    rows = training_rows(docs.select("doc_id", "text"), labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")), max_examples)
    totals = rows.groupBy("toxic").count().collect()
    n1 = sum(r["count"] for r in totals if r["toxic"] == 1)
    n = sum(r["count"] for r in totals)

    def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every, toxic = Counter(), Counter()
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = set(_WORD((text or "").lower()))
                found = words.union(*map(stems_of, words))
                every.update(found)
                if y == 1:
                    toxic.update(found)
            yield pa.RecordBatch.from_arrays([pa.array([*every], pa.string()), pa.array([*every.values()], pa.int64()), pa.array([toxic[t] for t in every], pa.int64())], names=["term", "n", "n1"])

    a, b = F.col("n1"), F.col("n") - F.col("n1")
    c, d = n1 - a, (n - n1) - b
    phi2 = F.pow((a * d - b * c).cast("double"), F.lit(2)) / (F.lit(float(max(1, n1 * (n - n1)))) * F.col("n") * F.greatest(n - F.col("n"), F.lit(1)))
    counted = rows.select("text", "toxic").mapInArrow(term_counts, "term string, n long, n1 long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))
    counted = counted.where("n >= 2").withColumn("phi", F.sqrt(phi2))
    stem = (F.col("n") >= MIN_STEM_DOCS) & (F.col("phi") * F.col("phi") * n >= MIN_CHI2)
    known = (stem | ~F.col("term").endswith("*")) & ((F.col("n") <= max(STOP_LEAST, STOP * n)) | (F.col("phi") >= STOP_RELEVANCE))
    chosen = counted.where(known).select("term", F.greatest("phi", F.lit(RELEVANCE)).alias("phi")).toPandas().sort_values("term")
    phi, number = chosen["phi"].to_numpy(float), {t: i for i, t in enumerate(chosen["term"])}
    del chosen
    sent = docs.sparkSession.sparkContext.broadcast(number)
    total, df = document_frequencies(docs, sent, len(number))
    weights = (np.log((1 + total) / (1 + df)) + 1) * phi

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Terms(sent.value)
        for part in _slices(batches):
            got = [known.counts(t) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([t.astype(np.int32).tobytes() for t, _ in got], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in got], pa.binary())], names=["doc_id", "toxic", "t", "c"])
        give_back()

    found = rows.select("doc_id", "toxic", "text").mapInArrow(vectors, "doc_id long, toxic int, t binary, c binary").toPandas()
    ids, labels = found["doc_id"].to_numpy(np.int64), found["toxic"].to_numpy(np.int64)
    t, c = (np.frombuffer(b"".join(found[k]), np.int32) for k in "tc")
    sizes = np.array([len(x) // 4 for x in found["t"]], np.int64)
    del found
    model = Model(number, weights, ids, labels, sizes, t, c, (n1 + 0.5) / (n + 1))
    del t, c
    sent.unpersist()
    give_back()
    return model


_OUT = "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id:long,similarity:double,toxic:int>>"
_EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (the three nearest examples) for every row.

    Null and empty texts, and texts without a known term, get the base rate of the labels. Equal
    texts get equal scores, whatever their ids; rows that repeat are scored each. Neighbours at
    equal cosines rank by their place in the index. Without labels every score is the base rate;
    an empty table gives no rows. Very long texts are scored whole. Other columns of docs are
    ignored, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        known = _Terms(m.number)
        for part in _slices(batches):
            scores, evidence = [], []
            for text in part.column(2).to_pylist():
                p, cosines, rows = m.score(*known.counts(text))
                scores.append(p)
                evidence.append([{"doc_id": int(m.ids[i]), "similarity": s, "toxic": int(m.labels[i])} for s, i in zip(cosines[:3].tolist(), rows[:3].tolist())])
            s = np.array(scores, float)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(evidence, _EVIDENCE)], names=["doc_id", "held_out", "score", "predicted", "evidence"])
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, _OUT)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs without the rows that the model rejects, in docs' own columns.

    Each row is judged by its own text, so ids may repeat or be null, and other columns pass
    through whatever their names and values. Null and empty texts stay unless most labels are 1."""
    sent, at = docs.sparkSession.sparkContext.broadcast(fit(docs, labels)), docs.columns.index(text_col)
    give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        known = _Terms(m.number)
        for part in _slices(batches):
            yield part.filter(pa.array([m.score(*known.counts(t))[0] < threshold for t in part.column(at).to_pylist()], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)
