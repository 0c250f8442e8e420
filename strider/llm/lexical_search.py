"""Ranked lexical search over document-sharded postings.

1. A scan sums N (documents with a term) and L (all terms); both go into each posting's impact.
2. Every task turns its documents into shards, without a shuffle: a shard holds a sorted
   dictionary, offsets, and postings by term (document, integer impact). A shard is closed at
   `shard_postings`, so a task's memory has a bound; the shards are a table of the shared folder.
3. Queries go in blocks of bounded size. For each block the dictionaries give the document
   frequencies of its terms, hence the weights; then every shard adds the block's terms one at a
   time into a dense accumulator over its documents and keeps its k best.
4. The k best of all shards meet: once in 64 parts per query, then once per query.
"""

from __future__ import annotations

import itertools
import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strider.llm.shared import UPPER, fresh_path, give_back, keep

#: A shard is closed when it holds as many postings (8 bytes each) ...
SHARD_POSTINGS = 1 << 21
#: ... and queries are answered in blocks of about this many bytes of text.
BLOCK_BYTES = 4 << 20

#: Fixed values of the ranking: length share in percent, and the scale of impacts and weights.
LENGTH_PERCENT = 75
IMPACT, SATURATION, LENGTH_FACTOR, WEIGHT = 1_000_000_000, 1000, 8, 1000

#: Bytes of terms stay (A-Z lowered), all others become spaces. Bytes of 0x80 on belong to terms.
_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_TO_TERMS = bytes(b if _TERM.match(bytes([b])) else 32 for b in range(256)).lower()
_SLICE = 512


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, in UTF-8; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_TERMS).split()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    for b in batches:
        for i in range(0, b.num_rows, _SLICE):
            part = b.slice(i, _SLICE)
            yield part.column(0), part.column(1).to_pylist()


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = words = 0
    for _, texts in _texts(batches):
        for t in texts:
            n = len(terms(t))
            docs, words = docs + (n > 0), words + n
    yield pa.RecordBatch.from_pydict({"docs": [docs], "words": [words]})


class _Shard:
    """Documents on their way to a shard."""

    def __init__(self) -> None:
        self.known: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.postings = 0

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        found = Counter(words)
        self.parts.append((np.fromiter(map(self.known.__getitem__, found), np.int32, len(found)), np.fromiter(found.values(), np.int64, len(found))))
        self.ids.append(doc_id)
        self.sizes.append(len(words))
        self.postings += len(found)

    def row(self, docs: int, words: int) -> pa.RecordBatch:
        """The shard as CSR; the impact of a posting needs the totals of all documents only."""
        vocabulary = sorted(self.known)
        rank = np.empty(len(vocabulary), np.int32)
        rank[[self.known[t] for t in vocabulary]] = np.arange(len(vocabulary), dtype=np.int32)
        of = rank[np.concatenate([p[0] for p in self.parts])]
        tf = np.concatenate([p[1] for p in self.parts])
        at = np.repeat(np.arange(len(self.ids), dtype=np.int32), [len(p[0]) for p in self.parts])
        m = np.array([100 - LENGTH_PERCENT + LENGTH_PERCENT * n * docs // words for n in self.sizes], np.int64)
        impact = IMPACT * tf // (SATURATION * tf + LENGTH_FACTOR * m[at])
        order = np.argsort(of, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(vocabulary)))])
        blob = lambda x, t: [x.astype(t).tobytes()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([self.ids], pa.list_(pa.int64())), pa.array([b"\n".join(vocabulary)], pa.binary()), pa.array(blob(ends, np.int64), pa.binary()),
                pa.array(blob(at[order], np.int32), pa.binary()), pa.array(blob(impact[order], np.int32), pa.binary()),
            ],
            names=["ids", "terms", "ends", "docs", "impacts"],
        )


@dataclass(frozen=True)
class Index:
    """The shards (a table of the shared folder) and the totals that their impacts hold."""

    shards: DataFrame
    docs: int
    words: int


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_postings: int = SHARD_POSTINGS) -> Index:
    """Every row of docs is a document of its own, found under its id (a whole number; ids may
    repeat or be null). Rows without a term (null, empty) are in no shard; very long texts are read
    whole; an empty table gives an index without shards. Other columns of docs are ignored."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sums = rows.mapInArrow(_sizes, "docs long, words long").agg(F.sum("docs"), F.sum("words")).first()
    n_docs, n_words = sums[0] or 0, sums[1] or 0

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for ids, texts in _texts(batches):
            for doc_id, text in zip(ids.to_pylist(), texts):
                if words := terms(text):
                    shard.add(doc_id, words)
                if shard.postings >= shard_postings:
                    yield shard.row(n_docs, n_words)
                    shard = _Shard()
        if shard.postings:
            yield shard.row(n_docs, n_words)
        del shard
        give_back()

    return Index(keep(rows.mapInArrow(build, "ids array<long>, terms binary, ends binary, docs binary, impacts binary"), "postings"), n_docs, n_words)


def _blocks(queries: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """block, ids, texts: the queries in blocks of about block_bytes."""
    rows = queries.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    ids = rows.schema["id"].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, texts, held = [], [], 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([names], pa.list_(kind)), pa.array([texts], pa.list_(pa.string()))], names=["ids", "texts"])
        for b in batches:
            kind = b.column(0).type
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if held and held + len(text) > block_bytes:
                    yield row()
                    names, texts, held = [], [], 0
                names.append(name)
                texts.append(text)
                held += len(text) + 64
        if names:
            yield row()

    # Few partitions first: each block is a pass over the index.
    packed = rows.repartition(max(1, -(-size // block_bytes))).mapInArrow(pack, f"ids array<{ids.simpleString()}>, texts array<string>")
    return keep(packed.select(F.monotonically_increasing_id().alias("block"), "ids", "texts"), "query_blocks")


def _places(vocabulary: list[bytes], wanted: list[bytes]) -> np.ndarray:
    """Where each wanted term stands in a sorted vocabulary, or -1."""
    out = np.full(len(wanted), -1, np.int64)
    for i, t in enumerate(wanted):
        at = bisect_left(vocabulary, t)
        if at < len(vocabulary) and vocabulary[at] == t:
            out[i] = at
    return out


def _frequencies(index: Index, wanted: list[bytes]) -> dict[int, int]:
    """Documents that hold each wanted term (by its place in the list)."""
    sent = index.shards.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(sent.value), np.int64)
        for b in batches:
            for words, ends in zip(b.column(0), b.column(1)):
                at = _places(words.as_py().split(b"\n"), sent.value)
                sizes = np.diff(np.frombuffer(ends.as_buffer(), np.int64))
                found[at >= 0] += sizes[at[at >= 0]]
        hit = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(found[hit])], names=["term", "n"])

    rows = index.shards.select("terms", "ends").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in rows.collect()}  # no more rows than the block has terms


def weight(docs: int, df: int) -> int:
    """The weight of a term that df of docs documents hold."""
    return math.floor(WEIGHT * math.log((2 * docs + 2) / (2 * df + 1)))


def _best(scores: np.ndarray, ids: np.ndarray, null: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores with their ids; among equal ones the smaller ids, null last."""
    if len(scores) > k:
        least = scores[np.argpartition(scores, len(scores) - k)[len(scores) - k]]
        scores, ids, null = (x[at] for at in [scores >= least] for x in (scores, ids, null))  # with all ties
        at = np.lexsort((ids, null, -scores))[:k]
        scores, ids, null = scores[at], ids[at], null[at]
    return scores, ids, null


def _search_block(index: Index, texts: list[str], k: int) -> DataFrame:
    """query (its place in the block), doc_id, score: the k best of every task's shards."""
    counted = [Counter(terms(t)) for t in texts]
    wanted = sorted(set().union(*counted))
    held = _frequencies(index, wanted)
    weights = [weight(index.docs, held[i]) if i in held else 0 for i in range(len(wanted))]
    of = {t: i for i, t in enumerate(wanted)}
    plans = [[(of[t], n * weights[of[t]]) for t, n in c.items() if weights[of[t]] > 0] for c in counted]
    sent = index.shards.sparkSession.sparkContext.broadcast((wanted, plans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, plans = sent.value
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for b in batches:
            for i in range(b.num_rows):
                ids = b.column(0)[i].values
                null = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
                at = _places(b.column(1)[i].as_py().split(b"\n"), wanted).tolist()
                ends = np.frombuffer(b.column(2)[i].as_buffer(), np.int64)
                docs, impacts = (np.frombuffer(b.column(c)[i].as_buffer(), np.int32) for c in (3, 4))
                sums = np.zeros(len(ids), np.int64)
                for q, plan in enumerate(plans):
                    sums[:] = 0
                    for t, w in plan:
                        if at[t] >= 0:
                            here = slice(ends[at[t]], ends[at[t] + 1])
                            sums[docs[here]] += w * impacts[here].astype(np.int64)  # a document once a term
                    hit = np.flatnonzero(sums)
                    if len(hit):
                        found = _best(sums[hit], ids[hit], null[hit], k)
                        best[q] = _best(*map(np.concatenate, zip(best[q], found)), k) if q in best else found
        for q, (scores, ids, null) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q)), pa.array(ids, mask=null), pa.array(scores)], names=["query", "doc_id", "score"])
        best.clear()
        give_back()

    return index.shards.mapInArrow(run, "query long, doc_id long, score long")


def search(index: Index, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id (as id_col has it), rank (from 1), doc_id, score: the k best documents of every query row.

    Only scores above 0 count; equal scores rank by doc_id, null last. A query without terms (null,
    empty) or without hits gives no rows; rows of queries that repeat are answered each; a very long
    query is a block of its own. Other columns of queries are ignored, whatever their names."""
    spark = queries.sparkSession
    blocks = _blocks(queries, id_col, text_col, block_bytes)
    schema = f"item_id {blocks.schema['ids'].dataType.elementType.simpleString()}, rank int, doc_id long, score long"
    path = fresh_path(spark, "ranked")
    spark.createDataFrame([], schema).write.parquet(path)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for block in [r["block"] for r in blocks.select("block").collect()]:
        row = blocks.where(F.col("block") == block).first()
        found = _search_block(index, row["texts"], k).withColumn("part", F.spark_partition_id() % 64)
        for keys in (["query", "part"], ["query"]):
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(row["ids"])), f"query long, item_id {schema.split(',')[0].split(' ', 1)[1]}")
        found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
q AS (SELECT row_number() OVER () AS qn, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
a AS (SELECT count(*)::BIGINT AS n, sum(len(ts))::BIGINT AS l FROM d WHERE len(ts) > 0),
p AS (SELECT rn, doc_id, size, term, count(*)::BIGINT AS tf FROM (SELECT rn, doc_id, len(ts)::BIGINT AS size, unnest(ts) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * max(n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, a GROUP BY term),
s AS (SELECT qn, item_id, rn, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * size * n) // l))))::BIGINT AS score
    FROM q JOIN p USING (term) JOIN w USING (term), a GROUP BY qn, item_id, rn, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT item_id, doc_id, score,
    row_number() OVER (PARTITION BY qn ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
