"""Drops lines that many documents share.

1. A scan counts, per line hash, the documents that hold it (each batch pre-aggregates).
2. Hashes found in `index_from` documents or more are dealt into shards; each becomes a minimal
   perfect hash with fingerprint and count arrays (line_index). A line that is in no shard was
   found once, so absence is an answer too.
3. Documents probe the arrays. Up to BROADCAST_BYTES (summed before anything is sent) every task
   holds all shards. Beyond that, packed probes of each batch travel to their shard, one shard in
   memory at a time, and only the hashes that reach the threshold travel back.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strider.llm.line_index import Shard, mix
from strider.llm.shared import BROADCAST_BYTES, keep

SHARD_KEYS = 1 << 18


def line_keys(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text (null or empty: one empty line) and their keys, in UTF-8."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    return lines, [x.strip().lower() for x in lines]  # bytes: ASCII white space and A-Z only


def _digests(keys: list[bytes]) -> np.ndarray:
    """(n, 2) of uint64, hi and lo."""
    h = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([h(k) for k in keys]), ">u8").reshape(-1, 2).astype(np.uint64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    h = xxhash.xxh3_128_digest
    for b in batches:
        found: Counter[bytes] = Counter()
        for text in b.column(0):
            found.update({h(k) for k in line_keys(text.as_py())[1] if k})
        pairs = np.frombuffer(b"".join(found), ">u8").reshape(-1, 2).astype(np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.fromiter(found.values(), np.int64, len(found)))], names=["hi", "lo", "n"]
        )


def line_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """hi, lo, n: in how many documents (rows) each non-empty line key is found."""
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(_count, "hi long, lo long, n long")
    return rows.groupBy("hi", "lo").agg(F.sum("n").alias("n"))


def _shard_of(hi, shards: int):
    return (mix(np.asarray(hi).view(np.uint64), 101) % np.uint64(shards)).astype(np.int32)


def build_index(counts: DataFrame, index_from: int = 2, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """shard, shards, entries, blob for the keys found in index_from documents or more."""
    common = keep(counts.where(F.col("n") >= index_from), "common_lines")
    shards = max(1, -(-common.count() // shard_keys))

    def shard_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p.assign(shard=_shard_of(p["hi"].to_numpy(), shards))

    def build(p: pd.DataFrame) -> pd.DataFrame:
        hi, lo = p["hi"].to_numpy().view(np.uint64), p["lo"].to_numpy().view(np.uint64)
        blob = Shard.build(hi ^ mix(lo, 7), lo, p["n"].to_numpy()).to_bytes()
        return pd.DataFrame({"shard": [int(p["shard"].iloc[0])], "shards": [shards], "entries": [len(p)], "blob": [blob]})

    dealt = common.mapInPandas(shard_rows, "hi long, lo long, n long, shard int")
    return keep(dealt.groupBy("shard").applyInPandas(build, "shard int, shards int, entries long, blob binary"), "line_index")


def _probe(shards: dict[int, Shard], n_shards: int, pairs: np.ndarray) -> np.ndarray:
    out = np.ones(len(pairs), np.int64)  # absent: found once at most
    of = _shard_of(pairs[:, 0].copy(), n_shards)
    for s, shard in shards.items():
        at = np.flatnonzero(of == s)
        if len(at):
            hi, lo = pairs[at, 0], pairs[at, 1]
            out[at] = np.maximum(1, shard.counts_of(hi ^ mix(lo, 7), lo))
    return out


def _strip(texts: list[str | None], common) -> Iterator[tuple[int, int, str]]:
    """(lines, dropped lines, kept text) of each text; common(pairs) says which keys go."""
    split = [line_keys(t) for t in texts]
    flat = [k for _, keys in split for k in keys]
    drop = common(_digests(flat)) & np.fromiter((bool(k) for k in flat), bool, len(flat))
    at = 0
    for lines, keys in split:
        gone = drop[at : at + len(keys)]
        at += len(keys)
        n = int(gone.sum())
        stay = [x for x, g in zip(lines, gone) if not g] if n else lines
        yield len(lines), n, b"\n".join(stay).decode("utf-8", "surrogatepass")


_OUT = "doc_id long, n_lines long, n_dropped long, kept_text string"


def _batch(ids: pa.Array, rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    n, d, t = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(t, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_text"])


def _slices(b: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for i in range(0, b.num_rows, rows):
        yield b.slice(i, rows)


def _by_broadcast(docs: DataFrame, index: DataFrame, min_docs: int) -> DataFrame:
    blobs = docs.sparkSession.sparkContext.broadcast([(r["shard"], r["shards"], bytes(r["blob"])) for r in index.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = {s: Shard.from_bytes(x) for s, _, x in blobs.value}
        n = next((n for _, n, _ in blobs.value), 1)
        common = lambda pairs: _probe(shards, n, pairs) >= min_docs
        for b in batches:
            for part in _slices(b):
                yield _batch(part.column(0), list(_strip(part.column(1).to_pylist(), common)))

    return docs.mapInArrow(run, _OUT)


def _by_routing(docs: DataFrame, index: DataFrame, min_docs: int) -> DataFrame:
    """The same answer where the arrays are too large for each task."""
    n = (index.agg(F.max("shards")).first()[0]) or 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b):
                ids, pairs = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    d = _digests(list({k for k in line_keys(text)[1] if k}))
                    pairs.append(d)
                    ids.append(np.full(len(d), i))
                pairs, ids = np.concatenate(pairs), np.concatenate(ids)
                of = _shard_of(pairs[:, 0].copy(), n)
                for s in np.unique(of):
                    at = np.flatnonzero(of == s)
                    yield pa.RecordBatch.from_pylist([{"shard": int(s), "is_index": False, "doc": part.column(0).to_numpy(zero_copy_only=False)[ids[at]].astype(np.int64).tobytes(), "hash": part.column(2).to_numpy()[ids[at]].astype(np.int64).tobytes(), "blob": pairs[at].tobytes()}], schema=_PACKED)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, shard = None, None
        for b in batches:
            for r in b.to_pylist():
                if r["is_index"]:  # sorted first in its shard
                    here, shard = r["shard"], Shard.from_bytes(r["blob"])
                elif r["shard"] == here:
                    pairs = np.frombuffer(r["blob"], np.uint64).reshape(-1, 2)
                    hi, lo = pairs[:, 0], pairs[:, 1]
                    hit = shard.counts_of(hi ^ mix(lo, 7), lo) >= min_docs
                    doc, text = np.frombuffer(r["doc"], np.int64)[hit], np.frombuffer(r["hash"], np.int64)[hit]
                    keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), int(hit.sum()), [None, pa.py_buffer(pairs[hit].tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(text), keys.cast(pa.binary())], names=["_id", "_h", "key"])

    packed = docs.mapInArrow(pack, "shard int, is_index boolean, doc binary, hash binary, blob binary")
    rows = packed.unionByName(index.select("shard", F.lit(True).alias("is_index"), F.lit(b"").alias("doc"), F.lit(b"").alias("hash"), "blob"))
    rows = rows.repartition("shard").sortWithinPartitions("shard", F.desc("is_index"))
    found = rows.mapInArrow(probe, "_id long, _h long, key binary").groupBy("_id", "_h").agg(F.collect_set("key").alias("gone"))
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]) & (docs["_text_hash"] == found["_h"]), "left").select("doc_id", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b):
                rows = []
                for text, gone in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    gone = {bytes(k) for k in gone or []}
                    rows += _strip([text], lambda pairs, gone=gone: np.fromiter((p.tobytes() in gone for p in pairs), bool, len(pairs)))
                yield _batch(part.column(0), rows)

    return joined.mapInArrow(run, _OUT)


def drop_common_lines(
    docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text", index_from: int = 2, broadcast_bytes: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS
) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for every row of docs.

    A line goes, wherever it stands, when its key (stripped of ASCII white space, A-Z lowered) is
    not empty and at least min_docs rows hold it. Null and empty texts are one empty line. Rows
    that repeat count as documents of their own; very long texts are read whole; an empty table
    gives no rows. Other columns of docs are ignored, whatever their names.
    """
    index = build_index(line_counts(docs, text_col), min(index_from, min_docs), shard_keys)
    size = index.agg(F.sum(F.length("blob"))).first()[0] or 0
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if size <= broadcast_bytes:
        return _by_broadcast(rows, index, min_docs)
    return _by_routing(rows.withColumn("_text_hash", F.xxhash64("text")), index, min_docs)


_PACKED = pa.schema([("shard", pa.int32()), ("is_index", pa.bool_()), ("doc", pa.binary()), ("hash", pa.binary()), ("blob", pa.binary())])

SQL = r"""
WITH l AS (SELECT rn, doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM (SELECT rn, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT row_number() OVER () AS rn, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
c AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT rn) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.k IS NOT NULL) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN c ON l.k = c.k GROUP BY rn, doc_id
"""
