"""Near-duplicate groups by b-bit MinHash.

1. A scan hashes every document's distinct word shingles. It keeps the set's size, a hash of the
   whole set, the low B_BITS of PERMUTATIONS minima, packed, and a key per band of minima.
2. Documents with the same set (128 bits of its hash) are one class from here on, whatever their number.
3. Classes that share a band key are candidates. A bucket first offers only stars: each member
   against one pivot, another pivot in each round. Confirmed links merge classes, and a bucket
   whose members are all in one component offers nothing more, so a large group of near copies
   costs a few pairs a member. What stars leave apart is then paired across components, but for
   pairs whose private shingles rule a link out: no link is lost, and no bucket is capped.
4. A pair passes if the sizes allow it, if the similarity estimated from the packed bits
   (corrected for chance collisions) is not far under the threshold, and if the full sets confirm it.

Bands are chosen so that a pair at the threshold misses all of them with a chance of 1e-6 at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strider.llm.components import connected
from strider.llm.line_index import mix
from strider.llm.shared import BROADCAST_IDS, give_back, keep, once, text_key, without

PERMUTATIONS, B_BITS = 192, 2
STAR_ROUNDS = 3
#: Estimates this far under the threshold (over six standard errors) are not checked in full.
MARGIN = 0.2
_CACHE = 150_000
_rng = np.random.default_rng(20_240_229)
_A = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_C = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_rows(threshold: float, miss: float = 1e-6) -> int:
    """The most rows a band may have so that pairs at the threshold are missed by chance `miss` at most."""
    return max(r for r in range(1, 33) if r == 1 or (1 - threshold**r) ** (PERMUTATIONS // r) <= miss)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def shingles(text: str | None, k: int, memory: _Words) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; with fewer words, of the whole sequence."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    if len(memory) > _CACHE:
        memory.clear()
    h = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
    n = min(k, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        out += h[j : len(h) - n + 1 + j] * _C[j]
    return np.unique(mix(out, n))


def minima(found: np.ndarray) -> np.ndarray:
    low = np.full(PERMUTATIONS, 2**64 - 1, np.uint64)
    for i in range(0, len(found), 1024):  # bounded memory for very long texts
        np.minimum(low, (found[i : i + 1024, None] * _A + _B).min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray, rows: int) -> np.ndarray:
    bands = len(low) // rows
    parts = mix(low[: bands * rows], 3).reshape(bands, rows) * _C[:rows]
    return mix(parts.sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * _C[40], 4)


def packed_bits(low: np.ndarray) -> np.ndarray:
    """The lowest B_BITS of each (mixed) minimum, 64 // B_BITS of them in a word."""
    each = 64 // B_BITS
    bits = (mix(low, 5) & np.uint64((1 << B_BITS) - 1)).reshape(-1, each)
    return np.bitwise_or.reduce(bits << (np.arange(each, dtype=np.uint64) * np.uint64(B_BITS)), axis=1)


def _signatures(k: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Words()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                ns, nodes, bits, bands = [], [], [], []
                for text in part.column(1).to_pylist():
                    found = shingles(text, k, memory)
                    ns.append(len(found))
                    nodes.append(xxhash.xxh3_128_digest(found.tobytes()))
                    low = minima(found)
                    bits.append(packed_bits(low).view(np.int64) if len(found) else None)
                    bands.append(band_keys(low, rows).view(np.int64) if len(found) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(ns, pa.int64()), pa.array(nodes, pa.binary()), pa.array(bits, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "h", "n", "node", "bits", "bands"],
                )
        memory.clear()
        give_back()

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Words()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                nodes, sets = [], []
                for text in b.slice(i, 256).column(0).to_pylist():
                    found = shingles(text, k, memory)
                    nodes.append(xxhash.xxh3_128_digest(found.tobytes()))
                    sets.append(found.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])
        memory.clear()
        give_back()

    return run


def estimate(x: Column, y: Column) -> Column:
    """Similarity from packed bits: the share of equal b-bit groups, less what chance gives."""
    mask = F.lit(0x5555555555555555)  # one bit of each two

    def unequal(p: Column, q: Column) -> Column:
        d = p.bitwiseXOR(q)
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(mask))

    differ = F.aggregate(F.zip_with(x, y, unequal), F.lit(0), lambda s, v: s + v)
    chance = 1 / (1 << B_BITS)
    return (1 - differ / F.lit(PERMUTATIONS) - chance) / (1 - chance)


def _confirmed(pairs: DataFrame, sides: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of candidate pairs (a, b) those with den * intersection >= num * union."""
    p, q = (sides.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")) for c in "ab")
    near = pairs.join(p, "a").join(q, "b").where((F.least("na", "nb") * den >= F.greatest("na", "nb") * num) & (estimate(F.col("bitsa"), F.col("bitsb")) >= num / den - MARGIN))
    x, y = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    full = near.select("a", "b").join(x, "a").join(y, "b").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb") - both).alias("any"))
    return full.where(F.col("both") * den >= F.col("any") * num).select("a", "b")


def _across(left: DataFrame, sides: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (u, v) of unlike labels in a bucket, but for those that two exact bounds rule out.

    A shingle that only one of these nodes holds is in no intersection with another, so a pair
    shares at most the smaller count of other shingles. And nodes with the same reference share
    at most the smaller part that either has of it, and what they share besides. Neither bound
    drops a link; what passes is counted in full later."""
    nodes = left.select("node").distinct()
    held = sets.join(nodes, "node").select("node", F.explode("shingles").alias("s"))
    alone = held.groupBy("s").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("node")).where("k = 1")
    private = alone.groupBy("node").agg(F.count(F.lit(1)).alias("private"))
    known = sides.select("node", "n").join(nodes, "node").join(private, "node", "left").select("node", "n", (F.col("n") - F.coalesce("private", F.lit(0))).alias("open"))
    known = keep(known.where(F.col("open") * den >= F.col("n") * num), "open_nodes")

    # What a node has in common with the most central mate of its buckets, and what besides.
    left = left.join(known, "node")
    top = left.groupBy("band").agg(F.max(F.struct("mates", "node")).alias("top"))
    refs = left.join(top, "band").groupBy("node").agg(F.max("top").alias("top")).select("node", F.col("top.node").alias("ref"))
    own, other = sets.withColumnRenamed("shingles", "x"), sets.select(F.col("node").alias("ref"), F.col("shingles").alias("y"))
    both = refs.join(own, "node").join(other, "ref").select("node", "ref", F.size("x").alias("n"), F.array_intersect("x", "y").alias("common"), F.array_except("x", "y").alias("rest"))
    near = F.size("common") * 2 >= F.col("n")  # else the rest is long and rules little out
    refs = keep(both.select("node", F.when(near, F.col("ref")).alias("ref"), F.size("common").alias("w"), F.when(near, F.col("rest")).alias("rest")), "references")

    p = left.join(refs, "node").select("band", F.col("node").alias("u"), F.col("label").alias("lu"), F.col("n").alias("nu"), F.col("open").alias("ou"), F.col("ref").alias("ru"), F.col("w").alias("wu"), F.col("rest").alias("eu"))
    q = p.select("band", *[F.col(c).alias(f"{c[0]}_v") for c in ("u", "lu", "nu", "ou", "ru", "wu", "eu")])
    need = (F.col("nu") + F.col("n_v")) * num  # least intersection, times (num + den)
    shared = F.least("ou", "o_v") * (num + den) >= need
    with_ref = (F.least("wu", "w_v") + F.size(F.array_intersect("eu", "e_v"))) * (num + den) >= need
    possible = (F.col("lu") < F.col("l_v")) & shared & F.when(F.col("ru") == F.col("r_v"), with_ref).otherwise(True)
    return p.join(q, (p["band"] == q["band"]) & possible).select("u", F.col("u_v").alias("v"))


def _grouped(docs: DataFrame, words: int = 3, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """near_groups with each row's text_key as h."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_key(text_col).alias("h"))
    r = band_rows(num / den)
    signed = keep(rows.mapInArrow(_signatures(words, r), "doc_id long, h long, n long, node binary, bits array<long>, bands array<long>"), "signatures")
    classes = signed.where("n > 0").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("first"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("bands").alias("bands"))
    classes = keep(classes, "classes")

    banded = classes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = keep(banded.join(shared, "band"), "shared_bands")
    # Nodes with many bucket mates are near the middle of their group: the first pivots.
    mates = buckets.groupBy("node").agg(F.sum("members").alias("mates"))
    buckets = keep(buckets.drop("members").join(mates, "node").select("node", "band", "mates"), "buckets")
    sides = keep(classes.join(buckets.select("node").distinct(), "node").select("node", F.col("first.doc_id").alias("first"), "n", "bits"), "candidates")

    wanted = sides.select(F.col("first").alias("_want")).distinct()
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = rows.join(wanted, rows["doc_id"].eqNullSafe(F.col("_want"))).select("text")
    sets = keep(texts.mapInArrow(_sets(words), "node binary, shingles array<long>").dropDuplicates(["node"]), "shingle_sets")

    links, labels, tested = None, None, None
    for turn in range(STAR_ROUNDS + 1):
        members = buckets.withColumn("label", F.col("node"))
        if labels is not None:
            members = buckets.join(labels, "node", "left").select("node", "band", "mates", F.coalesce("label", "node").alias("label"))
        # Another pivot in each turn: the other turns' halves of the nodes come last.
        order = F.struct((F.pmod(F.xxhash64("node"), F.lit(2)) + turn == 2).alias("last"), (-F.col("mates")).alias("m"), F.xxhash64("node", F.lit(turn)).alias("h"), "node", "label")
        apart = members.groupBy("band").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.min(order).alias("p")).where("l0 <> l1")
        if turn < STAR_ROUNDS:
            offered = members.join(apart.select("band", F.col("p.node").alias("pivot"), F.col("p.label").alias("pl")), "band").where("label <> pl").select(F.col("pivot").alias("u"), F.col("node").alias("v"))
        else:
            left = keep(members.join(apart.select("band"), "band"), "open_buckets")
            offered = _across(left, sides, sets, num, den)
        pairs = offered.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = keep(pairs, "pairs")
        if pairs.isEmpty():
            # A pivot may come back with all its pairs tested; the exact round comes all the same.
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        new = keep(_confirmed(pairs, sides, sets, num, den), "links")
        if new.isEmpty():
            continue
        links = new if labels is None else new.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).where("a <> b"))
        labels = connected(links)

    named = classes.select("node", "first")
    if labels is None:
        named = named.withColumn("least", F.col("first"))
    else:
        known = labels.join(named, "node")
        least = known.groupBy("label").agg(F.min("first").alias("least"))
        named = named.join(known.select("node", "label").join(least, "label").select("node", "least"), "node", "left").select("node", F.coalesce("least", "first").alias("least"))
    # A class of its own keeps each row's id; `named` has a row per distinct set.
    some, none = signed.where("n > 0").select("doc_id", "h", "n", "node"), signed.where("n = 0")
    out = some.join(named.select("node", "least"), "node").select("doc_id", "h", "n", F.col("least.doc_id").alias("component_id"), F.struct("doc_id", "h").eqNullSafe(F.struct("least.doc_id", "least.h")).alias("kept"))
    out = out.unionByName(none.select("doc_id", "h", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))
    return out.select("doc_id", "h", F.col("n").alias("n_shingles"), "component_id", "kept")


def near_groups(docs: DataFrame, words: int = 3, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Documents are linked when den * |A and B| >= num * |A or B| over their shingle sets;
    component_id is the smallest id reachable. Null and empty texts and texts without words have
    an empty set and are linked with nothing. Of rows that share an id the one whose text has the
    least hash stays; rows that repeat both carry the same decision. Null ids take part in links
    but never name a component (null if nothing else does). Very long texts are shingled whole;
    an empty table gives no rows. Other columns of docs are ignored, whatever their names.
    """
    return _grouped(docs, words, num, den, id_col, text_col).drop("h")


def drop_near_copies(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group, in docs' own columns. Rows without words are in no group;
    those, too, stand once where they repeat both id and text."""
    gone = _grouped(docs, words, num, den, id_col, text_col).where(~F.col("kept")).select("doc_id", "h")
    return once(without(docs, gone, id_col, text_col), id_col, text_col)
