"""Benchmark decontamination by winnowing.

A text's k-grams of words are hashed (k = KGRAM); of every WINDOW - KGRAM + 1 neighbouring hashes
the smallest is kept, once for a run of windows that keep the same. Two equal windows keep equal
k-grams, so every shared span of WINDOW words or more shares a fingerprint. Documents' fingerprints
meet those of the benchmark's windows; each hit is then extended to the whole window, word by word. Items shorter
than a window are one window of their own length, winnowed in the same way.

The documents' side is never shuffled where the benchmark's windows can be broadcast (their size
is counted first; beyond it, a shuffle join of fingerprints does the same). DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strider.llm.shared import BROADCAST_BYTES, ascii_lower, keep, text_key, whole, without

WINDOW, KGRAM, PLACE = 13, 8, 6
#: Fixed: what separates words, once A-Z are lowered.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), NOT_WORD), "")


def _shifted(name: str, by: int) -> Column:
    return F.slice(name, by + 1, F.size(name)) if by else F.col(name)


def _spread(df: DataFrame, first: str, stem: str, most: int, both) -> DataFrame:
    """df with stem2, stem4, ... up to `most`: element i combines elements i to i + 1, i + 3, ... of
    first. Each is a column of its own, so that it is worked out once."""
    p, name = 1, first
    while 2 * p <= most:
        df = df.withColumn(f"{stem}{2 * p}", F.zip_with(name, _shifted(name, p), both))
        p, name = 2 * p, f"{stem}{2 * p}"
    return df


def _over(first: str, stem: str, n: int, both) -> Column:
    """The combination of n neighbours, from the largest power of two that two of them cover."""
    p = 1 << n.bit_length() - 1
    name = first if p == 1 else f"{stem}{p}"
    return F.col(name) if p == n else F.zip_with(name, _shifted(name, n - p), both)


def _hash(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def _lesser(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _gram_size(n: int) -> int:
    return min(KGRAM, n)


def _hashed(texts: DataFrame, lengths: list[int], *columns: str) -> DataFrame:
    """columns, words, and the hashes of their 1, 2, 4, ... grams."""
    out = texts.select(*columns, "words", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    return _spread(out, "h", "h", max(map(_gram_size, lengths)), _hash)


def _grams(n: int) -> Column:
    """The hashes of the k-grams for windows of n words, in order."""
    return F.slice(_over("h", "h", _gram_size(n), _hash), 1, F.greatest(F.size("words") - (_gram_size(n) - 1), F.lit(0)))


def _clear(g: Column) -> Column:
    return g.bitwiseAND(F.lit(-1 << PLACE))


def grams(texts: DataFrame, lengths: list[int], *columns: str) -> DataFrame:
    """columns, words and, for windows of each of some lengths n, g<n>: the hashes of the k-grams,
    in order, with the PLACE lowest bits clear."""
    return _hashed(texts, lengths, *columns).select(*columns, "words", *[F.transform(_grams(n), _clear).alias(f"g{n}") for n in lengths])


def fingerprints(texts: DataFrame, lengths: list[int], *columns: str) -> DataFrame:
    """columns, prints: of texts with words, the winnowed k-grams for windows of each of some
    lengths, as (length, fp, at, near): near are the words that a window around it may hold."""
    # A gram's place, modulo 64, in the lowest bits tells the minimum's place from the minimum.
    placed = lambda g, i: _clear(g).bitwiseOR(i.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("long"))
    out = _hashed(texts, lengths, *columns).select(*columns, "words", *[F.transform(_grams(n), placed).alias(f"v{n}") for n in lengths])
    for n in lengths:
        of = n - _gram_size(n) + 1
        out = _spread(out, f"v{n}", f"v{n}_", of, _lesser)
        out = out.withColumn(f"m{n}", F.slice(_over(f"v{n}", f"v{n}_", of, _lesser), 1, F.greatest(F.size("words") - (n - 1), F.lit(0))))
    return out.select(*columns, F.concat(*[_prints(n) for n in lengths]).alias("prints"))


def _prints(n: int) -> Column:
    m, back, last = f"m{n}", n - _gram_size(n), (1 << PLACE) - 1
    # Neighbouring windows often keep the same gram: it counts once.
    new = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: (i == 0) | (F.get(m, i) != F.get(m, i - 1)))
    at = lambda i: i + F.pmod(F.get(m, i).bitwiseAND(F.lit(last)).cast("int") - i, F.lit(1 << PLACE))
    return F.when(F.size(m) > 0, F.transform(F.transform(new, lambda i: F.struct(i.alias("i"), at(i).alias("at"))), lambda x: F.struct(
        F.lit(n).alias("length"), _clear(F.get(m, x["i"])).alias("fp"), x["at"].alias("at"), F.array(*[F.get("words", x["at"] + j) for j in range(-back, n)]).alias("near")
    ))).otherwise(F.expr("cast(array() as array<struct<length:int,fp:bigint,at:int,near:array<string>>>)"))


def item_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """length, fp, back, window, items: each distinct window of words of the items, its least k-gram,
    how far that lies from its start, and the items that have it. A window whose least k-gram
    stands at several places has a row for each: any of them may be a document's fingerprint."""
    texts = benchmark.select(F.col(item_col).alias("item_id"), words(whole(text_col)).alias("words")).where(F.size("words") > 0)
    texts = texts.withColumn("length", F.least(F.size("words"), F.lit(WINDOW)))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)
    each = texts.select("item_id", "length", "words", F.explode(starts).alias("s")).select("item_id", "length", F.slice("words", F.col("s"), F.col("length")).alias("words"))
    each = keep(each.groupBy("length", "words").agg(F.sort_array(F.collect_set("item_id")).alias("items")), "windows")
    lengths = sorted(r[0] for r in each.select("length").distinct().collect()) or [WINDOW]  # WINDOW values at most
    own = F.coalesce(*[F.when(F.col("length") == n, F.col(f"g{n}")) for n in lengths])
    found = grams(each, lengths, "length", "items").select("length", "items", F.col("words").alias("window"), own.alias("g")).withColumn("fp", F.array_min("g"))
    return found.select("length", "fp", "window", "items", F.posexplode("g").alias("back", "x")).where("x = fp").drop("x")


def hits(docs: DataFrame, index: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, _h (text_key), at, length, items: the documents' windows that are windows of items."""
    index = keep(index, "item_windows")
    bytes_of = F.lit(64) + F.aggregate("window", F.lit(0), lambda n, w: n + 16 + F.octet_length(w)) + 16 * F.size("items")
    size = index.agg(F.sum(bytes_of)).first()[0] or 0
    lengths = sorted(r[0] for r in index.select("length").distinct().collect()) or [WINDOW]
    texts = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("_h"), words(whole(text_col)).alias("words"))
    # An outer explode: for an inner one the optimiser would filter by the prints, and to do so
    # work them out a second time.
    prints = fingerprints(texts, lengths, "doc_id", "_h").select("doc_id", "_h", F.explode_outer("prints").alias("x"))
    side = index.withColumnRenamed("fp", "_fp").withColumnRenamed("length", "_n")
    first = F.col("_n") - F.least(F.col("_n"), F.lit(KGRAM)) - F.col("back")  # the window's start in `near`
    met = (F.col("x.fp") == F.col("_fp")) & (F.col("x.length") == F.col("_n")) & (F.slice("x.near", first + 1, F.col("_n")) == F.col("window"))
    found = prints.join(F.broadcast(side) if size <= BROADCAST_BYTES else side, met)
    return found.select("doc_id", "_h", (F.col("x.at") - F.col("back")).alias("at"), F.col("_n").alias("length"), "items")


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """doc_id, _h (text_key), n_words, n_hit, n_items, items, contaminated for every row of docs.

    A null text has no words; documents and items without words match nothing. Repeated
    documents each get their row; repeated items count once by id. Very long texts are winnowed
    whole. An empty benchmark leaves every document clean, an empty docs gives no rows. Other
    columns of both are ignored, whatever their names.
    """
    found = hits(docs, item_windows(benchmark, item_col, item_text_col), id_col, text_col)
    # Equal (id, text) rows have equal hits, so distinct word positions are right for repeats too.
    spans = found.groupBy("doc_id", "_h").agg(
        F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("at"), F.col("at") + F.col("length") - 1)))).alias("at"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_hh"), F.size("at").cast("long").alias("n_hit"), "items")
    every = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("_h"), F.size(words(whole(text_col))).cast("long").alias("n_words"))
    out = every.join(spans, every["doc_id"].eqNullSafe(spans["_id"]) & (every["_h"] == spans["_hh"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.filter(F.array(F.lit(None).cast(benchmark.schema[item_col].dataType)), lambda x: F.lit(False)))
    return out.select(
        "doc_id",
        "_h",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        items.alias("items"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def report(found: DataFrame) -> DataFrame:
    """The digest columns of the contract."""
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without contaminated rows, in docs' own columns. A row goes by its id and text: rows
    that repeat both go together, another text of the same id is judged by itself."""
    gone = contamination(docs, benchmark, id_col, text_col).where("contaminated").select("doc_id", "_h")
    return without(docs, gone, id_col, text_col)


SQL = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hw.n_hit, 0) AS n_hit, coalesce(hi.n_items, 0) AS n_items,
    sha256(coalesce(hi.s, '')) AS items_sha256, coalesce(hw.n_hit, 0) > 0 AND 20 * coalesce(hw.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
