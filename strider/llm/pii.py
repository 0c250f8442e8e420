"""Personal data and the terms that give it away.

Base spans come from four patterns and their checks. What is found is a protected entity; the
other words of its document are its context. Over the whole corpus, counted in documents, n(t, e),
n(t) and n(e) give the pointwise mutual information of a term and an entity, and its share of the
entity's information content log2(N / n(e)): 1 means that the term alone identifies the entity.
In an entity's documents, terms with a share of REMOVE or more are removed, those from GENERALISE
on are replaced by their general form. A term found with an entity in fewer than SURE documents
counts as if the missing ones held it without the entity: what rarely met says a little less, and
the more documents there are, the less that matters.

DataFrame functions only: the patterns are written possessively, so that no text makes Java's
matcher recurse or try a run of characters again from each of its letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strider.llm.shared import keep, whole

KINDS = ["email", "ip", "card", "phone", "generalise", "remove"]
_LOCAL = r"[A-Za-z0-9._%+-]"
#: The contract's patterns. A run of local-part letters is tried from its start or from where
#: the last match ended (\G), since its other letters can only fail like its first.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_MAY = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
TERM = r"\p{L}++"
#: Fixed parameters of the method: joint documents that need no prior, shares.
SURE, GENERALISE, REMOVE = 3, 0.7, 0.9
_EMPTY = "cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)"


def located(text: str, found: str, pieces: str, kind: int) -> Column:
    """Spans of matches, from them and the pieces of text between them (columns' names)."""
    return F.expr(f"""aggregate(
        zip_with(slice({pieces}, 1, size({found})), {found}, (p, m) -> named_struct('p', length(p), 'm', m)),
        named_struct('at', 0, 'out', {_EMPTY}),
        (acc, x) -> named_struct('at', acc.at + x.p + length(x.m), 'out', concat(acc.out, array(named_struct(
            'start', acc.at + x.p, 'kind', {kind}, 'end', acc.at + x.p + length(x.m), 'value', x.m)))),
        acc -> acc.out)""")


def _valid(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(
            F.split(v, r"\."), lambda p: F.coalesce(F.concat(F.lit("0"), F.right(p, F.lit(3))).try_cast("int"), F.lit(256)) <= 255
        )
    if kind == "phone":
        return F.length(digits).between(9, 15)
    back = F.reverse(digits)
    doubled = lambda i: F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    luhn = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + doubled(i) - F.when(doubled(i) > 9, 9).otherwise(0))
    return F.when(F.length(digits).between(12, 19), luhn % 10 == 0).otherwise(False)


def _check(kind: str):
    return lambda s: _valid(kind, s["value"])


def _of_kind(i: int):
    return lambda s: s["kind"] == i


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (hash of the text), text, base: array of (start, kind, end, value), sorted."""
    out = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    out = out.select("doc_id", "h", "text", *[F.when(F.col("text").rlike(_MAY[k]), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)")).alias(f"m_{k}") for k, p in PATTERNS.items()])
    out = out.select("*", *[F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).alias(f"p_{k}") for k, p in PATTERNS.items()])
    spans = [F.when(F.size(f"m_{k}") > 0, F.filter(located("text", f"m_{k}", f"p_{k}", i), _check(k))).otherwise(F.expr(_EMPTY)) for i, k in enumerate(PATTERNS)]
    return out.select("doc_id", "h", "text", F.array_sort(F.concat(*spans)).alias("base"))


def entity(kind: Column, value: Column) -> Column:
    """Entities are equal by kind and by value without case, or by digits."""
    return F.concat(kind.cast("string"), F.lit(":"), F.when(kind <= 1, F.lower(value)).otherwise(F.regexp_replace(value, "[^0-9]", "")))


def contexts(spans: DataFrame) -> DataFrame:
    """doc_id, h, times, entities (distinct), term, start, end: every word outside the base spans of a
    document that has some. Rows that repeat stand once, with how often they do."""
    rows = spans.where(F.size("base") > 0).groupBy("doc_id", "h").agg(F.first("text").alias("text"), F.first("base").alias("base"), F.count(F.lit(1)).alias("times"))
    entities = F.array_distinct(F.transform("base", lambda s: entity(s["kind"], s["value"])))
    rows = rows.select("doc_id", "h", "times", "base", entities.alias("entities"), F.regexp_extract_all("text", F.lit(TERM), F.lit(0)).alias("m"), F.split("text", TERM, -1).alias("p"))
    rows = rows.select("doc_id", "h", "times", "base", "entities", F.posexplode(F.arrays_zip(F.slice("p", 1, F.size("m")).alias("p"), F.col("m").alias("m"))).alias("i", "x"))
    # Sums over the pieces before a word say where it stands, in linear time.
    end = F.sum(F.length("x.p") + F.length("x.m")).over(Window.partitionBy("doc_id", "h").orderBy("i")).cast("int")
    rows = rows.select("doc_id", "h", "times", "base", "entities", F.lower("x.m").alias("term"), end.alias("end"), F.length("x.m").alias("n"))
    rows = rows.select("doc_id", "h", "times", "base", "entities", "term", (F.col("end") - F.col("n")).alias("start"), "end")
    inside = F.exists("base", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]))
    return rows.where(~inside).drop("base")


def disclosure(docs: DataFrame, near: DataFrame, text_col: str = "text", sure: int = SURE) -> DataFrame:
    """entity, term, share: how much of each entity's information each of its terms gives.

    All counts are of rows, over the whole corpus: rows that repeat count each, everywhere."""
    met = near.select("doc_id", "h", "times", "entities", "term").distinct().select(F.explode("entities").alias("entity"), "term", "times")
    pairs = keep(met.groupBy("entity", "term").agg(F.sum("times").alias("n_te")), "term_entity")
    entities = near.select("doc_id", "h", "times", "entities").distinct().select(F.explode("entities").alias("entity"), "times").groupBy("entity").agg(F.sum("times").alias("n_e"))
    wanted = pairs.select("term").distinct()
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(whole(text_col)), F.lit(TERM), F.lit(0)))).alias("term"))
    terms = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).join(wanted, "term")
    n = max(1, docs.count())
    counted = pairs.join(entities, "entity").join(terms, "term")
    n_t = F.col("n_t") + F.greatest(F.lit(sure) - F.col("n_te"), F.lit(0))
    pmi = F.log2(F.col("n_te") * F.lit(float(n)) / (n_t * F.col("n_e").cast("double")))
    content = F.log2(F.lit(float(n)) / F.col("n_e"))
    # An entity of every document has no information to give away.
    return counted.select("entity", "term", F.when(content > 0, F.least(pmi / content, F.lit(1.0))).otherwise(0.0).alias("share"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE, remove: float = REMOVE, sure: int = SURE) -> DataFrame:
    """doc_id, h, base, spans for every row of docs; spans are base and the disclosing terms.

    Null counts as empty and has no spans. Rows that repeat an id and text get the same spans;
    each counts as a document of its own. Other columns of docs are ignored.
    """
    # The texts stay behind; only spans and the words around them are kept.
    spans = base_spans(docs, id_col, text_col)
    near = keep(contexts(spans), "contexts")
    shares = disclosure(docs, near, text_col, sure).where(F.col("share") >= generalise)
    action = F.when(F.col("share") >= remove, KINDS.index("remove")).otherwise(KINDS.index("generalise"))
    told = near.select("doc_id", "h", "entities").distinct().select("doc_id", "h", F.explode("entities").alias("entity"))
    told = told.join(shares.select("entity", "term", action.alias("kind")), "entity").groupBy("doc_id", "h", "term").agg(F.max("kind").alias("kind"))
    told = told.withColumnsRenamed({"doc_id": "_id", "h": "_h", "term": "_term"})
    terms = near.drop("entities", "times").join(told, near["doc_id"].eqNullSafe(told["_id"]) & (near["h"] == told["_h"]) & (near["term"] == told["_term"]))
    terms = terms.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "kind", "end", F.lit("").alias("value"))).alias("terms"))
    base = spans.drop("text")
    terms = terms.withColumnsRenamed({"doc_id": "_id", "h": "_h"})
    out = base.join(terms, base["doc_id"].eqNullSafe(terms["_id"]) & (base["h"] == terms["_h"]), "left")
    return out.select("doc_id", "h", "base", F.array_sort(F.concat("base", F.coalesce("terms", F.expr(_EMPTY)))).alias("spans"))


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))))


def report(found: DataFrame) -> DataFrame:
    """The digest columns of the contract."""
    counts = [F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def sanitise(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sanitised_text: each span replaced by its kind, general terms by their length,
    removed terms by nothing; overlapping spans go together, under the first one's kind."""
    rows = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text"))
    spans = found.select("doc_id", "h", "spans").distinct()
    both = rows.join(spans, rows["_id"].eqNullSafe(spans["doc_id"]) & (F.xxhash64("_text") == spans["h"]))
    return both.select("doc_id", F.expr("""aggregate(spans, named_struct('at', 0, 'out', ''),
        (acc, s) -> if(s.start < acc.at, named_struct('at', greatest(acc.at, s.end), 'out', acc.out), named_struct('at', s.end, 'out',
            concat(acc.out, substring(_text, acc.at + 1, s.start - acc.at),
                case s.kind when 5 then '' when 4 then concat('[word of ', s.end - s.start, ']') else concat('[', element_at(array('email', 'ip', 'card', 'phone'), s.kind + 1), ']') end))),
        acc -> concat(acc.out, substring(_text, acc.at + 1)))""").alias("sanitised_text"))
