"""Secret scans whose false positives a random forest removes.

Candidates are runs of token letters with a digit and enough length, provider formats, and
whatever is assigned to a secret's name, of any length and letters. Each gets features: length,
entropy, how usual its character transitions are, how much of it dictionary words cover (both
from the words of the whole corpus), where it stands in a path or URL, its document's source and
the words beside it. The forest (pyspark.ml) learns from labelled findings; find() takes them
as a table, and seed_findings() makes one from candidates whose label needs no model: provider
formats and assignments to a secret's name on one side, numbers, placeholders, words and parts
of addresses on the other. Training takes at most MAX_FINDINGS of them (a documented bound);
candidates come from every whole text.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strider.llm.shared import keep

MAX_FINDINGS, DICTIONARY, TREES, DEPTH = 20_000, 4_000, 24, 8
NEAR = 48
#: Runs of LONG letters count by themselves; shorter ones only in a provider's format (15 at least).
LONG = 16
_CANDIDATE = regex.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{15,}+={0,2}")
#: A name and its sign of assignment; each name is tried once, from its start.
_NAMED = regex.compile(r"""(?<![\w-])([\w-]++)["']?+\s*+[:=]\s*+""")
_VALUE = regex.compile(r"""(?:"([^"\n]++)"|'([^'\n]++)'|["']?+((?:[^\s"'`,;<>(){}\[\]&]|&(?![\w.-]++=))++))""")
_PART = regex.compile(r"[^&#]*+")
_WORD = regex.compile(r"\p{L}{3,}")
_PROVIDER = regex.compile(r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abpr]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{30,})$")
_NAME = regex.compile(r"(?i)(secret|token|passw(or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential)")
_ASSIGN = regex.compile(r"(?i)(secret|token|passw(or)?d|pwd|key|auth|credential)[\w-]*\s*[\"']?\s*[:=]\s*[\"']?$")
_SECRET = regex.compile(r"(?i)secret|token|passw(or)?d|pwd|key|auth|credential")
_HARMLESS = regex.compile(r"(?i)(example|sample|test|dummy|placeholder|changeme|todo|xxxx|lorem|uuid|checksum|commit|version)")
FEATURES = ["length", "entropy", "transitions", "coverage", "digits", "uppers", "hex", "only_digits", "in_path", "after_assign", "quoted", "secret_word", "harmless_word", "at_sign", "source"]
_ROW = "doc_id long, start long, end long, kind string, value_sha256 string, provider boolean, features array<double>"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value_sha256", pa.string()), ("provider", pa.bool_()), ("features", pa.list_(pa.float64()))])


class Language:
    """The most frequent words of a corpus and what they say about character transitions."""

    def __init__(self, words: dict[str, int]):
        self.words = set(words)
        pairs, firsts = Counter(), Counter()
        for w, n in words.items():
            for a, b in zip(w, w[1:]):
                pairs[a, b] += n
                firsts[a] += n
        self.logs = {(a, b): math.log((n + 1) / (firsts[a] + 64)) for (a, b), n in pairs.items()}
        self.rare = math.log(1 / 64) - 3

    def transitions(self, v: str) -> float:
        low = v.lower()
        return sum(self.logs.get(p, self.rare) for p in zip(low, low[1:])) / max(1, len(v) - 1)

    def coverage(self, v: str) -> float:
        """The share of v that dictionary words of three letters or more cover."""
        low, at, covered = v.lower(), 0, 0
        while at < len(low):
            n = next((n for n in range(min(12, len(low) - at), 2, -1) if low[at : at + n] in self.words), 0)
            covered += n
            at += n or 1
        return covered / max(1, len(v))


def language(docs: DataFrame, text_col: str = "text", most: int = DICTIONARY) -> Language:
    """Counts the words of all texts; the `most` frequent ones are the dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                seen = Counter()
                for t in b.slice(i, 2048).column(0).to_pylist():
                    seen.update(w for w in (t or "").lower().split() if 3 <= len(w) <= 24 and w.isalpha())
                yield pa.RecordBatch.from_arrays([pa.array([*seen], pa.string()), pa.array([*seen.values()], pa.int64())], names=["word", "n"])

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return Language({r["word"]: r["n"] for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()})


def _kind(v: str) -> str:
    return "digits" if v.isdigit() else "hex" if all(c in "0123456789abcdefABCDEF" for c in v) else "base64" if any(c in "+/=" for c in v) else "mixed"


def features(v: str, before: str, after: str, source: str, lang: Language) -> list[float]:
    n, seen = len(v), Counter(v)
    entropy = -sum(k / n * math.log2(k / n) for k in seen.values())
    kind = _kind(v)
    path = "/" in v[1:-1] and n < 60 or before.endswith(("/", ":")) or "://" in before.rpartition(" ")[2]
    return [
        float(n), entropy, lang.transitions(v), lang.coverage(v), sum(c.isdigit() for c in v) / n, sum(c.isupper() for c in v) / n,
        float(kind == "hex"), float(kind == "digits"), float(path), float(bool(_ASSIGN.search(before))), float(before[-1:] in "\"'" and before != ""),
        float(bool(_NAME.search(before))), float(bool(_HARMLESS.search(before + v))), float(after.startswith("@") or before.endswith("@")), float(hashlib.md5(source.encode()).digest()[0] % 16),
    ]


def spans(text: str) -> list[tuple[int, int]]:
    """Where the candidates of a text are, in order."""
    out = {}
    for m in _CANDIDATE.finditer(text):
        v = m[0]
        if _PROVIDER.match(v) or len(v.rstrip("=")) >= LONG and any(c.isdigit() for c in v):
            out[m.start()] = m.end()
    taken = 0
    for m in _NAMED.finditer(text) if "=" in text or ":" in text else ():
        found = m.start() >= taken and _SECRET.search(m[1]) and _VALUE.match(text, m.end())
        inner = found and found[3] and _NAMED.match(text, m.end())
        if not found or inner and _SECRET.search(inner[1]):
            continue
        start, end = found.span(found.lastindex)
        if found[3]:
            # A parameter of an address ends at the next one; a sentence's stop is no part of a value.
            end = _PART.match(text, start, end).end() if text[max(0, m.start() - 1) : m.start()] in ("?", "&") else start + len(found[3].rstrip(".!?:"))
            taken = end
        if end > max(start, out.get(start, 0)):
            out[start] = end
    return sorted(out.items())


def candidates(docs: DataFrame, lang: Language, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row per candidate of every text, with its features; values leave only as hashes."""
    sent = docs.sparkSession.sparkContext.broadcast(lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part, out = b.slice(i, 512), []
                for doc, text, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                    for start, end in spans(text or ""):
                        v, before, after = text[start:end], text[max(0, start - NEAR) : start], text[end : end + NEAR]
                        out.append({"doc_id": doc, "start": start, "end": end, "kind": _kind(v), "value_sha256": hashlib.sha256(v.encode()).hexdigest(), "provider": bool(_PROVIDER.match(v)), "features": features(v, before, after, source or "", known)})
                yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    return rows.mapInArrow(run, _ROW)


def _f(name: str):
    return F.get("features", F.lit(FEATURES.index(name)))


def seed_findings(found: DataFrame) -> DataFrame:
    """found with label 1.0 or 0.0 where rules decide; held-out documents (crc32 mod 3 = 1) have none."""
    yes = F.col("provider") | (_f("after_assign") > 0) & (_f("digits") > 0) & (_f("entropy") >= 3) & (_f("harmless_word") == 0) & (_f("only_digits") == 0)
    no = (_f("only_digits") > 0) | (_f("coverage") >= 0.5) | (_f("at_sign") > 0) | (_f("harmless_word") > 0) | (_f("entropy") < 2.5) | (_f("in_path") > 0)
    label = F.when(yes, 1.0).when(no, 0.0)
    out = found.withColumn("label", label)
    return out.where(F.col("label").isNotNull() & ~F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))


def train(findings: DataFrame, max_findings: int = MAX_FINDINGS):
    """A forest of findings (features, label); None if they have one label only."""
    by = {r["label"]: r["count"] for r in findings.groupBy("label").count().collect()}
    if len(by) < 2:
        return None
    # At most about max_findings rows, by a hash of the finding.
    share = min(1.0, max_findings / sum(by.values()))
    picked = findings.where(F.pmod(F.xxhash64("doc_id", "start", "value_sha256"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = picked.select(array_to_vector("features").alias("x"), "label")
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=17).fit(rows)


def find(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, end (code points), kind, value_sha256, score, is_secret for every candidate.

    findings: labelled candidates (features, label); the seed rules' if None. Null and empty
    texts have no candidates; repeated documents give repeated rows. Where there is nothing to
    learn from, provider formats alone are secrets. Extra columns of docs are ignored.
    """
    # Read by training, by its counts and by the result: scanned once.
    found = keep(candidates(docs, language(docs)), "candidates")
    model = train(seed_findings(found) if findings is None else findings)
    if model is None:
        scored = found.withColumn("score", F.col("provider").cast("double"))
    else:
        scored = model.transform(found.withColumn("x", array_to_vector("features"))).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    score = F.round(F.when(F.col("provider"), F.greatest("score", F.lit(0.99))).otherwise(F.col("score")), 6)
    return scored.select("doc_id", "start", "end", "kind", "value_sha256", score.alias("score"), (score >= threshold).alias("is_secret"))
