"""Fill-in-the-middle form of whole texts, cut at lines.

A Split pre-tokenizer of the tokenizers library (no vocabulary, no training) isolates the lines; its
offsets are code points, so the number of offsets is the number of lines and the cuts are slices at
ranked offsets. Which lines and which form a text gets depends on its id and the seed alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from strider.llm.shared import give_back

#: Fixed: a line with its end, or the last one without.
LINE = r"[^\n]*\n|[^\n]+"
#: Fixed: what stands before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: The pre-tokenizer keeps some 32 bytes a character: longer texts go through it in parts of whole lines.
PART_CHARS = 1 << 20
_SLICE = 256
_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def line_ends(text: str, split: pre_tokenizers.Split, part_chars: int = PART_CHARS) -> np.ndarray:
    """The code-point offset at which each line of the text ends."""
    found, at = [], 0
    while at < len(text):
        # A part ends after a line end, so no line is cut; one very long line stays whole.
        end = text.find("\n", at + part_chars) + 1 or len(text)
        part = text if not at and end == len(text) else text[at:end]
        offsets = split.pre_tokenize_str(part)
        found.append(np.fromiter((e for _, (_, e) in offsets), np.int64, len(offsets)) + at)
        at = end
    return np.concatenate(found) if found else np.empty(0, np.int64)


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of an id; a null id is written as nothing."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def _check(sentinels: tuple[str, str, str]) -> None:
    """Refuses sentinels that a text without them could complete, so that none can be misread."""
    inner = lambda s, ends: {s[-i:] if ends else s[:i] for i in range(1, len(s))}
    if not all(sentinels) or any(a in b for a, b in permutations(sentinels, 2)) or any(inner(a, True) & inner(b, False) for a, b in product(sentinels, repeat=2)):
        raise ValueError(f"sentinels overlap: {sentinels}")


def transform(
    docs: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, sentinels: tuple[str, str, str] = SENTINELS,
    id_col: str = "doc_id", text_col: str = "text", part_chars: int = PART_CHARS,
) -> DataFrame:
    """doc_id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars (code points, null if
    plain), output for every row of docs.

    A null text is empty; an empty text or one that holds a sentinel stays plain. Ids are whole
    numbers and may repeat or be null: rows with one id get the same draws. Very long texts are cut
    whole; an empty table gives no rows. Other columns of docs are ignored, whatever their names."""
    _check(sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = pre_tokenizers.Split(Regex(LINE), "isolated")
        p, s, m = sentinels
        for b in batches:
            for i in range(0, b.num_rows, _SLICE):
                part, rows = b.slice(i, _SLICE), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    text = text or ""
                    ends = line_ends(text, split, part_chars)
                    n = len(ends)
                    h1, h2, h3, h4 = draws(seed, doc_id)
                    if not text or any(x in text for x in sentinels) or h3 % 100 >= fim_percent:
                        rows.append((n, "plain", None, None, text))
                        continue
                    a, c = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
                    prefix, middle, suffix = text[:a], text[a:c], text[c:]
                    if h4 % 100 < spm_percent:
                        rows.append((n, "spm", a, c - a, f"{s}{suffix}{p}{prefix}{m}{middle}"))
                    else:
                        rows.append((n, "psm", a, c - a, f"{p}{prefix}{s}{suffix}{m}{middle}"))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                arrays = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _OUT)


def restored(output: Column | str = "output", form: Column | str = "form", sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that transform was given, from its output and form alone."""
    _check(sentinels)
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    p, s, m = sentinels

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        a = F.substring_index(F.substr(output, F.lit(len(first) + 1)), second, 1)
        rest = F.substr(output, F.lit(len(first) + len(second) + 1) + F.length(a))
        b = F.substring_index(rest, m, 1)
        return a, b, F.substr(rest, F.length(b) + F.lit(len(m) + 1))

    prefix, suffix, middle = parts(p, s)
    suffix_2, prefix_2, middle_2 = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_2, middle_2, suffix_2)).otherwise(output)


def report(transformed: DataFrame) -> DataFrame:
    """The digest columns of the contract."""
    return transformed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


SQL = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS ls, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
u AS (SELECT doc_id, t, ls, len(ls)::BIGINT AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[25:32])::BIGINT AS h4 FROM h),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
x AS (SELECT doc_id, t, n, form, array_to_string(ls[1:a], '') AS p, array_to_string(ls[a + 1:b], '') AS m, array_to_string(ls[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256 FROM x
"""
