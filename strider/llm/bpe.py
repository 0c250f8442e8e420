"""Byte-level BPE encoding and decoding.

Merging takes pairs from a priority queue of merge ranks over a doubly linked list of symbols;
entries whose symbols have changed since are stale and skipped. Decoding concatenates the
vocabulary's byte strings. The vocabulary file is a parameter; the driver reads it and sends its
bytes, so that tasks need no file of their own.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strider.llm.shared import give_back

#: Fixed: the pre-tokeniser's pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a task remembers; the memory is emptied when full, and when the task ends.
CACHE_WORDS = 250_000
_SLICE = 256


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary: printable Latin-1 bytes
    stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memory(dict):
    """word -> its ids as int32 bytes."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        ids = array("i", self.codec.merge(word.encode("utf-8"))).tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids


class Codec:
    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("this is no plain byte-level BPE vocabulary")
        letters, vocab = byte_letters(), model["vocab"]
        byte_of = {c: b for b, c in letters.items()}
        self.first = [vocab.get(letters[b], -1) for b in range(256)]
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.left = [vocab[a] for a, _ in pairs]
        self.right = [vocab[b] for _, b in pairs]
        self.made = [vocab[a + b] for a, b in pairs]
        self.rank: list[dict[int, int]] = [{} for _ in range(max(vocab.values()) + 1)]  # left id -> right id -> rank
        for r, (a, b) in enumerate(zip(self.left, self.right)):
            self.rank[a].setdefault(b, r)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for s, i in [*vocab.items(), *self.added.items()]:
            self.strings[i] = bytes(byte_of[c] for c in s) if all(c in byte_of for c in s) else s.encode()
        self.sizes = np.array([len(x) for x in self.strings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(self.strings), np.uint8)
        self.split_added = regex.compile("|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.words = regex.compile(PATTERN).findall
        self.memory = _Memory(self)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token."""
        ids = [i for b in word if (i := self.first[b]) >= 0]
        n, rank, left, right, push = len(ids), self.rank, self.left, self.right, heapq.heappush
        shift = n.bit_length()  # an entry is rank << shift | position
        queue = [r << shift | i for i in range(n - 1) if (r := rank[ids[i]].get(ids[i + 1])) is not None]
        if not queue:
            return ids
        after, before, mask = [*range(1, n + 1)], [*range(-1, n - 1)], (1 << shift) - 1
        heapq.heapify(queue)
        while queue:
            top = heapq.heappop(queue)
            r, i = top >> shift, top & mask
            j = after[i]
            if ids[i] != left[r] or j >= n or ids[j] != right[r]:
                continue  # stale: a neighbour was merged away since
            ids[i], ids[j] = self.made[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := rank[ids[i]].get(ids[k])) is not None:
                    push(queue, s << shift | i)
            h = before[i]
            if h >= 0 and (s := rank[ids[h]].get(ids[i])) is not None:
                push(queue, s << shift | h)
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> bytes:
        """The ids of a text, as int32 bytes; added tokens in it are ordinary ids."""
        if len(self.memory) > CACHE_WORDS:
            self.memory.clear()
        ids = self.memory.__getitem__
        if self.split_added is None or not self.split_added.search(text):
            return b"".join(map(ids, self.words(text)))
        out, at = [], 0
        for m in self.split_added.finditer(text):
            out += [*map(ids, self.words(text[at : m.start()])), array("i", [self.added[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, *map(ids, self.words(text[at:]))])

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of runs of ids: ends[i]:ends[i + 1] are those of text i."""
        sizes = self.sizes[ids]
        stops = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(stops[-1]) + np.repeat(self.starts[ids] - stops[:-1], sizes)
        whole = self.letters[at].tobytes()
        cuts = stops[ends].tolist()
        return [whole[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]


#: A worker's codec, by its vocabulary's digest; another vocabulary takes its place.
_here: dict[bytes, Codec] = {}


def _codec(sent) -> Codec:
    digest, raw = sent.value
    if digest not in _here:
        _here.clear()
        _here[digest] = Codec(raw)
    return _here[digest]


def _send(docs: DataFrame, path: str):
    with open(path, "rb") as f:
        raw = f.read()
    return docs.sparkSession.sparkContext.broadcast((hashlib.sha256(raw).digest(), raw))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, _SLICE):
            yield b.slice(i, _SLICE)


def _encoded(c: Codec, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in a row, and where each text's begin (and the last one's end)."""
    packed = [c.encode(t or "") for t in texts]
    return np.frombuffer(b"".join(packed), np.int32), np.cumsum([0, *[len(x) // 4 for x in packed]])


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) for every row of docs; a null or empty text has no ids.

    Rows that repeat are encoded each; an empty table gives no rows; a very long text is one row
    like any other. Other columns of docs are ignored, whatever their names."""
    sent = _send(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _codec(sent)
        for part in _slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(*_encoded(c, part.column(1).to_pylist()))], names=["doc_id", "ids"])
        c.memory.clear()
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (doc_id, ids) with decoded_text; null ids decode to an empty text."""
    sent = _send(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _codec(sent)
        for part in _slices(batches):
            lists = part.column(1)
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            texts = c.decode(lists.flatten().to_numpy(zero_copy_only=False), ends)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded_text"])
        give_back()

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded_text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode(encode(docs)) in one Python pass, with one codec a task."""
    sent = _send(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _codec(sent)
        for part in _slices(batches):
            ids, ends = _encoded(c, part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(ids, ends), pa.array(c.decode(ids, ends), pa.string())], names=["doc_id", "ids", "decoded_text"])
        c.memory.clear()
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded_text string")


def report(decoded: DataFrame, with_ids: bool = False) -> DataFrame:
    """The digest columns of the contract."""
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return decoded.select("doc_id", *[c for c in ("ids",) if with_ids], F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded_text", 256).alias("decoded_sha256"))
