"""WARC archives, index first.

Pages become WARC/1.1 records, one gzip member each, in one archive per task. The writer
returns an index row per record (file, offset, length, URL, digest); only the rows of tasks
that succeeded are committed, so a retried task leaves at most an archive that nothing names.
Reading selects rows of the index, sorts them by (file, offset), joins neighbouring ranges and
fetches each joined range at once.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strider.llm.shared import BROADCAST_IDS, fresh_path, keep, whole

#: Bytes between two records up to which their ranges are fetched as one; most bytes of a fetch.
GAP_BYTES, FETCH_BYTES = 64 << 10, 8 << 20
#: A task starts another archive beyond this size.
ARCHIVE_BYTES = 1 << 30
DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = pa.schema([(c, pa.int64()) for c in ("page_id",)] + [("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
_INDEX_DDL = "page_id long, url string, file string, offset long, length long, digest string, record_type string, refers_to long"
_READ_DDL = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _from_urn(urn: str) -> int | None:
    last = urn.strip("<>").rpartition(":")[2]
    return None if last == "none" else int(last)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> tuple[bytes, str]:
    """The record's bytes and its payload digest. A revisit holds the response's headers only."""
    digest = payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    # Control characters and spaces may not stand in a header line.
    uri = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else _urn(page_id).strip("<>")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse(raw: bytes) -> dict:
    """A record's WARC headers, HTTP headers' length and payload; raises where they disagree."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    head = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(head["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"{head['WARC-Record-ID']}: payload and digest disagree")
    return {"page_id": _from_urn(head["WARC-Record-ID"]), "record_type": head["WARC-Type"], "refers_to": _from_urn(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None, "payload_bytes": size, "payload_digest": digest, "payload": payload if head["WARC-Type"] == "response" else None}


def plan_records(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, refers_to, revisit: of equal payloads of min_bytes or more, the page
    with the largest id is the response (rows that repeat that id too), the others revisit it.

    Only payloads that repeat meet the pages again: up to BROADCAST_IDS of them go to all tasks,
    and no html is shuffled."""
    html = whole(html_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.octet_length(html).alias("bytes"), F.sha1(F.encode(html, "UTF-8")).alias("sha"), F.xxhash64(html).alias("check"))
    key = ["sha", "check", "bytes"]
    shared = rows.where(F.col("bytes") >= min_bytes).groupBy(*key).agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = keep(shared, "shared_payloads")
    if shared.count() <= BROADCAST_IDS:
        shared = F.broadcast(shared)
    out = rows.join(shared, key, "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(planned: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the records to the shared folder; their index, itself a table there."""
    folder = fresh_path(planned.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        out, name, at = None, "", 0
        try:
            for b in batches:
                index = []
                for r in b.to_pylist():
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        store.create_dir(base, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    raw, digest = record(r["page_id"], r["url"], r["html"].encode("utf-8"), r["refers_to"], r["revisit"])
                    packed = gzip.compress(raw, 4, mtime=0)
                    out.write(packed)
                    index.append({"page_id": r["page_id"], "url": r["url"], "file": f"{folder}/{name}", "offset": at, "length": len(packed), "digest": digest, "record_type": "revisit" if r["revisit"] else "response", "refers_to": r["refers_to"]})
                    at += len(packed)
                yield pa.RecordBatch.from_pylist(index, schema=_INDEX)
        finally:
            if out is not None:
                out.close()

    return keep(planned.mapInArrow(write, _INDEX_DDL), "warc_index")


def coalesce_ranges(rows: list[dict], gap: int = GAP_BYTES, most: int = FETCH_BYTES) -> Iterator[list[dict]]:
    """Runs of rows, sorted by (file, offset), to fetch as one range."""
    run: list[dict] = []
    for r in rows:
        if run and (r["file"] != run[0]["file"] or r["offset"] - (run[-1]["offset"] + run[-1]["length"]) > gap or r["offset"] + r["length"] - run[0]["offset"] > most):
            yield run
            run = []
        run.append(r)
    if run:
        yield run


def read_records(index: DataFrame, gap: int = GAP_BYTES, fetch: int = FETCH_BYTES) -> DataFrame:
    """The records that the rows of an index select, parsed and verified."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, pa.NativeFile | None] = ("", None)
        for b in batches:
            for run in coalesce_ranges(b.to_pylist(), gap, fetch):
                if run[0]["file"] != opened[0]:
                    if opened[1] is not None:
                        opened[1].close()
                    store, path = _store(run[0]["file"])
                    opened = (run[0]["file"], store.open_input_file(path))
                start = run[0]["offset"]
                got = opened[1].read_at(run[-1]["offset"] + run[-1]["length"] - start, start)
                out = []
                for r in run:
                    found = parse(zlib.decompress(got[r["offset"] - start : r["offset"] - start + r["length"]], 31))
                    if found["page_id"] != r["page_id"] or found["payload_digest"] != r["digest"]:
                        raise ValueError(f"the index row of page {r['page_id']} names another record")
                    out.append(found | {"url": r["url"]})
                yield pa.RecordBatch.from_pylist(out, schema=_READ)

    rows = index.select("page_id", "url", "file", "offset", "length", "digest")
    tasks = max(1, index.rdd.getNumPartitions())
    rows = rows.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return rows.mapInArrow(read, _READ_DDL)


def round_trip(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives pages and reads every record back: page_id, url, record_type, refers_to,
    payload_bytes, payload_digest (base32 SHA-1), payload (null for revisits).

    A null html is an empty payload, a null URL becomes the page's urn in the archive; a null id
    is kept. Repeated rows get a record each. An empty table gives no rows. Other columns of
    pages are ignored.
    """
    return read_records(write_archives(plan_records(pages, min_bytes, id_col, url_col, html_col)))
