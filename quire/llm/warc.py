"""WARC archives: writing, reading, and revisit resolution.

`write` stores one response per page in gzipped archives. `resolve` shuffles only headers by payload digest and joins each
later record to the first of its payload; payloads are equal if SHA-1, which the records carry, SHA-256 and length all are, since
SHA-1 alone can be made to collide. `rewrite` copies every archive with fresh headers: first records stay responses,
others become revisits without payload. `read` parses archives into rows.

Archives are named by attempt and count only if the manifest that a finished task returned names them, so a task that is run
again leaves no double. Defined results: null html is an empty payload; of rows that repeat a page_id and payload the first
written is the response; a page without a page_id comes after those that have one, and revisits of it refer to no page; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dedup import filesystem_ready
from .store import drop, filesystem, fresh, materialize, tasks

ARCHIVE_BYTES = 64 << 20
LEVEL = 1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
HEADERS = "archive string, at long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
WRITTEN = HEADERS + ", payload_sha256 string, url string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def shown(url: str) -> str:
    """An address that can stand in a header."""
    return "".join(c for c in url if c >= " ")


def record(kind: str, page_id: int | None, url: str, payload: bytes, size: int, sha: str, refers_to: int | None = None, refers_url: str = "") -> bytes:
    """One record; a revisit keeps the HTTP head, with the full payload's length, and no payload. DATE is the same for all, so that
    reruns write the same archives."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = head + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {shown(url)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{sha}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", *([f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else []), f"WARC-Refers-To-Target-URI: {shown(refers_url)}", f"WARC-Refers-To-Date: {DATE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def number(urn: str) -> int | None:
    found = urn.strip("<>").rpartition(":")[2]
    return None if found == "None" else int(found)


class Writer:
    """Records into archives of about ARCHIVE_BYTES each; at() is where the next one goes."""

    def __init__(self, folder: str):
        (self.fs, self.base), self.out, self.name, self.place = filesystem(folder), None, "", 0

    def add(self, data: bytes) -> tuple[str, int]:
        if self.out and self.place >= ARCHIVE_BYTES:
            self.close()
        if not self.out:
            self.name, self.place = f"{uuid.uuid4().hex}.warc.gz", 0
            self.out = self.fs.open_output_stream(f"{self.base}/{self.name}", compression=None)
        squeezed = zlib.compress(data, LEVEL, 31)
        self.out.write(squeezed)
        self.place += len(squeezed)
        return self.name, self.place - len(squeezed)

    def close(self):
        if self.out:
            self.out.close()
            self.out = None


def members(folder: str, name: str):
    """(offset, record) of each gzip member of an archive, read in small pieces."""
    fs, base = filesystem(folder)
    with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
        at = start = 0
        rest, unzip, out = b"", zlib.decompressobj(31), []
        while True:
            if not rest and not (rest := f.read(1 << 16)):
                return
            fed = len(rest)
            out.append(unzip.decompress(rest))
            rest = unzip.unused_data if unzip.eof else b""
            at += fed - len(rest)
            if unzip.eof:
                yield start, b"".join(out)
                start, unzip, out = at, zlib.decompressobj(31), []


def _batch(rows: list[tuple], written: bool = False):
    import pyarrow as pa

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * (2 * written)]
    names = ["archive", "at", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload_sha256", "url"] * written]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of one response per page in folder; their headers."""

    def run(batches):
        to = Writer(folder)
        try:
            for batch in batches:
                rows = []
                for page_id, url, html in zip(*(batch.column(i) for i in range(3)), strict=True):
                    payload = (html.as_py() or "").encode()
                    sha = digest(payload)
                    rows.append((*to.add(record("response", page_id.as_py(), url.as_py() or "", payload, len(payload), sha)), page_id.as_py(), len(payload), sha, "response", None, hashlib.sha256(payload).hexdigest(), url.as_py() or ""))
                yield _batch(rows, True)
        finally:
            to.close()

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, WRITTEN)


def resolve(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """headers with record_type, refers_to and refers_url: of equal payloads of least_bytes or more the smallest page_id stays a response."""
    same = ["payload_digest", "payload_sha256", "payload_bytes"]
    own = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "archive", "at")
    first = headers.filter(F.col("payload_bytes") >= least_bytes).groupBy(*same).agg(F.min(own).alias("first"), F.min_by("url", own).alias("first_url"))
    found = headers.drop("record_type", "refers_to").join(first, same, "left")
    again = (F.col("payload_bytes") >= least_bytes) & (F.col("first") != own)
    return found.select(
        "archive", "at", "page_id", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first.page_id")).alias("refers_to"), F.when(again, F.col("first_url")).alias("refers_url"),
    )


def rewrite(resolved: DataFrame, folder: str, to_folder: str) -> DataFrame:
    """Deduplicated archives in to_folder; one row (archive, records) each. Every task takes whole source archives."""

    def run(keys, table):
        import pyarrow as pa

        as_revisit = {at: (to, url) for at, kind, to, url in zip(*(table.column(c).to_pylist() for c in ("at", "record_type", "refers_to", "refers_url")), strict=True) if kind == "revisit"}
        known, to, made = set(table.column("at").to_pylist()), Writer(to_folder), {}
        for at, data in members(folder, keys[0].as_py()):
            if at in known:
                headers, http, payload = parse(data)
                kind = "revisit" if at in as_revisit else "response"
                name, _ = to.add(record(kind, number(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], payload, len(payload), digest(payload), *as_revisit.get(at, ())))
                made[name] = made.get(name, 0) + 1
        to.close()
        return pa.table({"archive": pa.array(list(made), pa.string()), "records": pa.array(list(made.values()), pa.int64())})

    # headers are few, so AQE would put all archives' work into one task
    spread = resolved.select("archive", "at", "record_type", "refers_to", "refers_url").repartition(tasks(resolved.sparkSession, 1), "archive")
    return spread.groupBy("archive").applyInArrow(run, "archive string, records long")


def read(archives: DataFrame, folder: str) -> DataFrame:
    """The headers of each record of the named archives."""

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                for at, data in members(folder, name):
                    h, http, _ = parse(data)
                    size = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
                    refers = number(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None
                    rows.append((name, at, number(h["WARC-Record-ID"]), size, h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"], refers))
                    if len(rows) == 5000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    return archives.select("archive").repartition(tasks(archives.sparkSession, 1), "archive").mapInArrow(run, HEADERS)


def deduplicated(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record of the deduplicated archives."""
    spark = pages.sparkSession
    first, second = fresh(spark, "warc"), fresh(spark, "warc")
    filesystem_ready(spark, first)
    filesystem_ready(spark, second)
    headers = materialize(spark, write(pages, first), "headers")
    archives = materialize(spark, rewrite(resolve(headers, least_bytes), first, second), "archives")
    drop(spark, first)
    return read(archives, second).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
