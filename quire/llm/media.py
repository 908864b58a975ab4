"""Media columns: payloads stored as images in archives, and a data source that reads them by byte ranges.

A payload is the text in UTF-8 with bytes 0 up to a positive multiple of WIDTH, kept as an 8-bit grey PNG of that width (one
sample a byte, lossless) in a ZIP archive. The data source `quire_archive` plans byte ranges over the archives of a
manifest; a range reads the members whose headers begin in it, in batches, and each member is tried again by its offset,
apart from the others.

Defined results: null is an empty text, stored as one row of zeros; equal texts give equal values; rows repeated are stored
once each; a row without a doc_id keeps none; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .near_dedup import filesystem_ready
from .store import filesystem, fresh

WIDTH, LEVEL = 64, 3
ARCHIVE_BYTES, SPLIT_BYTES, BATCH_BYTES = 64 << 20, 8 << 20, 4 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(data: bytes) -> bytes:
    return data + bytes((-len(data)) % WIDTH if data else WIDTH)


def encode(payload: bytes) -> bytes:
    """A grey PNG whose samples are the payload's bytes, row by row, unfiltered."""
    import numpy as np

    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def decode(media: bytes):
    """The samples of such a PNG, with all checksums tested."""
    import numpy as np

    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, parts, width, height = 8, [], 0, 0
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            width, height = struct.unpack(">II", data[:8])
        elif kind == b"IDAT":
            parts.append(data)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows")
    return raw[:, 1:]


def feature(samples) -> str:
    """Mean, deviation, and a 64-bit hash: which of 8 x 8 block means exceed their mean."""
    import numpy as np

    bands = np.array_split(np.arange(len(samples)), 8)
    rows = np.array([samples[b].mean(0) if len(b) else np.zeros(samples.shape[1]) for b in bands])
    blocks = rows.reshape(8, 8, -1).mean(2)
    bits = int("".join("1" if x else "0" for x in (blocks > blocks.mean()).ravel()), 2)
    return f"mean={samples.mean():.4f};std={samples.std():.4f};hash={bits:016x}"


def write(docs: DataFrame, folder: str) -> DataFrame:
    """Stores each row of docs; returns the archives of finished tasks (archive, bytes)."""

    def run(batches):
        import pyarrow as pa

        fs, base = filesystem(folder)
        made, out, name, n = [], None, "", 0

        def close():
            nonlocal out, n
            if out:
                out[1].close()
                made.append((name, out[0].tell()))
                out[0].close()
                out, n = None, 0

        for batch in batches:
            for doc_id, text in zip(*(batch.column(i) for i in range(2)), strict=True):
                if out and n >= ARCHIVE_BYTES:
                    close()
                if not out:
                    name = f"{uuid.uuid4().hex}.zip"
                    stream = fs.open_output_stream(f"{base}/{name}", compression=None)
                    out = stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
                data = (text.as_py() or "").encode()
                media = encode(padded(data))
                out[1].writestr(f"{len(out[1].filelist)}/{doc_id.as_py()}/{len(data)}.png", media)
                n += len(media)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.string()), pa.array([x[1] for x in made], pa.int64())], ["archive", "bytes"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "archive string, bytes long")


class Range(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.manifest = options["folder"], options["manifest"]
        self.split, self.attempts = int(options.get("split_bytes", SPLIT_BYTES)), int(options.get("attempts", 3))

    def partitions(self):
        """Byte ranges; a member belongs to the range in which its header begins."""
        import pyarrow.parquet as pq
        from pyarrow import fs as pafs

        fs, path = filesystem(self.manifest)
        files = [x.path for x in fs.get_file_info(pafs.FileSelector(path)) if x.path.endswith(".parquet")]
        rows = [r for f in files for r in pq.read_table(f, filesystem=fs).to_pylist()]
        return [Range(r["archive"], a, a + self.split) for r in rows for a in range(0, r["bytes"], self.split)] or [Range("", 0, 0)]

    def member(self, fs, path: str, info, archive=None) -> bytes:
        """One member by its offset; a failed try opens the archive anew. zipfile tests the member's checksum."""
        for attempt in range(self.attempts):
            try:
                if attempt == 0 and archive:
                    return archive.read(info)
                with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                    return z.read(next(x for x in z.infolist() if x.header_offset == info.header_offset))
            except (OSError, zipfile.BadZipFile, zlib.error):
                if attempt + 1 == self.attempts:
                    raise
        raise AssertionError

    def read(self, partition):
        import pyarrow as pa

        if not partition.archive:
            return
        fs, base = filesystem(self.folder)
        path, rows, size = f"{base}/{partition.archive}", [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["member", "at", "media"])

        with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
            for info in z.infolist():
                if partition.start <= info.header_offset < partition.end:
                    rows.append((info.filename, info.header_offset, self.member(fs, path, info, z)))
                    size += info.file_size
                    if size >= BATCH_BYTES:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


class ArchiveSource(DataSource):
    @classmethod
    def name(cls):
        return "quire_archive"

    def schema(self):
        return "member string, at long, media binary"

    def reader(self, schema):
        return ArchiveReader(self.options)


def read(spark: SparkSession, folder: str, manifest: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """member, at, media of each member of the manifest's archives."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("quire_archive").option("folder", folder).option("manifest", manifest).option("split_bytes", split_bytes).load()


def digests(media: DataFrame) -> DataFrame:
    """What the stored bytes say: one row per member."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [[] for _ in range(8)]
            for member, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, doc_id, size = member.removesuffix(".png").split("/")
                data = data.as_py()
                samples = decode(data)
                payload = samples.tobytes()
                row = (None if doc_id == "None" else int(doc_id), int(size), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples))
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], [x.split()[0] for x in RESULT.split(", ")])

    return media.select("member", "media").mapInArrow(run, RESULT)


def stored(docs: DataFrame) -> DataFrame:
    """Stores the texts of docs and reads them back: one row of digests each."""
    spark = docs.sparkSession
    folder, manifest = fresh(spark, "media"), fresh(spark, "manifest")
    filesystem_ready(spark, folder)
    write(docs, folder).write.parquet(manifest)
    return digests(read(spark, folder, manifest))
