"""Operator 5: media columns read through a data source of our own.

Payloads are stored as 8-bit grayscale PNG images (576 samples a row, lossless) in ZIP archives, one
archive for each task that writes.  The data source ``media_archive`` plans partitions as byte ranges
over the archives: a member belongs to the range in which its local header starts, which the archive's
central directory tells.  A partition streams its members as Arrow batches and reads each by its own
offset; a member that fails (a short read, a bad checksum, a file system error) is read again by that
offset, with the file opened anew, without repeating the others.

Scale: archives hold what one task wrote; the driver sees a manifest row per archive (path, size,
members) and never a payload.  Batches are bounded by bytes.  Archives are written under the shared
folder through pyarrow's file systems, under a name of the attempt's own, so a lost or repeated task
leaves no partial archive in the manifest.

Defined results: null text is empty; empty text is one row of padding.  A null doc_id stays null.
Repeated rows are members of their own.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import common

ROW = 576
PAD = 255
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
MANIFEST = "path string, bytes long, members long"
MEMBERS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def payload(text: str | None) -> tuple[int, bytes]:
    """The text's length in bytes, and its bytes with padding to a positive multiple of a row."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes([PAD]) * (max(1, -(-len(raw) // ROW)) * ROW - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(samples: bytes, level: int = 3) -> bytes:
    height = len(samples) // ROW
    lines = np.zeros((height, ROW + 1), dtype=np.uint8)  # each line starts with filter type 0
    lines[:, 1:] = np.frombuffer(samples, dtype=np.uint8).reshape(height, ROW)
    head = struct.pack(">IIBBBBB", ROW, height, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """The samples, as (height, ROW).  Reads images that to_png made; raises ValueError for others."""
    if not media.startswith(_SIGNATURE):
        raise ValueError("not a PNG image")
    at, data, shape = len(_SIGNATURE), [], None
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if len(body) < n or media[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError("a damaged PNG chunk")
        if kind == b"IHDR":
            width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", body)
            if (width, depth, colour, *rest) != (ROW, 8, 0, 0, 0, 0):
                raise ValueError("not an image of this format")
            shape = height, width + 1
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if shape is None:
        raise ValueError("no PNG header")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(shape)
    if lines[:, 0].any():
        raise ValueError("a filter this reader does not have")
    return lines[:, 1:]


def write_archives(documents: DataFrame, folder: str) -> DataFrame:
    """Writes documents (doc_id, text) as archives; the manifest: path, bytes, members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = common.filesystem(folder)
        name, n = f"{top}/{uuid.uuid4().hex}.zip", 0
        archive = None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if archive is None:
                    files.create_dir(top, recursive=True)
                    out = files.open_output_stream(name)
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                size, samples = payload(text)
                info = zipfile.ZipInfo(f"{'null' if doc_id is None else doc_id}/{n}.png")
                info.comment = str(size).encode()
                archive.writestr(info, to_png(samples))
                n += 1
        if archive is not None:
            archive.close()
            out.close()
            size = files.get_file_info(name).size
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["path", "bytes", "members"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, MANIFEST)


class ByteRange(InputPartition):
    def __init__(self, path: str, size: int, start: int, end: int):
        self.path, self.size, self.start, self.end = path, size, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.manifest = options["manifest"]
        self.range_bytes = int(options.get("rangeBytes", 32 << 20))
        self.batch_bytes = int(options.get("batchBytes", 4 << 20))
        self.attempts = int(options.get("attempts", 3))

    def partitions(self) -> list[ByteRange]:
        files, _ = common.filesystem(self.folder)
        import pyarrow.dataset as ds

        rows = ds.dataset(common.filesystem(self.manifest)[1], filesystem=files, format="parquet").to_table().to_pylist()
        out = []
        for r in sorted(rows, key=lambda r: r["path"]):
            cuts = max(1, -(-r["bytes"] // self.range_bytes))
            edges = [r["bytes"] * i // cuts for i in range(cuts + 1)]
            out += [ByteRange(r["path"], r["bytes"], a, b) for a, b in zip(edges, edges[1:], strict=False)]
        return out

    def _member(self, files, path: str, opened, offset: int, size: int, crc: int):
        """The member's bytes, and the open file; each attempt starts at the member's own offset."""
        for attempt in range(self.attempts):
            try:
                opened = opened or files.open_input_file(path)
                head = opened.read_at(30, offset)
                if head[:4] != b"PK\x03\x04":
                    raise ValueError("no member starts here")
                name, extra = struct.unpack_from("<HH", head, 26)
                body = opened.read_at(size, offset + 30 + name + extra)
                if len(body) != size or zlib.crc32(body) != crc:
                    raise ValueError("short or damaged")
                return body, opened
            except (OSError, ValueError) as e:
                opened = None
                if attempt + 1 == self.attempts:
                    raise OSError(f"{path}, member at {offset}: {e}") from e
                time.sleep(0.05 * 2**attempt)
        raise AssertionError

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        files, _ = common.filesystem(self.folder)
        with files.open_input_file(partition.path) as f, zipfile.ZipFile(f) as archive:
            members = [i for i in archive.infolist() if partition.start <= i.header_offset < partition.end]
        opened, rows, held = None, [], 0
        for m in sorted(members, key=lambda m: m.header_offset):
            body, opened = self._member(files, partition.path, opened, m.header_offset, m.file_size, m.CRC)
            owner = m.filename.partition("/")[0]
            rows.append((None if owner == "null" else int(owner), int(m.comment), body))
            held += len(body)
            if held >= self.batch_bytes:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), MEMBERS, strict=True)], schema=MEMBERS)


class MediaArchive(DataSource):
    """spark.read.format("media_archive").option("manifest", ...).load(folder): doc_id, n_bytes, media."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    """Decodes each image and describes it: digests, and mean, deviation and an 8-bin histogram of its samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, n, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                samples = from_png(body)
                raw = samples.tobytes()
                histogram = np.bincount(samples.ravel() >> 5, minlength=8)
                feature = f"{samples.shape[1]}x{samples.shape[0]};mean={samples.mean():.4f};std={samples.std():.4f};hist={','.join(map(str, histogram))}"
                out.append((doc_id, n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(body), hashlib.sha256(body).hexdigest(), feature))
            if out:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [f.split()[0] for f in FEATURES.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)


def store(documents: DataFrame) -> DataFrame:
    """Writes documents (doc_id, text) to archives in the shared folder, and reads them through the data source."""
    spark: SparkSession = documents.sparkSession
    folder, manifest = common.scratch(spark, "media"), common.scratch(spark, "media-manifest")
    write_archives(documents, folder).write.parquet(manifest)
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("manifest", manifest).load(folder)


def op5_media_columns(spark, sf_dir: str) -> DataFrame:
    """The query: every document's payload stored, read back and described."""
    return features(store(common.table(spark, sf_dir, "documents").select("doc_id", "text")))
