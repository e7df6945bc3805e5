"""Media columns: payloads stored as images in archives, read back by a data source that plans byte ranges.

A payload becomes an 8-bit grey PNG, 192 samples wide. Each task writes archives of images under names that no other attempt uses, and a manifest
lists those of the attempts that Spark committed. The source takes archives and their sizes from the manifest (or lists the folder), plans a
partition per byte range, and a partition reads the members whose headers begin in its range. Every member is read, checked and if need be
read again on its own, by its offset, so one bad read doesn't repeat the others.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .archives import Member, ZipBuilder, directory, read_member
from .runtime import SharedFile, bound_batches, listed, shared_folder, stored, texts_of, write_new

#: Samples in a row, and the byte that fills a payload up.
WIDTH, FILL = 192, 32
#: Bytes at which a task begins another archive, that a partition reads, and that a batch of members holds.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 64 << 20, 16 << 20, 8 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SUFFIX = ".media.zip"


def padded(raw: bytes) -> bytes:
    """raw, filled up to a positive multiple of WIDTH."""
    return raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, bytes([FILL]))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 1) -> bytes:
    """The payload as rows of 8-bit grey samples, losslessly; equal payloads give equal images."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # a filter type of 0 before each row
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> np.ndarray:
    """Samples of an image that to_png() made; each chunk's checksum is held against its data."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    p, data, shape = 8, b"", None
    while p < len(image):
        (n,), kind = struct.unpack_from(">I", image, p), image[p + 4 : p + 8]
        body = image[p + 8 : p + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, p + 8 + n)[0]:
            raise ValueError(f"{kind!r}: checksum differs")
        if kind == b"IHDR":
            shape = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data += body
        p += 12 + n
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("a row filter that isn't written here")
    return lines[:, 1:]


def feature_of(samples: np.ndarray) -> str:
    """Mean, deviation and mean step between neighbours, then a 64-bit hash: which cells of an 8 x 8 grid exceed the mean cell."""
    x = samples.astype(np.int64)
    flat = x.reshape(-1)
    columns = x.reshape(len(x), 8, WIDTH // 8).sum(2)
    edges = np.arange(9) * len(x) // 8
    grid = np.array([columns[a : max(b, a + 1)].mean(0) for a, b in zip(edges, edges[1:])])
    bits = np.packbits((grid > grid.mean()).reshape(-1)).tobytes().hex()
    step = np.abs(np.diff(flat)).mean()
    return f"{flat.mean():.4f}:{flat.std():.4f}:{step:.4f}:{bits}"


def write_media(docs: DataFrame, folder: str) -> DataFrame:
    """Writes docs(doc_id, text) as images to archives in folder when an action runs; rows: archive, members, bytes, which stored make the
    manifest that readers want. A null text counts as empty; a null doc_id is kept; repeated rows are members each; an empty table makes no
    archive; columns of docs other than doc_id and text are ignored, whatever their names. A text of any length is one member. A member's name
    holds the id and the length before filling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, zip_ = TaskContext.get().partitionId(), [], ZipBuilder()

        def close() -> None:
            nonlocal zip_
            if len(zip_):
                parts = zip_.parts()
                made.append((write_new(folder, f"part-{part:06d}{SUFFIX}", parts), len(zip_), sum(map(len, parts))))
                zip_ = ZipBuilder()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                raw = text.encode()
                zip_.add(f"{'' if doc_id is None else doc_id}_{len(raw)}.png", to_png(padded(raw)))
                if zip_.size >= ARCHIVE_BYTES:
                    close()
        close()
        a, n, b = zip(*made) if made else ((),) * 3
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(n, pa.int64()), pa.array(b, pa.int64())], names=["archive", "members", "bytes"])

    bound_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "archive string, members long, bytes long")


class MediaSource(DataSource):
    """Members of the archives in a folder. Options: path; manifest, the writer's stored rows (without it, all archives in the folder);
    rangeBytes; retries, of a directory or one member; mode: failfast (a member that stays bad ends the read) or permissive (it comes with a
    null media and the error)."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, media binary, attempts int, error string"

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(self.options)


class ByteRange(InputPartition):
    def __init__(self, uri: str, lo: int, hi: int):
        super().__init__((uri, lo, hi))
        self.uri, self.lo, self.hi = uri, lo, hi


class MediaReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.manifest = options["path"].rstrip("/"), options.get("manifest")
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.retries, self.permissive = int(options.get("retries", 3)), options.get("mode", "failfast").lower() == "permissive"

    def partitions(self) -> list[ByteRange]:
        found = [ByteRange(uri, lo, min(size, lo + self.range_bytes)) for uri, size in listed(self.path, SUFFIX, self.manifest) for lo in range(0, size, self.range_bytes)]
        return found or [ByteRange("", 0, 0)]

    def opened(self, uri: str) -> tuple[SharedFile, list[Member]]:
        """An archive and its directory, tried as often as a member."""
        for attempt in range(1, self.retries + 2):
            try:
                file = SharedFile(uri)
                return file, directory(file)
            except (OSError, ValueError) as e:
                error = e
                time.sleep(0.05 * attempt)
        raise error

    def fetch(self, uri: str, file, member: Member):
        """(file, data, attempts, error): reads one member at its offset, each time on a fresh handle after the first."""
        for attempt in range(1, self.retries + 2):
            try:
                if file is None:
                    file = SharedFile(uri)
                return file, read_member(file, member), attempt, None
            except (OSError, ValueError) as e:
                error = f"{type(e).__name__}: {e}"
                if file is not None:
                    file.close()
                    file = None
                time.sleep(0.05 * attempt)
        if not self.permissive:
            raise OSError(f"{uri}, member at {member.header}: {error}")
        return file, None, attempt, error

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.uri:
            return
        file, members = self.opened(partition.uri)
        rows, held = [], 0
        for m in members:
            if not partition.lo <= m.header < partition.hi:
                continue
            file, data, attempts, error = self.fetch(partition.uri, file, m)
            doc_id, _, n = m.name.removesuffix(".png").rpartition("_")
            rows.append((int(doc_id) if doc_id else None, int(n), data, attempts, error))
            held += len(data or b"")
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)
        if file is not None:
            file.close()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "n_bytes", "media", "attempts", "error"])


def read_media(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(MediaSource)
    return spark.read.format("media_archive").options(path=folder, **options).load()


FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
)


def media_features(media: DataFrame) -> DataFrame:
    """Digests and feature of each image's samples; of a null image, nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for image in batch.column(2).to_pylist():
                if image is None:
                    rows.append((None,) * 6)
                    continue
                samples = from_png(image)
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature_of(samples)))
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    names = [x.split()[0] for x in FEATURES.split(", ")]
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "media")
    manifest = stored(write_media(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder), "media-manifest")
    return media_features(read_media(spark, folder, manifest=f"{manifest._stored_at}/t"))
