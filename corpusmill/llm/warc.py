"""WARC records in ZIP packages: written with an index, read by range without extraction.

A package is a ZIP archive of stored members: archive/data.warc.gz, whose records are gzip members of their own, and indexes/index.cdxj,
a line a record with its place in the other. A reader finds both by the central directory (ZIP64 included), takes the index lines whose
records begin in its byte range, and reads just those bytes. Packages have names that no other attempt of a task uses; a manifest lists those of
the attempts that Spark committed, so records are neither lost nor doubled when a repeated task sees its rows in another order.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import time
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from .archives import ZipBuilder, data_offset, directory, read_member
from .media import ByteRange
from .runtime import SharedFile, bound_batches, listed, marked, shared_folder, stored, write_new

DATA, INDEX, SUFFIX = "archive/data.warc.gz", "indexes/index.cdxj", ".wacz"
#: Compressed bytes at which a task begins another package, and that a partition reads.
PACKAGE_BYTES, RANGE_BYTES = 32 << 20, 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed date, so that equal pages make equal records.
DATE = "2000-01-01T00:00:00Z"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest_of(payload: bytes) -> str:
    """Base32 SHA-1, 32 letters without filling."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, compressed. A revisit carries the digest and length of the payload, and which page to take it from, but no payload."""
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').translate({13: None, 10: None})}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
        f"WARC-Full-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    answer = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = answer if revisit else answer + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 1, mtime=0)


def parse_record(data: bytes) -> dict[str, str | bytes]:
    """Header fields by lower-case name, and under "" the payload behind the HTTP header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    found: dict[str, str | bytes] = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    body = rest[: int(found["content-length"])]
    found[""] = body.partition(b"\r\n\r\n")[2]
    return found


def deduplicated(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages with refers_to: of pages with equal payloads of at least least_bytes, all but the one with the largest page_id refer to it.
    A null html is the empty payload. Rows that share the largest page_id are all kept; a null page_id counts as smaller than any other, and
    where a group has none but null, all are kept. Only digests are grouped, and only
    rows whose digest others share (and few more, as a set of bits tells them) meet the groups; no other html is moved. The join may split a digest that
    very many pages share."""
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = F.octet_length("html") >= least_bytes
    groups = keyed.filter(large).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).filter("n > 1 and kept is not null")
    groups = stored(groups.select("digest", "kept"), "shared-digests")
    rows = marked(keyed, F.xxhash64("digest"), groups.select(F.xxhash64("digest").alias("k")))
    alone = rows.filter("not _marked").select("page_id", "url", "html", F.lit(None).cast(dict(pages.dtypes)["page_id"]).alias("refers_to"))
    refers = F.when(F.coalesce(F.col("page_id") != F.col("kept"), F.col("kept").isNotNull()), F.col("kept")).alias("refers_to")
    return alone.unionByName(rows.filter("_marked").join(groups, "digest", "left").select("page_id", "url", "html", refers))


def write_warc(pages: DataFrame, folder: str, zip64: bool = False) -> DataFrame:
    """Writes pages(page_id, url, html, refers_to) to packages in folder when an action runs; rows: package, records, bytes, which stored make
    the manifest that readers want. A record of any length is one member of its package; an empty table makes no package."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, records, lines, held = TaskContext.get().partitionId(), [], [], [], 0

        def close() -> None:
            nonlocal records, lines, held
            if not records:
                return
            z = ZipBuilder(zip64)
            z.add(DATA, b"".join(records))
            z.add(INDEX, "".join(lines).encode())
            z.add("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": DATA}, {"path": INDEX}]}).encode())
            parts = z.parts()
            made.append((write_new(folder, f"part-{part:06d}{SUFFIX}", parts), len(records), sum(map(len, parts))))
            records, lines, held = [], [], 0

        for batch in batches:
            for row in batch.to_pylist():
                data = record_bytes(row["page_id"], row["url"], (row["html"] or "").encode(), row["refers_to"])
                lines.append(f"{row['url'] or '-'!s} {DATE} ".replace("\n", " ") + json.dumps({"offset": held, "length": len(data)}) + "\n")
                records.append(data)
                held += len(data)
                if held >= PACKAGE_BYTES:
                    close()
        close()
        columns = [pa.array([x[i] for x in made], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["package", "records", "bytes"])

    bound_batches(pages.sparkSession)
    return pages.selectExpr("cast(page_id as long) page_id", "url", "html", "refers_to").mapInArrow(run, "package string, records long, bytes long")


class WarcSource(DataSource):
    """Records of the packages in a folder. Options: path; manifest, the writer's stored rows (without it, all packages in the folder); rangeBytes;
    retries, of one record."""

    @classmethod
    def name(cls) -> str:
        return "warc_zip"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.manifest, self.range_bytes = options["path"].rstrip("/"), options.get("manifest"), int(options.get("rangeBytes", RANGE_BYTES))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[ByteRange]:
        found = [ByteRange(uri, lo, min(size, lo + self.range_bytes)) for uri, size in listed(self.path, SUFFIX, self.manifest) for lo in range(0, size, self.range_bytes)]
        return found or [ByteRange("", 0, 0)]

    def fetch(self, uri: str, file: SharedFile, offset: int, length: int) -> tuple[SharedFile, dict[str, str | bytes]]:
        """(file, record): one record, checked against its digest; each time on a fresh handle after the first."""
        for attempt in range(self.retries + 1):
            try:
                r = parse_record(gzip.decompress(file.read_at(offset, length)))
                if r["warc-type"] == "response" and (digest_of(r[""]) != r["warc-payload-digest"].removeprefix("sha1:") or len(r[""]) != int(r["warc-full-payload-length"])):
                    raise ValueError("the payload doesn't match its digest")
                return file, r
            except (OSError, EOFError, ValueError, zlib.error) as e:
                if attempt == self.retries:
                    raise ValueError(f"{uri}, record at {offset}: {e}") from e
                file.close()
                time.sleep(0.05 * (attempt + 1))
                file = SharedFile(uri)
        raise AssertionError

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.uri:
            return
        file = SharedFile(partition.uri)
        members = {m.name: m for m in directory(file)}
        start, rows = data_offset(file, members[DATA]), []
        for line in read_member(file, members[INDEX]).decode().split("\n")[:-1]:
            place = json.loads(line[line.rindex("{") :])
            if not partition.lo <= start + place["offset"] < partition.hi:
                continue
            file, r = self.fetch(partition.uri, file, start + place["offset"], place["length"])
            page, digest, n = r["warc-page-id"], r["warc-payload-digest"].removeprefix("sha1:"), int(r["warc-full-payload-length"])
            refers = r.get("warc-refers-to-page-id")
            rows.append((int(page) if page else None, r["warc-target-uri"], n, digest, r["warc-type"], int(refers) if refers else None))
            if len(rows) >= 4096:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)
        file.close()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in RECORD.split(", ")])


def read_warc(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc_zip").options(path=folder, **options).load()


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    manifest = stored(write_warc(deduplicated(spark.read.parquet(f"{sf_dir}/pages.parquet")), folder), "warc-manifest")
    return read_warc(spark, folder, manifest=f"{manifest._stored_at}/t").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of the SHA-1: bits of the digest five at a time.
OP9_SQL = """
WITH keyed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS hex FROM pages
), grouped AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS kept, count(*) OVER (PARTITION BY hex) AS members FROM keyed
), bits AS (
  SELECT *, list_reduce(list_transform(range(0, 40), lambda i:
    substr('0000000100100011010001010110011110001001101010111100110111101111', instr('0123456789abcdef', substr(hex, i + 1, 1)) * 4 - 3, 4)),
    lambda a, b: a || b) AS b FROM grouped
)
SELECT page_id, n::BIGINT AS payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (CAST(substr(b, i * 5 + 1, 1) AS INT) * 16 + CAST(substr(b, i * 5 + 2, 1) AS INT) * 8 + CAST(substr(b, i * 5 + 3, 1) AS INT) * 4
     + CAST(substr(b, i * 5 + 4, 1) AS INT) * 2 + CAST(substr(b, i * 5 + 5, 1) AS INT)) + 1, 1)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN members > 1 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN members > 1 AND page_id <> kept THEN kept END AS refers_to
FROM bits
"""
