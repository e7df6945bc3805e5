"""What the operators of this subpackage share: the folder that all executors see, files in it, tables cut from their lineage."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch at most (and one row, however long), so that batches of the longest documents still fit a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def shared_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local master, as in tests, may go without: a temporary folder then serves."""
    sc = spark.sparkContext
    if root := sc.getConf().get("spark.checkpoint.dir"):
        return root.rstrip("/")
    if not sc._jsc.sc().isLocal():
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if root := getattr(sc, "_corpusmill_root", None):
        return root
    root = tempfile.mkdtemp(prefix="corpusmill-")
    atexit.register(shutil.rmtree, root, True)
    sc._corpusmill_root = f"file://{root}"
    return sc._corpusmill_root


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, deleted when the driver ends."""
    bound_batches(spark)
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    target, files = _hadoop(spark, path)
    files.mkdirs(target)
    files.deleteOnExit(target)
    if (record := _record.get()) is not None:
        record.append(path)
    return path


def _hadoop(spark: SparkSession, path: str):
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(sc._jsc.hadoopConfiguration())


def bound_batches(spark: SparkSession) -> None:
    """For all that this session plans from now on: batches no larger than these, whatever it had before."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: computed once, and its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark, name)}/t"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path[:-2]
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes what stored() wrote, once no result needs it any more."""
    for t in tables:
        if path := getattr(t, "_stored_at", None):
            drop_stored(t.sparkSession, path)


@contextlib.contextmanager
def recorded(paths: list[str]) -> Iterator[None]:
    """Appends to paths every folder that shared_folder() names meanwhile, in this thread."""
    token = _record.set(paths)
    try:
        yield
    finally:
        _record.reset(token)


_record: ContextVar[list[str] | None] = ContextVar("corpusmill_folders", default=None)


def drop_stored(spark: SparkSession, path: str) -> None:
    """Deletes a folder that stored() or an archive writer made, through the cluster's own file system."""
    target, files = _hadoop(spark, path)
    files.delete(target, True)
    files.cancelDeleteOnExit(target)


def local_path(uri: str) -> str | None:
    """The path, if uri is on a mounted file system."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


class SharedFile:
    """Reads of byte ranges of one file; a mounted file system is read directly, any other through pyarrow.fs."""

    def __init__(self, uri: str):
        if path := local_path(uri):
            self._f = open(path, "rb")
        else:
            from pyarrow import fs

            store, inner = fs.FileSystem.from_uri(uri)
            self._f = store.open_input_file(inner)
        self._f.seek(0, os.SEEK_END)
        self.size = self._f.tell()

    def read_at(self, offset: int, length: int) -> bytes:
        self._f.seek(offset)
        data = self._f.read(length)
        if len(data) != length:
            raise OSError(f"{len(data)} bytes instead of {length} at {offset}")
        return data

    def close(self) -> None:
        self._f.close()


def write_new(folder: str, name: str, parts: Iterator[bytes] | list[bytes]) -> str:
    """Writes a file whose name no other attempt uses and returns that name. Readers take names from the writer's manifest, which holds those of
    the attempts that Spark committed, so what a lost or speculative attempt leaves behind is never read."""
    stem, dot, suffix = name.partition(".")
    name = f"{stem}-{uuid.uuid4().hex[:12]}{dot}{suffix}"
    if path := local_path(folder):
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/{name}", "wb") as f:
            for p in parts:
                f.write(p)
        return name
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(folder)
    store.create_dir(inner, recursive=True)
    with store.open_output_stream(f"{inner}/{name}") as f:
        for p in parts:
            f.write(p)
    return name


def listed(folder: str, suffix: str, manifest: str | None = None) -> list[tuple[str, int]]:
    """Files and their sizes, by name: those of a writer's manifest (its first column, and its column bytes), else all in the folder with this
    suffix; a folder that isn't there holds none."""
    if manifest:
        import pyarrow.dataset as ds

        if path := local_path(manifest):
            store, inner = None, path
        else:
            from pyarrow import fs

            store, inner = fs.FileSystem.from_uri(manifest)
        table = ds.dataset(inner, format="parquet", filesystem=store).to_table()
        if not table.num_rows:
            return []
        return sorted((f"{folder}/{n}", size) for n, size in zip(table.column(0).to_pylist(), table.column("bytes").to_pylist()))
    if path := local_path(folder):
        names = sorted(n for n in (os.listdir(path) if os.path.isdir(path) else []) if n.endswith(suffix) and n[0] != ".")
        return [(f"{folder}/{n}", os.path.getsize(f"{path}/{n}")) for n in names]
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(folder)
    found = store.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return sorted((f"{folder}/{x.base_name}", x.size) for x in found if x.base_name.endswith(suffix) and x.base_name[0] != ".")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


#: Bits of the sets that mark rows by a key: eight a key, within these bounds.
LEAST_MARKS, MOST_MARKS = 1 << 16, 1 << 25


def marked(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """df with a column _marked: true for every row whose key (long) is among keys(key), and for few others. The keys become a set of bits, 64 a
    row, so what is broadcast has a fixed bound (MOST_MARKS bits) however many keys there are; rows marked needlessly must be sorted out by a
    join. Beyond some 30 million keys most rows are marked, which costs time, not results."""
    marks = min(MOST_MARKS, max(LEAST_MARKS, 1 << (8 * keys.count()).bit_length()))
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(marks))
    bit = F.expr("shiftleft(1L, cast(_b % 64 as int))")
    bits = keys.select(place(keys.columns[0]).alias("_b")).groupBy((F.col("_b") / 64).cast("int").alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    found = df.withColumn("_b", place(key)).withColumn("_word", (F.col("_b") / 64).cast("int")).join(F.broadcast(bits), "_word", "left")
    hit = F.expr("(shiftrightunsigned(_bits, cast(_b % 64 as int)) & 1) = 1")
    return found.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(hit, F.lit(False)).alias("_marked"))


def tree_fold(parts: DataFrame, kind: type, fold, fan_in: int = 16) -> DataFrame:
    """Folds rows (slice int, part int, data binary): packed arrays of one numpy kind and, per slice, one length; fold is a ufunc. Groups hold
    fan_in rows at most and each level has a fan_in-th of the rows before, so no task gathers what all partitions made. Columns: slice, data."""
    import numpy as np

    def folded(t: pa.Table) -> pa.Table:
        total = None
        for x in t.column("data").to_pylist():
            a = np.frombuffer(unpack(x), kind)
            total = a.copy() if total is None else fold(total, a, out=total)
        return pa.table({"slice": t.column("slice").slice(0, 1), "part": pa.array([t.column("part")[0].as_py() // fan_in], pa.int32()), "data": pa.array([pack(total.tobytes())], pa.binary())})

    n = max(1, parts.rdd.getNumPartitions())
    while n > 1:
        keys = parts.withColumn("up", (F.col("part") / fan_in).cast("int"))
        parts = keys.groupBy("slice", "up").applyInArrow(lambda t: folded(t), "slice int, part int, data binary")
        n = -(-n // fan_in)
    return parts.select("slice", "data")


def tree_sum(parts: DataFrame) -> DataFrame:
    """tree_fold by addition of int64."""
    import numpy as np

    return tree_fold(parts, np.int64, np.add)


def pack(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def unpack(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)
