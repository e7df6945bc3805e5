"""Tables that are computed once: written to the folder that the driver and all executors share, and read again."""

from __future__ import annotations

import atexit
import contextlib
import json
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local master, as in tests, may go without: a temporary folder then serves."""
    sc = spark.sparkContext
    if root := sc.getConf().get("spark.checkpoint.dir"):
        return root.rstrip("/")
    if not sc._jsc.sc().isLocal():
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not getattr(sc, "_corpusmill_tables", None):
        folder = tempfile.mkdtemp(prefix="corpusmill-tables-")
        atexit.register(shutil.rmtree, folder, True)
        sc._corpusmill_tables = f"file://{folder}"
    return sc._corpusmill_tables


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under the shared one, deleted when the driver ends."""
    path, sc = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}", spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(sc._jsc.hadoopConfiguration())
    files.mkdirs(target)
    files.deleteOnExit(target)
    return path


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with other settings, which are set back behind it."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: repeated use, and lost executors, don't compute it again."""
    path = f"{new_folder(df.sparkSession, name)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str, group: str | None = None) -> DataFrame:
    """df with a number from 1 in the order given, in all or by group. Rows are dealt to partitions by ranges of the order and stored; each
    partition numbers its own and begins where those before it end, so no task sorts them all."""
    by = [F.col(group)] if group else []
    dealt = stored(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range", *by).agg(F.count("*").alias("_n"))  # a row for each range and group in it
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", *by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order))
    rows = dealt.withColumn("_place", place).join(starts, ["_range", *([group] if group else [])])
    return rows.withColumn(name, F.col("_start") + F.col("_place")).select(*df.columns, name)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to as many partitions as the cluster works on at once where it has fewer, as a table in one small file has. Larger tables stay
    as they are, so no large table is ever shuffled for this."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


#: Rows of a partition where tasks hold what they group.
PART_ROWS = 250_000


def parts_of(df: DataFrame) -> int:
    """Partitions for df's rows, PART_ROWS in each, and as many as the cluster works on at once where that is more: a task that groups or sorts one of
    them needs no more memory when the table grows. df is counted; of a Parquet table only the footers are read for that."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // PART_ROWS))


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of change of a path's files: equal as long as nothing in it is written."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    files, out = target.getFileSystem(sc._jsc.hadoopConfiguration()).listFiles(target, True), []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def commit_version(spark: SparkSession, path: str, version: int, content: dict) -> None:
    """Creates the file of a version of what a folder holds; fails where another writer was first. What no version names is nobody's."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{version:09d}.json")
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target, False)
    out.write(bytearray(json.dumps(content | {"complete": True}).encode()))
    out.close()


def last_version(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    """The last version whose file is whole, and what it holds; (0, None) where there is none."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    files = target.getFileSystem(sc._jsc.hadoopConfiguration())
    names = sorted((s.getPath().getName() for s in files.listStatus(target)), reverse=True) if files.exists(target) else []
    for name in (n for n in names if n.endswith(".json") and n[:-5].isdigit()):
        text = spark.read.text(f"{path}/versions/{name}", wholetext=True).first()
        with contextlib.suppress(ValueError):
            found = json.loads(text[0] if text else "")
            if found.get("complete"):
                return int(name[:-5]), found
    return 0, None
