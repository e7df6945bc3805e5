"""Session construction and access to the driver tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", name: str = "corpusmill") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the submitter's own settings are used instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a context, so that they need no copy of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_corpusmill_shipped", False):
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="corpusmill-package-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(path := f"{folder}/corpusmill.zip", "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f"{here.name}/{f.relative_to(here)}")
    sc.addPyFile(path)
    sc._corpusmill_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; only columns that the plan uses are read."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def default_dir() -> str:
    return os.environ.get("CORPUSMILL_SF_DIR", "/root/testdata/sf0.001")
