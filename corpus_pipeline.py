"""The training-data pipeline: each stage works on what the one before kept, as written to the shared folder and read again."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm.jaccard import keep_representatives
from corpusmill.llm.packing import pack
from corpusmill.llm.quality import keep_quality, training_labels
from corpusmill.llm.runtime import discard, drop_stored, recorded, stored
from corpusmill.llm.secrets import redact_documents
from corpusmill.llm.substring import drop_repeats
from corpusmill.session import ship_package


class _Left(threading.local):
    """By the tables that a pipeline of this thread runs on: folders that its last stage wrote for itself, and needs until its result is
    written. By the time that the next one begins they can go."""

    def __init__(self):
        self.folders: dict[str, list[str]] = {}


_left = _Left()


def _stage(f):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        folders = _left.folders.setdefault(sf_dir, [])
        while folders:
            drop_stored(spark, folders.pop())
        with recorded(folders):
            return f(spark, docs, sf_dir)

    run_stage.__doc__ = f.__doc__
    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; all others keep all their columns. Null and empty texts are scored like any other, repeated
    rows alike; without labels every document scores the same; an empty table stays empty."""
    return keep_quality(docs, training_labels(spark, sf_dir, "quality", 3, 1))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest id stays, with all its columns. Texts without words are like nothing and
    stay; of rows that share an id one stays, the smallest text; rows with a null id all stay; an empty table stays empty."""
    return keep_representatives(docs)


@_stage
def repeated_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that occur elsewhere too are taken out of text, and n_chars is set anew; no row goes and other columns stay. A null text
    becomes empty, texts shorter than a window stay as they are, repeated rows lose all their windows; an empty table stays empty."""
    return drop_repeats(docs)


@_stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark in text, and n_chars is set anew; no row goes and other columns stay. Null texts stay null, rows don't depend
    on each other; an empty table stays empty."""
    return redact_documents(docs)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences whose sources keep their shares. A null or empty text is its end id alone, repeated rows are packed
    each, a null source is a source; an empty table has no pieces."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_windows),
    ("secret scans", secrets),
    ("packing", packing),
]

#: A trained network decides in the first stage, which SQL can't express; tests hold the pipeline against its parts and brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        discard(before)  # the tables read have no folder of ours and stay
    return docs
