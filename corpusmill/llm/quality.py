"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, and a temperature for its probabilities.

Every token has a bucket, and every bucket a sparse random index vector. A bucket's word vector is the sum, over the whole corpus, of the
index vectors of its neighbours. Tasks add these up in arrays of fixed size, which a tree of bounded groups merges, so neither the
vocabulary nor its co-occurrences are shuffled. A document is the mean, deviation and coherence of its tokens' vectors.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import bound_batches, pack, remainder, texts_of, tree_sum, unpack

#: Words, numbers and runs of other marks are tokens, as they are written.
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
BUCKETS, SIZE, NONZERO, REACH, SLICES = 1 << 16, 32, 4, 2, 64
#: Labelled rows that the network learns from at most, and those of them that set the temperature instead.
SAMPLE, CALIBRATE = 20_000, 0.2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 256, 3e-3, 1e-4
#: Tokens whose buckets a task remembers, and tokens that it gathers before it adds them up.
REMEMBER, GATHER = 200_000, 1 << 20


class Buckets:
    """Buckets of a text's tokens."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        known, out = self.known, []
        for t in TOKEN.findall(text):
            b = known.get(t)
            if b is None:
                b = zlib.crc32(t.encode()) % BUCKETS
                if len(known) < REMEMBER:
                    known[t] = b
            out.append(b)
        return np.array(out, np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's non-zero entries, from a fixed seed."""
    rng = np.random.default_rng(20240501)
    places = np.argsort(rng.random((BUCKETS, SIZE)), axis=1)[:, :NONZERO]
    return places.astype(np.int64), rng.choice([-1, 1], (BUCKETS, NONZERO)).astype(np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Centred unit vectors of all buckets, from all texts; an array of fixed size. A bucket that no text holds is zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        places, signs, buckets = *index_vectors(), Buckets()
        total = np.zeros(BUCKETS * SIZE + BUCKETS, np.int64)

        def add(rows: list[np.ndarray]) -> None:
            ids, doc = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            total[BUCKETS * SIZE :] += np.bincount(ids, minlength=BUCKETS)
            for step in range(1, min(REACH, len(ids) - 1) + 1):
                same = doc[:-step] == doc[step:]
                a, b = ids[:-step][same], ids[step:][same]
                for j in range(NONZERO):
                    for word, near in ((a, b), (b, a)):
                        np.add.at(total, word * SIZE + places[near, j], signs[near, j])

        rows, n = [], 0
        for batch in batches:
            for text in texts_of(batch):
                rows.append(buckets(text))
                n += len(rows[-1])
                if n > GATHER:
                    add(rows)
                    rows, n = [], 0
        if n:
            add(rows)
        part = TaskContext.get().partitionId()
        blocks = [pack(x.tobytes()) for x in (*np.split(total[: BUCKETS * SIZE], SLICES), total[BUCKETS * SIZE :])]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES + 1), pa.int32()), pa.array([part] * (SLICES + 1), pa.int32()), pa.array(blocks, pa.binary())], names=["slice", "part", "data"])

    bound_batches(docs.sparkSession)
    slices = {r["slice"]: np.frombuffer(unpack(r["data"]), np.int64) for r in tree_sum(docs.select("text").mapInArrow(run, "slice int, part int, data binary")).collect()}
    if len(slices) <= SLICES:
        return np.zeros((BUCKETS, SIZE), np.float32)
    m, count = np.concatenate([slices[i] for i in range(SLICES)]).reshape(BUCKETS, SIZE).astype(np.float64), slices[SLICES]
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    unit -= (unit * count[:, None]).sum(0) / max(1, count.sum())
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
    unit[count == 0] = 0
    return unit.astype(np.float32)


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Features of a document from its tokens' buckets; zeros without tokens."""
    if not len(ids):
        return np.zeros(2 * SIZE + 5, np.float32)
    v = vectors[ids]
    mean, spread = v.mean(0), v.std(0)
    near = float(np.einsum("ij,ij->i", v[:-1], v[1:]).mean()) if len(ids) > 1 else 0.0
    again = float((ids[:-1] == ids[1:]).mean()) if len(ids) > 1 else 0.0
    beyond = float((ids[:-2] == ids[2:]).mean()) if len(ids) > 2 else 0.0
    return np.concatenate([mean, spread, [np.linalg.norm(mean), near, again, beyond, np.log1p(len(ids))]]).astype(np.float32)


def document_vectors(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id and features of each text; a null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # of fixed size: BUCKETS x SIZE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            data = [pooled(buckets(t), shared.value).tobytes() for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "features"])

    bound_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, features binary")


@dataclass
class Network:
    """Two layers, standardised inputs and a temperature. With one class or no rows to learn from, a constant."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.shift) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, own: np.ndarray, seed: int = 7) -> Network:
    """own: rows that set the temperature, and that the layers don't learn from."""
    size = x.shape[1] if x.ndim == 2 else 1
    if len(y) == 0 or y.min() == y.max():
        constant = 0.0 if len(y) == 0 else (4.0 if y[0] else -4.0)
        return Network(np.zeros(size), np.ones(size), np.zeros((size, 1)), np.zeros(1), np.zeros(1), constant, 1.0)
    learn = ~own if (~own).any() and len(set(y[~own])) == 2 else np.ones(len(y), bool)
    shift, scale = x[learn].mean(0), x[learn].std(0) + 1e-6
    z, t, rng = (x[learn] - shift) / scale, y[learn].astype(float), np.random.default_rng(seed)
    p = [rng.normal(0, size**-0.5, (size, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.array(np.log((t.mean()) / (1 - t.mean())))]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(t))
        for i in range(0, len(t), BATCH):
            rows = order[i : i + BATCH]
            h = np.tanh(z[rows] @ p[0] + p[1])
            error = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -50, 50))) - t[rows]) / len(rows)
            back = np.outer(error, p[2]) * (1 - h * h)
            step += 1
            for k, g in enumerate((z[rows].T @ back + DECAY * p[0], back.sum(0), h.T @ error + DECAY * p[2], error.sum())):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(shift, scale, p[0], p[1], p[2], float(p[3]), 1.0)
    if own.any():
        logits, target = net.logits(x[own]), y[own]
        grid = np.exp(np.linspace(np.log(0.5), np.log(8), 60))
        net.temperature = float(min(grid, key=lambda s: np.logaddexp(0, np.where(target, -1, 1) * logits / s).mean()))
    return net


def bounded_sample(labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, label and h of the labelled ids with the smallest hashes, sample at most; of labels that clash the larger counts. Hashes that can't
    be among them are left out before rows are gathered, so what tasks send doesn't grow with their number."""
    known = labels.filter("doc_id is not null and label is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("label").cast("int").alias("label"))
    known = known.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    share = min(1.0, 1.1 * sample / max(1, known.count()))
    return known.filter(F.col("h") < F.lit(int(share * (1 << 40)) + 1)).orderBy("h", "doc_id").limit(sample)


def learn(docs: DataFrame, vectors: np.ndarray, labels: DataFrame, sample: int) -> Network:
    """From the documents of a bounded sample of labels, which alone are read for that; which of them set the temperature goes by their hashes.
    Of rows that share an id one counts, whatever the order of the rows."""
    spark = docs.sparkSession
    known = {r["doc_id"]: (int(r["label"]), r["h"]) for r in bounded_sample(labels, sample).collect()}
    chosen = spark.createDataFrame([(d,) for d in known], "doc_id long")
    few = docs.selectExpr("cast(doc_id as long) doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")  # sample rows at most
    rows = document_vectors(few, vectors).groupBy("doc_id").agg(F.min("features").alias("features")).collect()
    rows = sorted((known[r["doc_id"]][1], r["doc_id"], known[r["doc_id"]][0], r["features"]) for r in rows)
    x = np.array([np.frombuffer(f, np.float32) for _, _, _, f in rows], np.float64).reshape(len(rows), 2 * SIZE + 5)
    own = np.array([(h >> 8) % 1000 < CALIBRATE * 1000 for h, _, _, _ in rows], bool)
    return fit(x, np.array([y for _, _, y, _ in rows], int), own)


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id and the probability that a document's label is 1. labels: doc_id, label; rows with a null are left out, of labels that clash the
    larger counts. Empty and null texts are scored like any other, and texts of any length whole; an empty table gives no rows; repeated rows get
    equal scores; columns besides doc_id and text are ignored, whatever their names. Word vectors come from all of docs; the network learns
    from the sample ids with the smallest hashes; then every document is scored where it is read."""
    vectors = word_vectors(docs)
    net = learn(docs, vectors, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([np.frombuffer(f, np.float32) for f in batch.column(1).to_pylist()], np.float64)
            p = np.round(net.probabilities(x), 9) if len(x) else np.zeros(0)  # the last bits depend on which rows share a batch
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return document_vectors(docs, vectors).mapInArrow(run, "doc_id long, score double")


def keep_quality(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """docs whose score (see score_quality) is at least least, with all their columns."""
    spark, at = docs.sparkSession, docs.columns.index("text")
    vectors = word_vectors(docs)
    net = learn(docs, vectors, labels, sample)
    shared = spark.sparkContext.broadcast(vectors)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            x = np.array([pooled(buckets(t), shared.value) for t in texts], np.float64).reshape(len(texts), -1)
            yield batch.filter(pa.array(np.round(net.probabilities(x), 9) >= least if texts else np.zeros(0, bool), pa.bool_()))

    bound_batches(spark)
    return docs.mapInArrow(run, docs.schema)


def training_labels(spark: SparkSession, sf_dir: str, column: str, modulus: int, held_out: int) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.filter(remainder(F.col("doc_id"), modulus) != held_out).select("doc_id", F.col(column).alias("label"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_quality(docs, training_labels(spark, sf_dir, "quality", 3, 1))
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
