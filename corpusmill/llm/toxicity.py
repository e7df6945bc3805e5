"""Toxicity: maximum-scoring segments of token log-odds, judged by extreme-value statistics.

Words and their beginnings are counted in hashed arrays of fixed size: over all documents, and over labelled ones by class. Log-odds between
the classes have a Dirichlet prior in proportion to the counts of the whole corpus. A token takes the largest log-odds, of its word or one of its
beginnings, that lie surely above zero, and scores log(1 - e + e * odds): the gain of a passage model that puts a share e on toxic words; any
other token scores log(1 - e). A word scores the same at each of its places. A linear scan finds all maximal segments. Their scores follow an
extreme-value law in clean text, whose scale and rate are fitted on clean labelled rows; segments beyond chance are the passages, and a
document's score combines the largest, their number and their sum.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import bounded_sample, training_labels
from .runtime import bound_batches, pack, remainder, stored, texts_of, tree_sum, unpack

#: Words are runs of letters; the second pattern gives the same for texts of ASCII alone, in less time.
WORD, ASCII_WORD = re.compile(r"[^\W\d_]+"), re.compile(r"[A-Za-z]+")
BUCKETS, SLICES, BEGINNINGS = 1 << 19, 8, (5, 6, 7, 8)
#: Strength of the prior in tokens, share of toxic words in a passage, and the expected count of chance passages below which one is kept.
PRIOR, SHARE, EXPECTED = 2000.0, 0.05, 0.05
#: Deviations from which log-odds count, and what any other token scores.
SURE, NEUTRAL = 3.0, -0.05
#: Labelled rows that are learnt from at most, words that a task counts before it adds them up, and words whose weights it remembers.
SAMPLE, COUNTED, REMEMBER = 50_000, 300_000, 300_000


def words_in(text: str) -> list[str]:
    return (ASCII_WORD if text.isascii() else WORD).findall(text)


def features(word: str) -> list[int]:
    """Buckets of a word and of its beginnings."""
    beginnings = [word[:n] for n in BEGINNINGS[: bisect_right(BEGINNINGS, len(word))]]
    return [crc32(x.encode()) % BUCKETS for x in (word + "$", *beginnings)]


def count_words(docs: DataFrame, labels: dict[int, int]) -> np.ndarray:
    """Counts by bucket, rows: all documents, labelled 0, labelled 1. labels: a bounded sample."""
    known = docs.sparkSession.sparkContext.broadcast(labels)  # SAMPLE rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, counts, label = np.zeros((3, BUCKETS), np.int64), [Counter(), Counter(), Counter()], known.value

        def flush() -> None:
            for row, counter in zip(total, counts):
                if counter:
                    buckets, n = zip(*((b, c) for w, c in counter.items() for b in features(w)))
                    row += np.bincount(buckets, n, BUCKETS).astype(np.int64)
                    counter.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                words = set(map(str.lower, set(words_in(text))))  # once a document: repeats are no further evidence
                counts[0].update(words)
                if (y := label.get(doc_id)) is not None:
                    counts[1 + y].update(words)
                if len(counts[0]) > COUNTED:
                    flush()
        flush()
        part = TaskContext.get().partitionId()
        blocks = [pack(x.tobytes()) for row in total for x in np.split(row, SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([part] * len(blocks), pa.int32()), pa.array(blocks, pa.binary())], names=["slice", "part", "data"])

    bound_batches(docs.sparkSession)
    parts = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "slice int, part int, data binary")
    out = np.zeros((3 * SLICES, BUCKETS // SLICES), np.int64)
    for r in tree_sum(parts).collect():
        out[r["slice"]] = np.frombuffer(unpack(r["data"]), np.int64)
    return out.reshape(3, BUCKETS)


def log_odds(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of class 1 against class 0 and how many deviations each lies from zero."""
    prior = PRIOR * (counts[0] + 0.01) / (counts[0].sum() + 0.01 * BUCKETS)
    clean, toxic = counts[1] + prior, counts[2] + prior
    odds = np.log(toxic / (toxic.sum() - toxic)) - np.log(clean / (clean.sum() - clean))
    return odds.astype(np.float32), (odds / np.sqrt(1 / toxic + 1 / clean)).astype(np.float32)


class Weights(dict):
    """Scores of words in the passage model, small and capital letters alike; REMEMBER of them are kept."""

    def __init__(self, odds: np.ndarray, deviations: np.ndarray):
        self.odds, self.sure = odds, (deviations >= SURE).tobytes()

    def __missing__(self, word: str) -> float:
        sure = [float(self.odds[b]) for b in features(word.lower()) if self.sure[b]]
        w = float(np.log1p(SHARE * (np.exp(min(max(sure), 20)) - 1))) if sure else NEUTRAL
        if len(self) < REMEMBER:
            self[word] = w
        return w


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time. Only tokens with positive scores are visited one by one; what lies
    between them enters as a cumulative sum."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[list[float]] = []  # start, end, total before, total behind
    for i in np.flatnonzero(scores > 0).tolist():
        new = [i, i + 1, total[i], total[i + 1]]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(int(a), int(b), float(y - x)) for a, b, x, y in stack]


def segments_of(text: str, weigh: Weights) -> tuple[int, list[tuple[int, int, float]]]:
    """How many words a text has, and its maximal segments in words."""
    scores = np.array(list(map(weigh.__getitem__, words_in(text))))
    return len(scores), maximal_segments(scores)


def places(text: str, found: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Segments with code points of the text instead of words."""
    at = [m.span() for m in WORD.finditer(text)] if found else []
    return [(at[a][0], at[b - 1][1], s) for a, b, s in found]


SEGMENTS = "doc_id long, n_tokens long, starts array<int>, ends array<int>, scores array<double>"


def segments(docs: DataFrame, odds: np.ndarray, deviations: np.ndarray) -> DataFrame:
    """Each document's number of tokens and all its maximal segments, in code points."""
    shared = docs.sparkSession.sparkContext.broadcast((odds, deviations))  # of fixed size: BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = Weights(*shared.value)
        for batch in batches:
            rows = []
            for text in texts_of(batch):
                n, found = segments_of(text, weigh)
                rows.append((n, *(list(zip(*places(text, found))) or ((), (), ()))))
            columns, kinds = list(zip(*rows)) or [()] * 4, (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "n_tokens", "starts", "ends", "scores"])

    bound_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SEGMENTS)


@dataclass
class Calibration:
    """rate and scale of P(largest < x) = exp(-scale * n * exp(-rate * x)), and weights of the logistic step."""

    rate: float
    scale: float
    weights: np.ndarray

    def inputs(self, n: np.ndarray, best: np.ndarray, passages: np.ndarray, total: np.ndarray) -> np.ndarray:
        """1; how far the largest lies beyond chance; log of the number of passages; log of their sum."""
        excess = np.clip(self.rate * best - np.log(self.scale * np.maximum(n, 1)), -20, 60)
        return np.column_stack([np.ones(len(n)), excess / 10, np.log1p(passages), np.log1p(total)])

    def beyond_chance(self, n: int, scores: np.ndarray) -> np.ndarray:
        return self.scale * max(n, 1) * np.exp(-self.rate * scores) < EXPECTED

    def passages(self, n: int, scores: np.ndarray) -> np.ndarray:
        return scores[self.beyond_chance(n, scores)]

    def probabilities(self, n: np.ndarray, scores: list[np.ndarray]) -> np.ndarray:
        best = np.array([s.max(initial=0.0) for s in scores])
        kept = [self.passages(int(k), s) for k, s in zip(n, scores)]
        x = self.inputs(n, best, np.array([len(s) for s in kept], float), np.array([s.sum() for s in kept]))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -50, 50)))


def fit_extremes(n: np.ndarray, best: np.ndarray) -> tuple[float, float]:
    """Rate and scale from the largest scores of clean documents, by maximum likelihood: for a given rate the scale is closed, and the rate
    is searched on a grid."""
    n = np.maximum(n, 1).astype(float)
    if not len(n) or best.max(initial=0) <= 0:
        return 1.0, 0.01

    def fit(rate: float) -> tuple[float, float]:
        scale = len(n) / (n * np.exp(-rate * best)).sum()
        return -(np.log(rate * scale * n) - rate * best - scale * n * np.exp(-rate * best)).sum(), scale

    rate = min(np.exp(np.linspace(np.log(0.1), np.log(5), 80)), key=lambda r: fit(r)[0])
    return float(rate), float(fit(rate)[1])


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (y - p) - 0.1 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def calibrate(found: DataFrame, labels: dict[int, int]) -> Calibration:
    """From found(doc_id, n_tokens, scores), one row for each labelled id that is there. Three numbers of a row are collected, and once the law of
    the largest scores is known two more, so what the driver gets has a bound that doesn't depend on the texts."""
    largest = F.coalesce(F.array_max("scores"), F.lit(0.0))
    rows = sorted(tuple(r) for r in found.select("doc_id", "n_tokens", largest).collect())
    y, n, best = np.array([labels[d] for d, _, _ in rows], int), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
    c = Calibration(*fit_extremes(n[y == 0], best[y == 0]), np.array([-3.0, 5.0, 0.5, 0.5]))
    if len(set(y.tolist())) < 2:
        return c
    beyond = F.filter("scores", lambda s: F.lit(c.scale) * F.greatest("n_tokens", F.lit(1)) * F.exp(F.lit(-c.rate) * s) < EXPECTED)
    sums = {r[0]: (r[1], r[2]) for r in found.select("doc_id", F.size(beyond), F.aggregate(beyond, F.lit(0.0), lambda a, s: a + s)).collect()}
    c.weights = fit_logistic(c.inputs(n, best, *np.array([sums[d] for d, _, _ in rows], float).T), y)
    return c


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score, and the passages found: starts, ends (code points of the text) and their scores. labels: doc_id, label; rows with a null are
    left out, of labels that clash the larger counts, and the sample ids with the smallest hashes are learnt from. Null and empty texts score as
    documents without words; an empty table gives no rows; repeated rows get equal scores; rows that share a labelled id are counted each and
    calibrate as one; a text of any length is scanned whole; columns besides doc_id and text are ignored, whatever their names."""
    spark = docs.sparkSession
    known = {r["doc_id"]: int(r["label"]) for r in bounded_sample(labels, sample).collect()}
    weights = log_odds(count_words(docs, known))
    chosen = spark.createDataFrame(list(known.items()), "doc_id long, label int")
    few = docs.selectExpr("cast(doc_id as long) doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")  # sample rows at most
    found = segments(few, *weights).groupBy("doc_id").agg(F.min(F.struct("n_tokens", "scores")).alias("s")).select("doc_id", "s.*")
    c = calibrate(stored(found, "taught"), known)
    shared = spark.sparkContext.broadcast(weights)  # of fixed size: BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = Weights(*shared.value)
        for batch in batches:
            texts, rows = texts_of(batch), []
            found = [segments_of(t, weigh) for t in texts]
            n, scores = np.array([k for k, _ in found], float), [np.array([s for _, _, s in x]) for _, x in found]
            p = np.round(c.probabilities(n, scores), 9) if texts else np.zeros(0)
            for text, (k, x), s in zip(texts, found, scores):
                kept = places(text, [x[i] for i in np.flatnonzero(c.beyond_chance(k, s))])
                rows.append(list(zip(*kept)) or ((), (), ()))
            starts, ends, values = zip(*rows) if rows else ((),) * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], names=["doc_id", "score", "starts", "ends", "scores"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, score double, starts array<int>, ends array<int>, scores array<double>")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_toxicity(docs, training_labels(spark, sf_dir, "toxic", 5, 0))
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"), F.size("scores").alias("n_passages"))
