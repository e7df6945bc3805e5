"""Exact cosine ranking by blocks of near vectors, and places in a ranking without the ranking.

Unit vectors lie in blocks that share a pivot, each with a centre and the greatest angle that a member has to it. By the triangle inequality for angles
a question's cosine to every member lies between cos(angle + reach) and cos(angle - reach), so a block is multiplied only where that may matter: for
the k nearest, if its best reaches the k-th so far; for places, if it may hold vectors on either side of a candidate. Questions come in slices that
every task gets; blocks stream by, and are never paired with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .index import DIGITS, best

#: Vectors that begin blocks, members of a block at most, questions in a slice, and the tolerance of bounds.
PIVOTS, MEMBERS, SLICE, SLACK = 128, 256, 2048, 1e-9
BLOCKS = "keys binary, units binary, centre binary, reach double"


def unit(vector: list[float] | None, dim: int) -> np.ndarray:
    """A vector of length one, filled up or cut to dim; zero for what is missing, empty, zero or not finite."""
    out = np.zeros(dim)
    if vector:
        v = np.array([np.nan if x is None else x for x in vector], float)
        size = np.sqrt((v * v).sum())
        if np.isfinite(size) and size > 0:
            n = min(dim, len(v))
            out[:n] = v[:n] / size
    return out


def vector_blocks(vectors: DataFrame) -> DataFrame:
    """vectors(key long, vector) as a stored table of blocks. Vectors of all sizes are filled up to the longest; a vector that is missing, empty,
    zero or not finite has cosine 0 to all and lies in a block of such. One pivot's vectors may fill many blocks of many tasks."""
    vectors = vectors.select(F.col("key").cast("long").alias("key"), F.col("vector").cast("array<double>").alias("vector"))
    dim = max(vectors.agg(F.max(F.size("vector"))).first()[0] or 0, 1)
    sample = vectors.where(F.size("vector") > 0).orderBy(F.xxhash64("key"), "key").limit(PIVOTS).collect()
    pivots = np.array([u for u in (unit(r["vector"], dim) for r in sample) if u.any()]).reshape(-1, dim)
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([unit(v, dim) for v in batch.column(1).to_pylist()]).reshape(-1, dim)
            near = (rows @ shared.value.T).argmax(1) if len(shared.value) and len(rows) else np.zeros(len(rows), int)
            near = np.where(rows.any(1), near, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(near), batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["pivot", "key", "unit"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None
        for batch in batches:
            for pivot, key, row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (pivot != of or len(held) == MEMBERS):
                    yield block(held)
                    held = []
                of = pivot
                held.append((key, row))
        if held:
            yield block(held)

    def block(held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        rows = np.frombuffer(b"".join(r for _, r in held)).reshape(-1, dim)
        centre = rows.sum(0)
        centre = centre / max(np.sqrt((centre * centre).sum()), 1e-300)
        reach = float(np.arccos(np.clip(rows @ centre, -1, 1)).max())
        columns = (np.array([k for k, _ in held], np.int64).tobytes(), rows.tobytes(), centre.tobytes())
        return pa.RecordBatch.from_arrays([*(pa.array([c], pa.binary()) for c in columns), pa.array([reach])], names=[c.split()[0] for c in BLOCKS.split(", ")])

    dealt = vectors.mapInArrow(assign, "pivot int, key long, unit binary").repartitionByRange("pivot", "key").sortWithinPartitions("pivot", "key")
    out = stored(dealt.mapInArrow(cut, BLOCKS), "vector-blocks")
    out._dim = dim
    return out


class Questions:
    """A slice of questions as a matrix of unit vectors."""

    def __init__(self, rows: list[tuple[int, list[float] | None]], dim: int):
        self.ids, self.units = np.array([q for q, _ in rows], np.int64), np.array([unit(v, dim) for _, v in rows]).reshape(-1, dim)

    def range(self, centre: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest cosine that members of a block can have, by question; a block of zero vectors has 0 alone."""
        angle = np.arccos(np.clip(self.units @ centre, -1, 1))
        least, most = np.cos(np.minimum(angle + reach, np.pi)), np.cos(np.maximum(angle - reach, 0))
        if not centre.any():
            least, most = np.zeros(len(angle)), np.zeros(len(angle))
        zero = ~self.units.any(1)
        return np.where(zero, 0, least), np.where(zero, 0, most)


def slices(questions: DataFrame) -> Iterator[list[tuple]]:
    """questions(qid long, vector) in lists of SLICE, a partition at a time."""
    out = []
    for r in questions.select(F.col("qid").cast("long"), F.col("vector").cast("array<double>")).toLocalIterator():
        out.append((r[0], r[1]))
        if len(out) == SLICE:
            yield out
            out = []
    if out:
        yield out


def _opened(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    for keys, units, centre, reach in zip(*(c.to_pylist() for c in batch.columns)):
        yield np.frombuffer(keys, np.int64), np.frombuffer(units).reshape(-1, dim), np.frombuffer(centre), reach


def _foremost(q: np.ndarray, keys: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each question's k first: score descending, ties by key."""
    order = np.lexsort((keys, -scores, q))
    of = q[order]
    first = np.flatnonzero(np.diff(of, prepend=-1))
    return order[np.arange(len(of)) - np.repeat(first, np.diff(first, append=len(of))) < k]


def nearest(blocks: DataFrame, questions: DataFrame, k: int, report: dict | None = None) -> DataFrame:
    """qid, key, ord, score, rank (from 1) of each question's k first by cosine, ties by key; stored. Each slice of questions is one pass over the
    blocks. report gets how many pairs of question and block there were and how many were multiplied."""
    spark, dim, out = blocks.sparkSession, blocks._dim, None
    for part in slices(questions):
        shared = spark.sparkContext.broadcast(part)  # SLICE at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked, pairs, multiplied, size = Questions(shared.value, dim), 0, 0, 0
            least, held = np.full(len(asked.ids), -np.inf), []
            for batch in batches:
                for keys, units, centre, reach in _opened(batch, dim):
                    _, most = asked.range(centre, reach)
                    open_ = np.flatnonzero(most >= least - SLACK)
                    pairs, multiplied = pairs + len(most), multiplied + len(open_)
                    scores = np.round(asked.units[open_] @ units.T, DIGITS) + 0.0
                    q, m = np.nonzero(scores >= least[open_, None])
                    held.append((open_[q], keys[m], scores[q, m]))
                    size += len(q)
                    if size > 4 * k * len(asked.ids) or not np.isfinite(least).all():
                        held, size = compact(held, least)
            held, size = compact(held, least)
            q, keys, scores = held[0]
            columns = (pa.array(asked.ids[q]), pa.array(keys), pa.array(scores), pa.nulls(len(q), pa.int64()), pa.nulls(len(q), pa.int64()))
            yield pa.RecordBatch.from_arrays(list(columns), names=names)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.array([pairs]), pa.array([multiplied])], names=names)

        def compact(held: list[tuple], least: np.ndarray) -> tuple[list[tuple], int]:
            q, keys, scores = (np.concatenate([h[i] for h in held]) if held else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, float)))
            at = _foremost(q, keys, scores, k)
            q, keys, scores = q[at], keys[at], scores[at]
            whole = np.flatnonzero(np.bincount(q, minlength=len(least)) == k)
            lowest = np.full(len(least), np.inf)
            np.minimum.at(lowest, q, scores)
            least[whole] = lowest[whole]
            return [(q, keys, scores)], len(q)

        names = ["qid", "key", "score", "pairs", "multiplied"]
        rows = blocks.select("keys", "units", "centre", "reach").mapInArrow(run, "qid long, key long, score double, pairs long, multiplied long")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = spark.createDataFrame([], "qid long, key long, score double, pairs long, multiplied long")
    out = stored(out, "nearest")
    if report is not None:
        sums = out.where("qid is null").agg(F.sum("pairs"), F.sum("multiplied")).first()
        report |= {"pairs": sums[0] or 0, "multiplied": sums[1] or 0}
    return best(out.where("qid is not null").select("qid", "key", F.col("key").alias("ord"), "score"), k)


def places(blocks: DataFrame, questions: DataFrame, candidates: DataFrame, report: dict | None = None) -> DataFrame:
    """qid, key, rank0, score: where candidates(qid, key), which are among the blocks' keys, stand in the whole ranking by cosine (from 0, ties by
    key). Blocks that lie wholly before or behind all candidates of a question are counted, not multiplied."""
    spark, dim, out = blocks.sparkSession, blocks._dim, None
    scored = stored(_scores_of(blocks, questions, candidates), "candidate-scores")
    for part in slices(questions):
        ids = [q for q, _ in part]
        wanted: dict[int, list[tuple[float, int]]] = {}
        for r in scored.where(F.col("qid").isin(ids)).collect():  # a slice's candidates
            wanted.setdefault(r["qid"], []).append((-r["score"], r["key"]))
        shared = spark.sparkContext.broadcast((part, {q: sorted(w) for q, w in wanted.items()}))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            rows, wanted = shared.value
            asked, pairs, multiplied = Questions(rows, dim), 0, 0
            lists = [np.array(wanted.get(q, []), [("s", float), ("k", np.int64)]) for q in asked.ids.tolist()]
            before = [np.zeros(len(w), np.int64) for w in lists]
            for batch in batches:
                for keys, units, centre, reach in _opened(batch, dim):
                    least, most = asked.range(centre, reach)
                    for i, w in enumerate(lists):
                        if not len(w):
                            continue
                        pairs += 1
                        if most[i] < -w["s"][-1] - SLACK:
                            continue  # behind the last candidate
                        if least[i] > -w["s"][0] + SLACK:
                            before[i] += len(keys)
                            continue
                        multiplied += 1
                        before[i] += better(w["s"], w["k"], -(np.round(units @ asked.units[i], DIGITS) + 0.0), keys)
            for q, w, n in zip(asked.ids.tolist(), lists, before):
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(w), pa.int64()), pa.array(w["k"].copy()), pa.array(n), pa.array(np.zeros(len(w), np.int64)), pa.array(np.zeros(len(w), np.int64))], names=names)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(3)), pa.array([pairs]), pa.array([multiplied])], names=names)

        names = ["qid", "key", "before", "pairs", "multiplied"]
        rows = blocks.select("keys", "units", "centre", "reach").mapInArrow(run, "qid long, key long, before long, pairs long, multiplied long")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return scored.withColumn("rank0", F.lit(0).cast("long")).select("qid", "key", "rank0", "score")
    out = stored(out, "places")
    if report is not None:
        sums = out.where("qid is null").agg(F.sum("pairs"), F.sum("multiplied")).first()
        report |= {"pairs": sums[0] or 0, "multiplied": sums[1] or 0}
    ranks = out.where("qid is not null").groupBy("qid", "key").agg(F.sum("before").alias("rank0"))
    return ranks.join(scored, ["qid", "key"]).select("qid", "key", "rank0", "score")


def better(score: np.ndarray, order: np.ndarray, scores: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """How many of (scores, orders) come before each of the sorted candidates (score, order); both least first."""
    n = len(score)
    line = np.lexsort((np.concatenate([np.zeros(n), np.ones(len(scores))]), np.concatenate([order, orders]), np.concatenate([score, scores])))
    at = np.flatnonzero(line < n)
    return (at - np.arange(n))[np.argsort(line[at])]


def _scores_of(blocks: DataFrame, questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """qid, key, score of candidates: their vectors are taken out of the blocks, and meet the questions by id."""
    dim = blocks._dim

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, units, _, _ in _opened(batch, dim):
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([u.tobytes() for u in units], pa.binary())], names=["key", "unit"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [float(np.frombuffer(u) @ unit(v, dim)) for u, v in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(np.array(found, float), DIGITS) + 0.0)], names=["qid", "key", "score"])

    rows = blocks.select("keys", "units", "centre", "reach").mapInArrow(members, "key long, unit binary")
    pairs = candidates.select("qid", "key").distinct().join(rows, "key").join(questions.select("qid", F.col("vector").cast("array<double>").alias("vector")), "qid")
    return pairs.select("qid", "key", "unit", "vector").mapInArrow(multiply, "qid long, key long, score double")
