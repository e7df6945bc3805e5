"""Exact top-k search by inner product: MaxScore over shards of signed postings.

A term is a dimension with a sign; a vector's component puts the vector into the posting of the dimension's positive or negative term. A query
weights the terms whose sign agrees with its own components; a component of the other sign can only lower a score and has a bound of zero. In
a shard, the largest component of each term bounds what the term can give. Terms in the order of these bounds split where what the rest can
give together stays under the k-th best score so far: the postings before the split are essential, and all of them are traversed, adding up
partial scores; vectors in none of them are no candidates. The other terms are probed, a few at a time, and only for candidates whose partial
score and remaining bounds still reach the threshold. Vectors are dense, so a posting is stored as its dimension's column, and membership as
bits by sign. Shards of a group raise each other's threshold; a window merges the groups.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import bound_batches

#: Bytes of a shard's components (long) and vectors in it at most; bytes of the shards of a group, and of the queries of a block, at most;
#: terms that are probed at a time.
SHARD_BYTES, SHARD, GROUP_BYTES, BLOCK_BYTES, PROBE = 4 << 20, 8192, 256 << 20, 2 << 20, 8


def integer_vectors(vectors: DataFrame, factor: float = 64.0) -> DataFrame:
    """vec_id and floor(factor * component) as long; rows with a null id, a null vector or a null or non-finite component are left out."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return usable.select(F.col("vec_id").cast("long"), F.transform(x, lambda v: F.floor(v.cast("double") * factor)).alias("v"))


class Best:
    """The k best of a query so far: score descending, then id ascending."""

    __slots__ = ("ids", "k", "scores")

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def threshold(self) -> float:
        return self.scores[-1] if len(self.scores) == self.k else -math.inf

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]


class Shard:
    """Postings by column, each vector's membership by sign, and the largest component of each signed term. traversed and probed count the
    postings' entries that searches added up, essential and other."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, exact: type):
        self.ids, self.columns = ids, np.ascontiguousarray(m.T).astype(exact)
        self.up, self.down = np.maximum(m.max(0, initial=0), 0), np.maximum((-m).max(0, initial=0), 0)
        self.above, self.below = np.packbits(self.columns > 0, axis=1), np.packbits(self.columns < 0, axis=1)
        self.traversed = self.probed = 0

    def search(self, own: int, q: np.ndarray, best: Best) -> None:
        """Adds to best what of this shard belongs there; rows with the query's own id never do."""
        bound = np.where(q > 0, q * self.up, -q * self.down)
        order = np.argsort(-bound, kind="stable")
        left = np.concatenate([bound[order][::-1].cumsum()[::-1], [0]])  # what the terms from a place on can give together
        threshold = best.threshold
        # A vector that ties with the k-th may have the smaller id, so only terms that stay under the threshold together aren't essential.
        split = int(np.searchsorted(-left, -threshold, side="right")) if threshold > 0 else len(order)
        if split == 0 and threshold > 0:
            return  # not even all bounds together reach the threshold
        essential = order[: min(split, len(order))]
        weight = q.astype(self.columns.dtype)
        score = weight[essential] @ self.columns[essential] if len(essential) else np.zeros(len(self.ids), self.columns.dtype)
        self.traversed += len(essential) * len(self.ids)
        reach = score + left[len(essential)] >= threshold
        if len(essential) < len(order):
            up, down = essential[q[essential] > 0], essential[q[essential] < 0]
            member = np.bitwise_or.reduce(self.above[up], axis=0) | np.bitwise_or.reduce(self.below[down], axis=0)
            reach &= np.unpackbits(member, count=len(self.ids)).astype(bool)
        alive = np.flatnonzero(reach)
        score = score[alive]
        for at in range(len(essential), len(order), PROBE):
            if not len(alive):
                return
            some = order[at : at + PROBE]
            score = score + weight[some] @ self.columns[np.ix_(some, alive)]
            self.probed += len(some) * len(alive)
            reach = score + left[min(at + PROBE, len(order))] >= threshold
            alive, score = alive[reach], score[reach]
        ids = self.ids[alive]
        other = ids != own
        ids, score = ids[other], score[other].astype(np.int64)
        if len(score) > best.k:  # ties with the k-th stay
            top = score >= np.partition(score, len(score) - best.k)[len(score) - best.k]
            ids, score = ids[top], score[top]
        best.add(ids, score)


RESULT = "query_id long, vec_id long, score long"


def search_group(queries: pa.Table, shards: pa.Table, k: int) -> pa.Table:
    """The k best of a group of shards for each query of a block."""
    out_q, out_v, out_s = [], [], []
    size = max([*queries.column("size").to_pylist(), *shards.column("size").to_pylist(), 1])

    def matrix(row: dict) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(row["ids"], np.int64)
        m = np.frombuffer(row["m"], np.int64).reshape(len(ids), row["size"])
        return ids, np.pad(m, ((0, 0), (0, size - row["size"])))

    asked = [matrix(r) for r in queries.select(["ids", "m", "size"]).to_pylist()]
    largest = max((np.abs(m).max(initial=0) for _, m in asked), default=0)
    best = {}
    for row in shards.select(["ids", "m", "size"]).to_pylist():
        ids, m = matrix(row)
        top = float(largest) * float(np.abs(m).max(initial=0)) * size
        shard = Shard(ids, m, np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64)
        for b, (qs, qm) in enumerate(asked):
            for i, (own, q) in enumerate(zip(qs.tolist(), qm)):
                shard.search(own, q, best.setdefault((b, i), Best(k)))
    for (b, i), found in best.items():
        out_q.append(np.full(len(found.ids), asked[b][0][i]))
        out_v.append(found.ids)
        out_s.append(found.scores)
    join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
    return pa.table({"query_id": join(out_q), "vec_id": join(out_v), "score": join(out_s)})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors with the largest inner products for each query, ties to the smaller id; all, where there
    are fewer. Both inputs have vec_id and v (array of long), and other columns are ignored; shorter vectors count as filled up with zeros. A
    row with the query's own id is never in its result. Repeated rows are results each; queries that share an id are all asked, and the k best
    of their results together count. An empty table gives no rows. Blocks of queries meet groups of shards; both are dealt by row number,
    whatever ids repeat, and hold a bounded number of bytes, so each task holds one of either, whatever the sizes of the tables."""
    spark = vectors.sparkSession
    bound_batches(spark)
    count = lambda df: df.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    (n_vectors, width), (n_queries, query_width) = count(vectors), count(queries)
    row_bytes = 8 * max(width, query_width, 1)
    shard = max(1, min(SHARD, SHARD_BYTES // row_bytes))
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = max(1, -(-n_queries * row_bytes // BLOCK_BYTES))
    n_groups = max(1, min(-(-parallel // n_blocks), -(-n_vectors // 1024)), -(-n_vectors * row_bytes // GROUP_BYTES))
    n_shards = max(n_groups, -(-n_vectors // shard))
    schema = "ids binary, m binary, size int"

    def gather(table: pa.Table) -> pa.Table:
        values, ids = table.column("v").combine_chunks(), table.column("vec_id").to_numpy()
        lengths, flat = values.value_lengths().to_numpy(zero_copy_only=False), values.flatten().to_numpy()
        size = int(lengths.max(initial=0))
        m = np.zeros((len(ids), size), np.int64)
        m[np.arange(size) < lengths[:, None]] = flat
        return pa.table({"part": table.column("part").slice(0, 1), "ids": pa.array([ids.tobytes()], pa.binary()), "m": pa.array([m.tobytes()], pa.binary()), "size": pa.array([size], pa.int32())})

    def dealt(df: DataFrame, parts: int) -> DataFrame:
        part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).alias("part")
        return df.select(part, "vec_id", "v").groupBy("part").applyInArrow(gather, f"part long, {schema}")

    shards, blocks = dealt(vectors, n_shards), dealt(queries, n_blocks)
    left = blocks.withColumn("block", F.col("part")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    right = shards.withColumn("g", (F.col("part") % n_groups).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    pairs = left.groupBy("block", "g").cogroup(right.groupBy("block", "g")).applyInArrow(lambda a, b: search_group(a, b, k), RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.filter("vec_id % 20 = 0"))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
