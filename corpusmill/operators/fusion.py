"""Reciprocal rank fusion that stops: only passages that can be among the first k are looked at, and their ranks are counted, not sorted for.

The k first of one ranking alone score 1 / (c + k - 1) at least. A passage that stands behind place 2 (c + k - 1) - c in both rankings scores less, so
the passages before that place in either are all that matter, however many there are. Their other rank is how many passages come before them there:
both are counted block by block, where passages and vectors lie; no row is made for each passage and question.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import RRF, reciprocal_rank
from ..storage import stored
from . import vectors
from .index import DIGITS, Asked, Index, ask, best_keyword_scores, keyword_scores, scan


def depth(k: int, constant: int = RRF) -> int:
    """How many places of either ranking hold all that can be among the k first of their fusion."""
    return 2 * (constant + k - 1) - constant + 1


def _slices(candidates: DataFrame, size: int) -> Iterator[list[tuple]]:
    """Rows of candidates(qid, key, ord, score) in lists of whole questions, size of them; candidates lie together by question."""
    out, ids = [], set()
    for r in candidates.repartition("qid").sortWithinPartitions("qid").toLocalIterator():
        if r["qid"] not in ids and len(ids) == size:
            yield out
            out, ids = [], set()
        ids.add(r["qid"])
        out.append((r["qid"], r["key"], r["ord"], r["score"]))
    if out:
        yield out


def keyword_places(asked: Asked, candidates: DataFrame, qid_type: str) -> DataFrame:
    """qid, key, rank0, score, ord: where candidates(qid, key, ord, score) stand among all passages by keyword score, from 0, ties by ord (both long).
    Places go by rounded scores, but score is as it was, as rounding twice may change its last digit. A candidate without a common term has score 0, as all such passages have. Each slice of questions is one pass over the passages."""
    spark, out = candidates.sparkSession, None
    whole = F.coalesce("score", F.lit(0.0))
    rounded = candidates.select("qid", "key", F.col("ord").cast("long").alias("ord"), F.round(whole, DIGITS).alias("score"), whole.alias("whole"))
    rounded = stored(rounded, "keyword-candidates")
    for part in _slices(rounded, vectors.SLICE):
        lists: dict[int, list[tuple[float, int]]] = {}
        for qid, _, order, score in part:
            lists.setdefault(qid, []).append((-score, order))
        shared = spark.sparkContext.broadcast({q: sorted(set(c)) for q, c in lists.items()})  # SLICE questions, twice the depth each

        def make(ids: list, shared=shared) -> tuple[Callable, Callable]:
            wanted = [(np.array([s for s, _ in c]), np.array([o for _, o in c], np.int64), np.zeros(len(c), np.int64)) for c in (shared.value[q] for q in ids)]

            def take(block: int, keys: list, orders: list, scores: np.ndarray) -> None:
                order, score = np.array(orders, np.int64), -np.round(scores, DIGITS) + 0.0
                for j, (s, o, n) in enumerate(wanted):
                    n += vectors.better(s, o, score[:, j], order)

            def end():
                return [q for q, w in zip(ids, wanted) for _ in w[1]], [x for w in wanted for x in w[1].tolist()], [x for w in wanted for x in w[2].tolist()]

            return take, end

        # Questions without a term that any passage has are counted too: their passages all have 0.
        ids = spark.createDataFrame([(q, "", 0.0) for q in lists], f"qid {qid_type}, term string, gain double")
        gains = asked.gains.where(F.col("qid").isin(list(lists))).select("qid", "term", "gain").unionByName(ids)
        counted = scan(replace(asked, gains=gains), asked.index.passages, f"qid {qid_type}, ord long, before long", make)
        mine = counted.groupBy("qid", "ord").agg(F.sum("before").alias("rank0"))
        out = mine if out is None else out.unionByName(mine)
    if out is None:
        out = rounded.select("qid", "ord", F.lit(0).cast("long").alias("rank0"))
    return rounded.join(out, ["qid", "ord"]).select("qid", "key", "rank0", F.col("whole").alias("score"), "ord")


def hybrid_passages(index: Index, questions: DataFrame, qid: str, text: str, blocks: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """qid, rank, key, score, keyword_score: the k first of the fusion of keyword and vector ranking over all passages; ties in keyword order. blocks:
    vector_blocks() of all passages by key; asked(qid, vector). Keys and orders are long."""
    d = depth(k)
    ids = questions.select(F.col(qid).alias("qid")).distinct()
    first = best_keyword_scores(index, questions, qid, text, d).select("qid", "key")
    short = ids.join(first.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left").where(F.coalesce("n", F.lit(0)) < d).select("qid")
    fill = short.crossJoin(F.broadcast(index.first(2 * d).select("key")))  # places that no hit takes: 2 d passages at most
    near = vectors.nearest(blocks, asked, d).select("qid", "key")
    keys = stored(first.unionByName(fill).unionByName(near).distinct(), "fusion-candidates")
    scores = keyword_scores(index, questions, qid, text, keys).select("qid", "key", "score")
    known = keys.join(index.passages.select("key", "ord"), "key").join(scores, ["qid", "key"], "left")
    words = keyword_places(ask(index, questions, qid, text), known, questions.schema[qid].dataType.simpleString()).withColumnRenamed("rank0", "kw_rank").withColumnRenamed("score", "keyword_score")
    dense = vectors.places(blocks, asked, keys).select("qid", "key", F.col("rank0").alias("dn_rank"))
    both = words.join(dense, ["qid", "key"]).withColumn("score", reciprocal_rank(F.col("kw_rank")) + reciprocal_rank(F.col("dn_rank")))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", DIGITS)), "kw_rank", "ord")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "rank", "key", "score", "keyword_score")
