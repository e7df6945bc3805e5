"""Exact vector ranking by blocks, places without sorting, and fusion that stops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import fusion, retrieval, vectors


@pytest.fixture(scope="module")
def rows():
    """Clusters, equal vectors, short ones, zeros, missing and broken ones."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    out = [(i, (centres[i % 12] + 0.05 * rng.normal(size=8)).tolist()) for i in range(1500)]
    out += [(1500 + i, [1.0, 0.0]) for i in range(300)]  # one direction, more than a block
    return out + [(1900, None), (1901, []), (1902, [0.0] * 8), (1903, [float("nan")] * 8), (1904, [1e-300] + [0.0] * 7), (1905, [None, 1.0])]


@pytest.fixture(scope="module")
def asked():
    rng = np.random.default_rng(6)
    return [(i, rng.normal(size=8).tolist()) for i in range(9)] + [(100, [1.0, 0.0]), (101, None), (102, [0.0] * 8)]


def cosines(rows, asked):
    """Score by (question, key), as the definition has it."""
    return {(q, k): round(float(vectors.unit(v, 8) @ vectors.unit(x, 8)), 9) + 0.0 for q, v in asked for k, x in rows}


def ranking(scores, q):
    return sorted((k for p, k in scores if p == q), key=lambda k: (-scores[q, k], k))


@pytest.fixture(scope="module")
def blocks(spark, rows):
    return vectors.vector_blocks(spark.createDataFrame(rows, "key long, vector array<double>").repartition(3))


@pytest.mark.parametrize(("k", "slice_"), [(1, 2048), (7, 5), (400, 2048)])
def test_nearest(spark, rows, asked, blocks, monkeypatch, k, slice_):
    monkeypatch.setattr(vectors, "SLICE", slice_)
    report = {}
    found = vectors.nearest(blocks, spark.createDataFrame(asked, "qid long, vector array<double>"), k, report)
    scores = cosines(rows, asked)
    got = {}
    for r in found.orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["key"])
    assert got == {q: ranking(scores, q)[:k] for q, _ in asked}
    assert report["multiplied"] < report["pairs"] if k < 400 else report["pairs"] > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_places(spark, rows, asked, blocks):
    scores, rng, report = cosines(rows, asked), np.random.default_rng(7), {}
    pairs = [(q, int(k)) for q, _ in asked for k in rng.choice([k for k, _ in rows], 12, replace=False)] + [(0, 1902), (0, 1900), (101, 5)]
    got = vectors.places(blocks, spark.createDataFrame(asked, "qid long, vector array<double>"), spark.createDataFrame(pairs, "qid long, key long"), report)
    where = {q: {k: i for i, k in enumerate(ranking(scores, q))} for q, _ in asked}
    assert {(r["qid"], r["key"]): r["rank0"] for r in got.collect()} == {(q, k): where[q][k] for q, k in pairs}
    assert report["multiplied"] < report["pairs"]


def test_nothing(spark, blocks):
    none = spark.createDataFrame([], "qid long, vector array<double>")
    assert vectors.nearest(blocks, none, 3).count() == 0
    empty = vectors.vector_blocks(spark.createDataFrame([], "key long, vector array<double>"))
    assert vectors.nearest(empty, spark.createDataFrame([(1, [1.0])], none.schema), 3).count() == 0


def test_better_counts():
    rng = np.random.default_rng(8)
    for _ in range(200):
        c = sorted({(float(s), int(o)) for s, o in rng.integers(0, 5, (6, 2))})
        s, o = rng.integers(0, 5, 30).astype(float), rng.integers(0, 5, 30)
        want = [sum((a, b) < x for a, b in zip(s.tolist(), o.tolist())) for x in c]
        assert vectors.better(np.array([x for x, _ in c]), np.array([x for _, x in c]), s, o).tolist() == want


@pytest.mark.parametrize("k", [1, 4])
def test_fusion_is_the_whole_one(spark, monkeypatch, k):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 9)))) for i in range(400)]
    vecs = [(i, rng.normal(size=4).tolist() if i % 3 else None) for i in range(400)]
    asked = [(q, " ".join(rng.choice(words, 3))) for q in range(6)] + [(50, "nothing"), (51, None)]
    qvecs = [(q, rng.normal(size=4).tolist()) for q, _ in asked[:-1]] + [(51, None)]
    monkeypatch.setattr(vectors, "SLICE", 3)
    questions, table = spark.createDataFrame(asked, "q long, text string"), spark.createDataFrame(docs, "key long, text string")
    index, qv = retrieval.build_index(table, "key", F.col("text")), spark.createDataFrame(qvecs, "qid long, vector array<double>")
    passages = spark.createDataFrame(vecs, "key long, vector array<double>")
    got = fusion.hybrid_passages(index, questions, "q", "text", vectors.vector_blocks(passages), qv, k).collect()
    dense = retrieval.dense_scores(passages, qv)
    whole = dense.select("qid", "key", "ord").join(retrieval.keyword_scores(index, questions, "q", "text").select("qid", "key", "score"), ["qid", "key"], "left").fillna(0.0, "score")
    want = retrieval.fused(whole, dense, k).collect()
    plain = lambda found: sorted((r["qid"], r["rank"], r["key"], round(r["score"], 9), round(r["keyword_score"], 6)) for r in found)
    assert plain(got) == plain(want) and len(got) == 8 * k


def test_depth_is_enough():
    for k in (1, 4, 10):
        d = fusion.depth(k)
        assert 2 / (60 + d) < 1 / (60 + k - 1) <= 2 / (60 + d - 1)
