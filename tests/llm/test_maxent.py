import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import maxent
from corpusmill.llm.runtime import remainder

SF = "/root/testdata/sf0.01"


def tokens_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + ["\n"]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def plain(docs):
    """(doc_id, held out, tokens, known, tokens learnt from, base score) of each row, by the definition."""
    counts = Counter(t for d, x in docs if not held_out(d) for t in tokens_of(x))
    n, v = sum(counts.values()), len(counts)
    base = lambda x: sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in x)
    return [(d, held_out(d), len(t := tokens_of(x)), sum(counts[w] > 0 for w in t), n, base(t)) for d, x in docs]


def same(got, want):
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], abs=1e-6)


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = maxent.op13_maxent(spark, SF).collect()
    same(rows, plain(docs))
    for held in (True, False):
        mine = [r for r in rows if r["held_out"] is held]
        total = sum(r["n_tokens"] for r in mine)
        assert sum(r["score"] for r in mine) / total > sum(r["base_score"] for r in mine) / total + 0.2
    assert all(r["score"] <= 0 for r in rows)


def score(df, **k):
    return maxent.score_documents(df, remainder(F.col("doc_id"), 5) == 1, **k)


@pytest.mark.parametrize("size", [1, 50, 1 << 20])
def test_awkward_documents(spark, awkward, monkeypatch, size):
    """Whatever the size of blocks and slices."""
    monkeypatch.setattr(maxent, "SLICE", 1 << 3 if size == 50 else 1 << 19)
    docs = [(i, t) for i, t in enumerate(awkward)] + [(None, "null id"), (3, "one"), (3, None), (10**15, "ALPHA Été alpha\x0bbeta\x1f")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, held string, block int").repartition(3)
    rows = score(df, size=size).collect()
    same(rows, plain(docs))
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
    alike = {}
    for r in rows:
        alike.setdefault((r["n_tokens"], r["base_score"]), set()).add(r["score"])
    long_ = [s for (n, _), s in alike.items() if n > 10_000]
    assert len(long_) == 1 and len(long_[0]) == 1  # equal texts score alike
    assert score(df.limit(0)).count() == 0


def test_nothing_to_learn_from(spark):
    ids = [i for i in range(60) if held_out(i)]
    rows = score(spark.createDataFrame([(i, "some words" * (i % 3)) for i in ids], "doc_id long, text string")).collect()
    assert len(rows) == len(ids) and all((r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (0, 0, 0, 0) for r in rows)


def test_probabilities_add_up_to_one():
    """Over all known words and the unknown one, in any place, whatever the weights."""
    rng = np.random.default_rng(1)
    counts, classes = rng.integers(1, 30, 400), rng.integers(0, maxent.CLASSES - 1, 400)
    counts[:60] = 1
    classes[counts == 1] = maxent.RARE
    words = np.sort(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    heads = sorted(i for c in range(maxent.CLASSES) for i in sorted(np.flatnonzero(classes == c), key=lambda i: -counts[i])[: maxent.SLOTS - 1])
    slots = np.zeros(400, int)
    for c in range(maxent.CLASSES):
        mine = [i for i in heads if classes[i] == c]
        slots[mine] = range(1, len(mine) + 1)
    once = int((counts == 1).sum())
    v = maxent.Vocabulary(int(counts.sum()), 400, once, int((counts == 2).sum()), tuple(int(counts[classes == c].sum()) for c in range(maxent.CLASSES)), words[heads], classes[heads], slots[heads], counts[heads])
    levels = maxent.first_levels(v)
    for x in levels:
        x.weights[:] = rng.normal(size=x.weights.shape)
    every = lambda a, last: np.append(a, last)
    for a, b in ((maxent.BEFORE, maxent.BEFORE), (5, 9)):
        t = maxent.Tokens(np.array([0]), every(counts, 0).astype(np.uint64), every(classes, maxent.RARE).astype(np.uint8), every(slots, 0).astype(np.uint8), np.full(401, a, np.uint64), np.full(401, b, np.uint64))
        assert np.exp(maxent.log_probabilities(t, v, levels)).sum() == pytest.approx(1, abs=1e-9)


def test_gradient_by_finite_differences():
    """What a step adds up for a weight is the slope of the tokens' negative log-likelihood."""
    rng = np.random.default_rng(2)
    n, width = 40, 5
    rows, right = [rng.integers(0, 6, n).astype(np.uint16) for _ in range(3)], rng.integers(0, width, n)
    level = maxent.Level(rng.normal(size=(1, width)), np.zeros((maxent.BUCKETS, width)))
    level.weights[:6] = rng.normal(size=(6, width))
    loss = lambda: -level.log_probabilities(0, rows)[np.arange(n), right].sum()
    learner = maxent.Learner(level, width=0.0)
    slopes = np.zeros((6, width))
    for r, c in np.ndindex(6, width):
        level.weights[r, c] += 1e-5
        up = loss()
        level.weights[r, c] -= 2e-5
        slopes[r, c] = (up - loss()) / 2e-5
        level.weights[r, c] += 1e-5
    before = learner.squares[:6].copy()
    learner.step(0, rows, right)
    error = np.exp(level.log_probabilities(0, rows))
    error[np.arange(n), right] -= 1
    by_hand = sum(np.array([error[r == b].sum(0) for b in range(6)]) for r in rows)
    assert by_hand == pytest.approx(slopes, abs=1e-4)
    parts = sum(np.array([error[r == b].sum(0) for b in range(6)]) ** 2 for r in rows)
    assert learner.squares[:6] - before == pytest.approx(parts, rel=1e-3, abs=1e-4)
    assert learner.seen[:6].tolist() == [int(sum((r == b).sum() for r in rows)) for b in range(6)]


def plain_step(learner, group, rows, right):
    """A step as its definition has it: sums by feature over sorted tokens, and each token's largest value taken off before exp."""
    error = np.exp(learner.level.log_probabilities(group, rows))
    error[np.arange(len(right)), right] -= 1
    for r in rows:
        order = np.argsort(r, kind="stable")
        starts = np.flatnonzero(np.diff(r[order].astype(np.int32), prepend=-1))
        at, total = r[order[starts]], np.add.reduceat(error.take(order, 0), starts, axis=0)
        learner.squares[at] += total * total
        learner.level.weights[at] -= learner.width * total / np.sqrt(learner.squares[at])
        learner.seen[at] += np.diff(starts, append=len(r))


def test_a_step_gives_the_plain_result_in_less_time():
    """Of the 4,096 rows of a template, some 2,000 to 3,300 differ, about as many as in texts."""
    rng = np.random.default_rng(5)
    n, width, times = maxent.STEP, maxent.CLASSES + 1, {}
    mixed = lambda often: np.where(rng.random(n) < often, rng.integers(0, 50, n), rng.integers(0, maxent.BUCKETS, n)).astype(np.uint16)
    steps = [([mixed(0.5), mixed(0.15), mixed(0.5)], rng.integers(0, width, n)) for _ in range(10)]
    level = maxent.Level(np.log(np.full((1, width), 1 / width)), rng.normal(size=(maxent.BUCKETS, width)))
    learners = {f: maxent.Learner(level) for f in (maxent.Learner.step, plain_step)}
    np.empty(2 << 20).fill(0)  # as a task has freed larger arrays, whose memory malloc then keeps
    for _ in range(5):
        for step, learner in learners.items():
            begun = time.process_time()
            for rows, right in steps:
                step(learner, 0, rows, right)
            times.setdefault(step, []).append(time.process_time() - begun)
    new, plain = learners.values()
    assert new.level.weights == pytest.approx(plain.level.weights, abs=1e-3) and new.seen.tolist() == plain.seen.tolist()
    assert min(times[maxent.Learner.step]) < 0.7 * min(times[plain_step])


def test_probabilities_of_weights_however_large():
    rng = np.random.default_rng(6)
    rows, right = [rng.integers(0, 6, 50).astype(np.uint16) for _ in range(3)], rng.integers(0, 5, 50)
    for size in (1, 100, 1000):
        for kind in (np.float32, np.float64):
            level = maxent.Level(np.array([[0, -1, -np.inf, 2, 3]], kind), np.zeros((maxent.BUCKETS, 5), kind))
            level.weights[:6] = size * rng.normal(size=(6, 5))
            want = level.log_probabilities(0, rows)
            assert level.probabilities(0, rows) == pytest.approx(np.exp(want), rel=1e-4, abs=1e-7)
            assert level.log_probabilities_of(0, rows, right) == pytest.approx(want[np.arange(50), right], rel=1e-4, abs=1e-4)
    assert level.probabilities(0, [r[:0] for r in rows]).shape == (0, 5)


def test_distinct_words():
    rng = np.random.default_rng(7)
    for a in (rng.integers(0, 1 << 64, 1000, np.uint64), rng.integers(0, 50, 1000, np.uint64) << np.uint64(58), np.zeros(0, np.uint64)):
        for got, want in zip(maxent.distinct(a), np.unique(a, return_inverse=True)):
            assert got.tolist() == want.tolist()


def test_steps_learn_and_changes_average():
    rng = np.random.default_rng(3)
    level = maxent.Level(np.zeros((1, 4)), np.zeros((maxent.BUCKETS, 4)))
    x = rng.integers(0, 4, 20_000)
    rows, learner = [(x * 7).astype(np.uint16), np.zeros(len(x), np.uint16), np.ones(len(x), np.uint16)], maxent.Learner(level, width=0.5)
    for i in range(0, len(x), 500):
        learner.step(0, [r[i : i + 500] for r in rows], x[i : i + 500])
    new = maxent.averaged(level, learner.change() + learner.change())  # two tasks with the same change: their average is it
    p = np.exp(new.log_probabilities(0, [r[:100] for r in rows]))[np.arange(100), x[:100]]
    assert p.min() > 0.9 and new.weights[14] == pytest.approx(learner.level.weights[14], rel=1e-2)


def test_packed_arrays():
    rng = np.random.default_rng(4)
    for kind in (np.uint8, np.uint16, np.uint32, np.uint64):
        for n in (0, 1, 5, 1000):
            a = rng.integers(0, 200, n).astype(kind)
            assert maxent.opened(maxent.packed(a), kind).tolist() == a.tolist()
