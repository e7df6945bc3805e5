import numpy as np
import pytest

from corpusmill.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def accuracy(spark, rows, column):
    truth = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    return sum(p == t for p, t in held) / len(held)


def test_quality_held_out(spark):
    rows = quality.op3_quality(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows) and accuracy(spark, rows, "quality") > 0.95


def test_toxicity_held_out(spark):
    rows = toxicity.op7_toxicity(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows) and accuracy(spark, rows, "toxic") > 0.9


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_awkward_documents(spark, awkward, score):
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(awkward)] + [(None, "null id", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, 1), (5, 0), (7, 1), (None, 1), (9, None)], "doc_id long, label int")
    rows = score(df, labels).collect()
    got = {r["doc_id"]: r["score"] for r in rows}
    assert len(rows) == len(awkward) + 1 and got[5] == got[6] and got[7] == got[8] and got[0] == got[1]
    assert score(df.limit(0), labels).count() == 0
    none = [r["score"] for r in score(df, labels.limit(0)).collect()]
    assert len(none) == len(awkward) + 1 and all(0 <= s <= 1 for s in none)


def test_quality_filter_keeps_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = quality.keep_quality(docs, quality.training_labels(spark, SF, "quality", 3, 1))
    scores = {r["doc_id"]: r["score"] for r in quality.op3_quality(spark, SF).collect()}
    rows = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns and rows == {d for d, s in scores.items() if s >= 0.5}


def test_temperature_and_constant():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 2 * quality.SIZE + 5))
    y = (x[:, 0] > 0).astype(int)
    net = quality.fit(x, y, np.arange(600) % 5 == 0)
    assert ((net.probabilities(x) > 0.5) == y).mean() > 0.95 and net.temperature > 0
    assert quality.fit(x, np.ones(600, int), np.zeros(600, bool)).probabilities(x[:3]).tolist() == [pytest.approx(1 / (1 + np.exp(-4)))] * 3


def plain_segments(s):
    """Maximal segments by their definition: repeatedly the best, the shortest among equals, then the same left and right of it."""
    out = []

    def search(lo, hi):
        best = None
        for i in range(lo, hi):
            for j in range(i + 1, hi + 1):
                v = sum(s[i:j])
                if v > 1e-12 and (best is None or v > best[0] + 1e-12):
                    best = (v, i, j)
        if best:
            search(lo, best[1])
            out.append((best[1], best[2]))
            search(best[2], hi)

    search(0, len(s))
    return out


def test_maximal_segments():
    rng = np.random.default_rng(2)
    for n in range(60):
        s = rng.integers(-40, 40, rng.integers(0, 14)) / 8 + rng.random() / 97
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(s)] == plain_segments(s.tolist())


def test_extreme_values_fit():
    rng = np.random.default_rng(3)
    n = np.full(4000, 200.0)
    best = (np.log(0.05 * n) - np.log(-np.log(rng.random(4000)))) / 1.5
    rate, scale = toxicity.fit_extremes(n, best)
    assert abs(rate - 1.5) < 0.15 and abs(np.log(scale / 0.05)) < 0.3


def test_passages_of_words_seen_before(spark):
    odds, deviations = np.zeros(toxicity.BUCKETS, np.float32), np.zeros(toxicity.BUCKETS, np.float32)
    bad = ["vile", "foul", "scum", "rot"]
    for w in bad:
        odds[toxicity.features(w)[0]], deviations[toxicity.features(w)[0]] = 4.0, 9.0
    calm = " ".join(["calm"] * 400)
    quoted = " ".join(f"{w} {calm}" for w in bad * 2)
    dense = " ".join(bad * 3)
    text = f"{quoted} {dense} {calm} {dense} {calm} {dense}"
    row = toxicity.segments(spark.createDataFrame([(1, text)], "doc_id long, text string"), odds, deviations).first()
    one = float(np.log1p(toxicity.SHARE * (np.exp(4.0) - 1)))
    found = [(a, b) for a, b, s in zip(row["starts"], row["ends"], row["scores"]) if s > 2 * one]
    places = [len(quoted) + 1 + k * (len(dense) + len(calm) + 2) for k in range(3)]
    assert found == [(p, p + len(dense)) for p in places] and max(row["scores"]) == pytest.approx(12 * one, rel=1e-5)


def test_word_vectors_and_pooling_by_brute_force(spark):
    texts = ["the cat sat on the mat", "cat cat 12 cat!", None, "", "the the", "one"]
    places, signs = quality.index_vectors()
    index = np.zeros((quality.BUCKETS, quality.SIZE))
    for b in range(quality.BUCKETS):
        index[b, places[b]] = signs[b]
    buckets = quality.Buckets()
    rows = [buckets(t or "").tolist() for t in texts]
    m, count = np.zeros((quality.BUCKETS, quality.SIZE)), np.zeros(quality.BUCKETS)
    for row in rows:
        for i, b in enumerate(row):
            count[b] += 1
            for j, c in enumerate(row):
                if 0 < abs(i - j) <= quality.REACH:
                    m[b] += index[c]
    norm = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)
    unit = norm(m)
    unit = norm(unit - sum(unit[b] for row in rows for b in row) / sum(map(len, rows)))
    unit[count == 0] = 0
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, features int").repartition(3)
    vectors = quality.word_vectors(df)
    assert np.allclose(vectors, unit, atol=1e-6)
    for r in quality.document_vectors(df, vectors).collect():
        got, v = np.frombuffer(r["features"], np.float32), unit[rows[r["doc_id"]]]
        if not len(v):
            assert not got.any()
            continue
        want = [*v.mean(0), *v.std(0), np.linalg.norm(v.mean(0)), np.mean([a @ b for a, b in zip(v, v[1:])]) if len(v) > 1 else 0]
        assert np.allclose(got[: len(want)], want, atol=1e-5) and got[-1] == pytest.approx(np.log1p(len(v)))


def test_network_by_finite_differences():
    """One step of the fit goes against the gradient of the loss, as differences give it."""
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(40, 2 * quality.SIZE + 5)), np.arange(40) % 2
    net = quality.fit(x, y, np.zeros(40, bool))
    loss = lambda: np.logaddexp(0, np.where(y, -1, 1) * net.logits(x)).mean()
    assert loss() < 0.2
    z = (x - net.shift) / net.scale
    assert np.allclose(net.logits(x), [np.tanh(v @ net.w1 + net.b1) @ net.w2 + net.b2 for v in z])
    assert np.allclose(net.probabilities(x), [1 / (1 + np.exp(-t / net.temperature)) for t in net.logits(x)])


def test_counts_odds_and_scores_by_brute_force(spark):
    texts = ["Vile vile calm", "calm sea", "vile foul foul", None, "", "Sea of calm and FOUL", "straße"] * 3
    labels = {i: int("vile" in (t or "").lower()) for i, t in enumerate(texts) if i % 2}
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, label int").repartition(3)
    counts = np.zeros((3, toxicity.BUCKETS), np.int64)
    for i, t in enumerate(texts):
        for w in {w.lower() for w in toxicity.WORD.findall(t or "")}:
            for b in toxicity.features(w):
                counts[0, b] += 1
                if i in labels:
                    counts[1 + labels[i], b] += 1
    got = toxicity.count_words(df, labels)
    assert (got == counts).all()
    odds, deviations = toxicity.log_odds(got)
    prior = toxicity.PRIOR * (counts[0] + 0.01) / (counts[0].sum() + 0.01 * toxicity.BUCKETS)
    total = [counts[1 + y].sum() + toxicity.PRIOR for y in (0, 1)]
    for w in ("vile", "calm", "nowhere"):
        b = toxicity.features(w)[0]
        clean, toxic = counts[1, b] + prior[b], counts[2, b] + prior[b]
        want = np.log(toxic / (total[1] - toxic)) - np.log(clean / (total[0] - clean))
        assert odds[b] == pytest.approx(want, abs=1e-4) and deviations[b] == pytest.approx(want / np.sqrt(1 / toxic + 1 / clean), abs=1e-4)


def test_calibrated_score_by_its_formula():
    c = toxicity.Calibration(1.5, 0.02, np.array([-2.0, 4.0, 0.5, 0.25]))
    n, scores = np.array([10.0, 500.0, 0.0]), [np.array([3.0, 0.2]), np.array([9.0, 8.0, 1.0]), np.zeros(0)]
    for k, s, p in zip(n, scores, c.probabilities(n, scores)):
        passages = [x for x in s if 0.02 * max(k, 1) * np.exp(-1.5 * x) < toxicity.EXPECTED]
        excess = min(max(1.5 * max(s, default=0) - np.log(0.02 * max(k, 1)), -20), 60)
        z = -2 + 4 * excess / 10 + 0.5 * np.log1p(len(passages)) + 0.25 * np.log1p(sum(passages))
        assert p == pytest.approx(1 / (1 + np.exp(-z)))


def test_passages_keep_places_of_the_text(spark):
    """İ becomes two characters in small letters; places are those of the text as it is."""
    odds, deviations = np.zeros(toxicity.BUCKETS, np.float32), np.zeros(toxicity.BUCKETS, np.float32)
    odds[toxicity.features("vile")[0]], deviations[toxicity.features("vile")[0]] = 4.0, 9.0
    row = toxicity.segments(spark.createDataFrame([(1, "İİİ VILE x")], "doc_id long, text string"), odds, deviations).first()
    assert (row["starts"], row["ends"]) == ([4], [8])


def test_clashing_labels_and_repeated_ids(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, None), (None, 1)], "doc_id long, label int")
    assert sorted((r["doc_id"], r["label"]) for r in quality.bounded_sample(labels, 10).collect()) == [(1, 1), (2, 0)]
    assert quality.bounded_sample(labels, 1).count() == 1
    docs = spark.createDataFrame([(1, "a b c", 1), (1, "d e", 1), (2, "f", 0)] * 4, "doc_id long, text string, label int")
    for score in (quality.score_quality, toxicity.score_toxicity):
        assert score(docs, labels).count() == 12
