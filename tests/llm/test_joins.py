import hashlib
import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import components, jaccard, substring, topk, wordhash

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_top(rows, k=20):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % 20 == 0}):
        scored = sorted((-sum(x * y for x, y in zip(a, v)), i) for p, a in ok if p == q for i, v in ok if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e4])
def test_top_k(spark, scale):
    rng = random.Random(7)
    pick = lambda: rng.choice([-0.5, -0.25, 0.0, 0.25, 0.5, rng.uniform(-1, 1)]) * scale
    rows = [(i, [pick() for _ in range(8)]) for i in range(300)]
    rows += [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [float("inf")] + [0.0] * 7), (None, [0.1] * 8), (304, rows[0][1]), (304, rows[0][1]), (40, rows[7][1]), (320, [0.0] * 8), (305, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    v = topk.integer_vectors(df)
    import numpy as np

    exact = [(i, None if x is None else [None if c is None else float(np.float32(c)) for c in x]) for i, x in rows]
    got = sorted(tuple(r) for r in topk.top_k(v, v.filter("vec_id % 20 = 0")).collect())
    assert got == plain_top(exact)
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0
    few = v.filter("vec_id in (0, 1, 2)")
    assert topk.top_k(few, few.filter("vec_id = 0")).count() == 2


def test_shards_probe_only_what_competes():
    import numpy as np

    rng = np.random.default_rng(5)
    m = np.floor(64 * rng.normal(size=(4000, 64)) * np.linspace(3, 0.02, 64)).astype(np.int64)
    shard, plain = topk.Shard(np.arange(4000), m, np.float64), m @ m.T
    for own in range(0, 4000, 400):
        best = topk.Best(20)
        best.add(np.arange(5000, 5020), np.sort(np.delete(plain[own], own))[-20:] - 1)  # a threshold from another shard
        shard.search(own, m[own], best)
        want = sorted((-s, i) for i, s in enumerate(plain[own].tolist()) if i != own)[:20]
        assert [(int(-s), int(i)) for i, s in zip(best.ids, best.scores) if i < 4000][:5] == want[:5]
    every = 10 * 64 * 4000
    assert shard.traversed < every / 2 and 0 < shard.probed < every / 10


def plain_repeats(texts, window):
    words = [wordhash.WORD.findall(t or "") for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        left = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_windows(spark, awkward, seed):
    rng = random.Random(seed)
    texts = list(awkward[:5]) + awkward[7:] + [" ".join(rng.choice("abcd") for _ in range(rng.randrange(40))) for _ in range(60)] + ["a " * 30, "a b " * 12, "u v w x y z\tq"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    rows = sorted((r["doc_id"], (r["n_words"], r["n_removed"], r["kept_sha256"])) for r in substring.remove_repeats(df, window=6, anchor=3).collect())
    assert [v for _, v in rows] == plain_repeats(texts, 6)


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (None, other), (2, "short"), (2, other + " tail")], "doc_id long, text string")
    rows = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.remove_repeats(df).collect()), key=str)
    assert rows == sorted([(1, 40, 40), (1, 40, 40), (None, 40, 40), (2, 1, 0), (2, 41, 40)], key=str)
    assert substring.remove_repeats(df.limit(0)).count() == 0


def test_many_equal_rows_and_one_hot_anchor(spark):
    same = " ".join(f"w{i}" for i in range(300))
    line = " ".join(f"common{i}" for i in range(14))
    hot = [" ".join([*(f"a{k}x{i}" for i in range(15)), line, *(f"b{k % 40}x{i}" for i in range(22))]) for k in range(400)]
    texts = [same] * 2000 + hot
    df = spark.createDataFrame([(7 if t == same else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = [tuple(r) for r in substring.remove_repeats(df).collect()]
    want = plain_repeats(texts, 35)
    assert sorted(rows) == sorted((7 if t == same else i, *w) for i, (t, w) in enumerate(zip(texts, want)))


def test_sketches_never_count_less(spark):
    texts = [" ".join(f"w{(i * 7 + k) % 900}" for k in range(120)) for i in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    count = Counter(a for t in texts for a in substring.runs_by_anchor(wordhash.hashes_of(wordhash.words_of(t)))[2].tolist())
    import numpy as np

    for slice_bits in (0, 3):
        held, bits = substring.repeated_cells(substring.sketch(df, substring.WINDOW, substring.ANCHOR, slice_bits))
        anchors = np.array(list(count), np.uint64)
        inside = np.ones(len(anchors), bool)
        for row in substring.cells(anchors, slice_bits):
            at = substring._places(row, bits)
            inside &= (held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        assert all(i for i, n in zip(inside, count.values()) if n > 1)
        assert sum(inside) < len(count) or min(count.values()) > 1


def test_drop_repeats_leaves_the_rest_alone(spark):
    passage = " ".join(f"p{i}" for i in range(35))
    df = spark.createDataFrame([(1, f"My  own\nstart {passage} end.", "x", 5), (2, f"{passage}\n\nOther", "y", 5), (3, "Clean  text\n", "z", 5)], "doc_id long, text string, source string, n_chars long")
    rows = {r["doc_id"]: (r["text"], r["n_chars"]) for r in substring.drop_repeats(df).collect()}
    assert rows == {1: ("My  own\nstart end.", 18), 2: ("Other", 5), 3: ("Clean  text\n", 12)}
    clashing = df.select("*", *[F.lit(7).alias(c) for c in ("key", "id", "kept", "n_words", "marks", "anchors", "again")])
    out = substring.drop_repeats(clashing)
    assert out.columns == clashing.columns and {(r["key"], r["kept"], r["n_words"]) for r in out.collect()} == {(7, 7, 7)}
    near = jaccard.keep_representatives(clashing)
    assert near.columns == clashing.columns and near.count() == 2


def plain_components(texts, size=5):
    sets = []
    for t in texts:
        w = wordhash.WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(seed):
    rng, texts = random.Random(seed), []
    passage = " ".join(f"p{i}" for i in range(30))
    for g in range(8):
        base = [f"g{g}w{rng.randrange(50)}" for _ in range(rng.randrange(8, 60))]
        for _ in range(rng.randrange(1, 14)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(99)}"
            texts.append(" ".join(w[: rng.randrange(max(5, len(w) - 6), len(w) + 1)]))
    texts += [f"{passage} {' '.join(f's{i}x{j}' for j in range(rng.randrange(3, 14)))}" for i in range(25)]
    return texts


@pytest.mark.parametrize(("seed", "long_list"), [(1, 48), (2, 3), (3, 2)])
def test_jaccard_components(spark, awkward, seed, long_list):
    """Short lists and long ones: with few members allowed, hubs and leftovers do all the work."""
    texts = list(awkward[:5]) + awkward[7:] + near_copies(seed) + ["Same Text HERE", "one two", "ONE two", "É É É É É", "é é é é é"]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, component_id int").repartition(3)
    rows = sorted(tuple(r) for r in jaccard.similar_documents(df, long_list=long_list, often=2, frequent=5).collect())
    assert [(n, c) for _, n, c in rows] == plain_components(texts)


def test_jaccard_similar_sets_in_neighbouring_bands(spark):
    """No hub has anything to compare in the first round; the two short texts, of 31 and 32 shingles, are similar all the same."""
    passage = " ".join(f"p{i}" for i in range(34))
    texts = [f"{passage} a0", f"{passage} b0 b1", *(f"{passage} {' '.join(f'l{n}x{j}' for j in range(n))}" for n in (40, 90, 180, 360, 720))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(tuple(r) for r in jaccard.similar_documents(df, long_list=2, often=99).collect())
    assert [(n, c) for _, n, c in rows] == plain_components(texts) and rows[1][2] == 0


def test_jaccard_awkward_rows(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (3, "A B C D E F"), (None, "a b c d e f"), (None, "unique words only here"), (9, None)], "doc_id long, text string")
    rows = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.similar_documents(df).collect()), key=str)
    assert rows == sorted([(5, 3), (5, 3), (3, 3), (None, 3), (None, None), (9, 9)], key=str)
    assert jaccard.similar_documents(df.limit(0)).count() == 0
    kept = sorted((str(r["doc_id"]) for r in jaccard.keep_representatives(df).collect()))
    assert kept == ["3", "9", "None", "None"]


def test_components_of_long_chains(spark):
    rng = random.Random(1)
    nodes = list(range(60))
    rng.shuffle(nodes)
    edges = list(itertools.pairwise(nodes[:40])) + [(nodes[40], nodes[41]), (nodes[41], nodes[40]), (nodes[42], nodes[42])]
    rows = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {rows[n] for n in nodes[:40]} == {min(nodes[:40])} and rows[nodes[40]] == rows[nodes[41]] and nodes[42] not in rows


@pytest.mark.parametrize("kind", ["rising", "zigzag", "tree"])
def test_components_take_few_rounds(spark, kind):
    """Tables written by round: hooks, roots by doubling, labels, edges."""
    from corpusmill.llm.runtime import recorded

    n = 10_000 if kind == "rising" else 1000
    edge = {"rising": "id a, id + 1 b", "zigzag": f"case when id % 2 = 0 then id / 2 else {n} + id end a, case when id % 2 = 0 then {n} + id + 1 else (id + 1) / 2 end b", "tree": "id + 1 a, cast((id * 7919 + 13) % (id + 1) as long) b"}[kind]
    folders: list[str] = []
    with recorded(folders):
        rows = components.components(spark.range(n).selectExpr(edge.split(" a,")[0] + " as a", edge.split(" a,")[1].rsplit(" b", 1)[0] + " as b").selectExpr("cast(a as long) a", "cast(b as long) b"))
    got = rows.groupBy("component").count().collect()
    assert len(got) == 1 and got[0][0] == rows.agg({"node": "min"}).first()[0]
    assert sum("/edges-" in f for f in folders) <= 6 and sum("/roots-" in f for f in folders) <= 20


def test_word_runs_hash_by_content():
    h = wordhash.hashes_of(wordhash.words_of("a b c x a b c"))
    runs = wordhash.Runs(h, wordhash.BASE_A).all(3)
    assert runs[0] == runs[4] and len(set(runs.tolist())) == 4
    assert wordhash.words_of("a\x1cb c\x0bd") == ["a\x1cb c".encode(), b"d"]


def test_marks_have_a_bound(spark):
    from corpusmill.llm.runtime import marked

    df = spark.range(1000).toDF("k")
    got = marked(df, F.col("k"), spark.range(0, 1000, 7).toDF("k"))
    assert got.filter("k % 7 = 0 and not _marked").count() == 0 and got.filter("_marked").count() < 200
