import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from corpusmill.llm import packing

FILE = P.path("byte_bpe_50k.json")


@pytest.mark.parametrize("weights", [[5, 1, 1], [1, 1, 1], [1 << 20, 3, 7]])
def test_due_order_is_an_order(weights):
    sizes = np.array([7, 3, 0 if weights[0] == 1 else 5])
    places = [packing.due_order(q, np.arange(n), sizes, np.array(weights)).tolist() for q, n in enumerate(sizes)]
    assert sorted(x for p in places for x in p) == list(range(int(sizes.sum()))) and all(p == sorted(p) for p in places)


@pytest.mark.parametrize("weights", [[5, 1, 1], [3, 7, 2], [1, 1, 1, 1]])
def test_due_order_is_deficit_round_robin(weights):
    """Queues with deficits, a quantum in proportion to the weight each round: the same order, also once queues run dry."""
    sizes, cost = [9, 4, 6, 2][: len(weights)], 2 * math.lcm(*weights)
    deficit, left, dealt = [cost // 2] * len(weights), list(sizes), []
    while any(left):
        for i, w in enumerate(weights):
            deficit[i] += w
            if left[i] and deficit[i] >= cost:
                dealt.append((i, sizes[i] - left[i]))
                deficit[i] -= cost
                left[i] -= 1
    for q, n in enumerate(sizes):
        places = packing.due_order(q, np.arange(n), np.array(sizes), np.array(weights)).tolist()
        assert [dealt[p] for p in places] == [(q, k) for k in range(n)]


def test_ids_are_those_of_the_library():
    rng, t, mine = random.Random(4), Tokenizer.from_file(FILE), packing.Tokenizer(FILE, P.PATTERN)
    parts = ["a", "Zeit", " ", "  ", "\n", "é", "漢", "123", "'ll", "<|endoftext|>", "<|endof", "|>", "\x00", "\u2028", "🙂", "_-_"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert mine(text) == t.encode(text, add_special_tokens=False).ids, text


def test_null_ids_and_columns_of_other_names(spark):
    df = spark.createDataFrame([(None, "a b", "x", 1), (1, None, None, 2), (1, "a b", "x", 3)], "doc_id long, text string, source string, start int")
    rows = packing.pack(df.selectExpr("*", "5 part", "6 queue", "7 base", "8 n", "9 ids"), FILE, P.PATTERN).collect()
    assert sorted((r["doc_id"] or 0, r["doc_tokens"]) for r in rows) == [(0, 3), (1, 1), (1, 3)]


def check(rows, ids, window):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts, n in [(p, len(ids[d])) for d, p in pieces.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert n is None or at == n
    full = [sum(n for _, n in s) for _, s in sorted(sequences.items())]
    assert set(pieces) == set(ids) and all(n == window for n in full[:-1]) and list(sequences) and sorted(sequences) == list(range(len(sequences)))


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0}])
def test_pack(spark, awkward, weights):
    texts = [*awkward, "x <|endoftext|> y<|endoftext|>"]
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in enumerate(texts)}
    df = spark.createDataFrame([(i, x, [None, "a", "b"][i % 3], 5) for i, x in enumerate(texts)], "doc_id long, text string, source string, length int").repartition(3)
    check(packing.pack(df, FILE, P.PATTERN, weights, 64, 16).collect(), ids, 64)
    assert packing.pack(df.limit(0), FILE, P.PATTERN).count() == 0


def test_windows_follow_the_target(spark):
    df = spark.createDataFrame([(i, "word " * 400, "big" if i % 4 else "small") for i in range(80)], "doc_id long, text string, source string")
    rows = packing.pack(df, FILE, P.PATTERN, None, 256, 32).collect()
    by = defaultdict(Counter)
    for r in rows:
        by[r["sequence_id"]][r["source"]] += r["length"]
    assert all(abs(c["small"] / 256 - 0.25) <= 32 / 256 for s, c in by.items() if s < len(by) - 2)


def test_many_queues(spark, monkeypatch):
    monkeypatch.setattr(packing, "QUEUES", 2)
    df = spark.createDataFrame([(i, f"text {i}", f"s{i}") for i in range(12)], "doc_id long, text string, source string")
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    check(packing.pack(df, FILE, P.PATTERN, None, 16, 4).collect(), {i: np.array([*t.encode(f"text {i}", add_special_tokens=False).ids, 1], "<u4") for i in range(12)}, 16)


def test_weights_of_shared_queues(spark, monkeypatch):
    monkeypatch.setattr(packing, "QUEUES", 2)
    df = spark.createDataFrame([(i, "word " * 200, f"s{i}") for i in range(8)], "doc_id long, text string, source string")
    queue = {r["source"]: r["q"] for r in df.selectExpr("source", "pmod(xxhash64(source), 2) q").collect()}
    mine = [s for s in queue if queue[s] == queue["s0"]]
    assert len(mine) < 8
    by = Counter()
    for r in packing.pack(df, FILE, P.PATTERN, {"s0": 4000.0}, 64, 16).collect():
        by[queue[r["source"]] == queue["s0"], r["sequence_id"] < 3 * len(mine)] += r["length"]
    assert by[True, True] > 0.95 * (by[True, True] + by[False, True])
