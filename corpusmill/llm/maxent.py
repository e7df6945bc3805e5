"""Language model: hashed maximum entropy with word classes, beside exact counts of all words.

Tokens are hashed once and kept in blocks: per block its distinct words (64 bits of hash, in order), how often each occurs in documents that are
learnt from, what stands beside it, and its tokens as places in that list. Distinct words of all blocks meet in slices, ranges of hashes of bounded
size, which answer each block with the exact counts of its words and their classes. So a shuffle carries a word once a block, packed, and nothing
that grows with the vocabulary is broadcast.

The model takes a token's probability apart: its class, its slot in the class, and the word in the slot. A word's class is the kind of neighbour that
it has most surely more often than others have; the most frequent words of a class have slots of their own, all others share one, in proportion to
their counts. Words seen once form a class with all unknown words, split by Good and Turing's estimate. Class and slot are maximum-entropy models
over hashed features: the word before, the two before, and the word before that one alone (a skip). Tasks run gradient steps over their own blocks
and return what changed, which is averaged in proportion to how often each feature occurred; every document that is learnt from is used in one round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import bound_batches, discard, pack, remainder, stored, texts_of, tree_sum, unpack
from .wordhash import hashes_of

#: Tokens in a block (and those of one document, however long), and distinct words of blocks that meet in a slice on average.
BLOCK, SLICE = 1 << 20, 1 << 19
#: Classes of words seen twice or more, the class of all others, slots in a class (0: all words without one), kinds of neighbours.
CLASSES, SLOTS, KINDS = 16, 16, 16
RARE = CLASSES
#: Rows of weights at each level, templates of features, and rounds of training.
BUCKETS, TEMPLATES, ROUNDS = 1 << 15, 3, 2
#: Tokens of a step and of a batch that is scored, tokens that a training task works on at least, step width, and occurrences that a feature's
#: average counts in as unchanged.
STEP, BATCH, TASK_TOKENS, WIDTH, STILL = 4096, 1 << 14, 1 << 24, 0.2, 2.0
#: Averages are added up as whole multiples of this, so that no order of addition changes them.
UNIT, PARTS = 2.0**-14, 8
#: Sums of exponentials within these are exact enough in single precision as they are.
LEAST, MOST = 1e-25, 1e25
#: A space is in no word: the hash of the end, and what stands before a text.
END, BEFORE = xxhash.xxh3_64_intdigest(b" "), 1 << 16


def packed(a: np.ndarray) -> bytes:
    """An array of unsigned numbers as bytes, those of equal weight together; short ones as they are."""
    raw = b"".join((a >> a.dtype.type(8 * i)).astype(np.uint8).tobytes() for i in range(a.itemsize))
    return b"\0" + raw if len(raw) < 256 else b"\1" + pack(raw)


def opened(data: bytes, kind: type) -> np.ndarray:
    raw = data[1:] if data[0] == 0 else unpack(data[1:])
    planes = np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    a = planes[0].astype(kind)
    for i, plane in enumerate(planes[1:], 1):
        if plane.any():
            a |= plane.astype(kind) << kind(8 * i)
    return a


def distinct(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As np.unique(a, return_inverse=True), but only what is distinct is put in order."""
    found = pa.array(a).dictionary_encode()
    words = found.dictionary.to_numpy()
    order = np.argsort(words)
    places = np.empty(len(order), np.int64)
    places[order] = np.arange(len(order))
    return words[order], places[found.indices.to_numpy()]


BLOCKS = "block long, doc_ids array<long>, held array<boolean>, lengths array<long>, places binary, words binary, counts binary, beside binary, kinds array<long>, n_words long"


def kind_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(8)).astype(np.int64) & (KINDS - 1)


def block_of(docs: list[tuple], number: int) -> tuple:
    """A row of BLOCKS from (doc_id, held out, hashes of its words)."""
    ids, held, hashes = zip(*docs)
    lengths = np.array([len(h) + 1 for h in hashes])
    tokens = np.concatenate([x for h in hashes for x in (h, [np.uint64(END)])])
    words, places = distinct(tokens)
    learnt, doc = np.repeat(~np.array(held, bool), lengths), np.repeat(np.arange(len(docs)), lengths)
    counts = np.bincount(places[learnt], minlength=len(words))
    pair = learnt[1:] & (doc[1:] == doc[:-1])  # a token and the one before it, of one document
    kinds = kind_of(tokens)
    at = np.concatenate([places[1:][pair] * KINDS + kinds[:-1][pair], places[:-1][pair] * KINDS + kinds[1:][pair]])
    beside = np.bincount(at, minlength=len(words) * KINDS).reshape(-1, KINDS)
    return number, ids, held, lengths.tolist(), packed(places.astype(np.uint32)), packed(words), packed(counts.astype(np.uint32)), packed(beside.astype(np.uint32).ravel()), beside.sum(0).tolist(), len(words)


def blocks(docs: DataFrame, held_out, size: int = BLOCK) -> DataFrame:
    """docs(doc_id, text) in blocks, which tasks fill one after another; held_out: a column, true for what isn't learnt from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, waiting, tokens = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for doc_id, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch)):
                hashes = hashes_of(text.encode().lower().split())  # bytes.lower() changes A to Z alone
                waiting.append((doc_id, held, hashes))
                tokens += len(hashes) + 1
                if tokens >= size:
                    yield row(block_of(waiting, number))
                    number, waiting, tokens = number + 1, [], 0
        if waiting:
            yield row(block_of(waiting, number))

    def row(values: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[c.split()[0] for c in BLOCKS.split(", ")])

    long_list = pa.list_(pa.int64())
    kinds = (pa.int64(), long_list, pa.list_(pa.bool_()), long_list, *[pa.binary()] * 4, long_list, pa.int64())
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), held_out.alias("held"), "text").mapInArrow(run, BLOCKS)


MERGED = "slice int, block long, counts binary, classes binary, sums array<long>, tops array<struct<class:int,word:long,n:long>>"


def merged(table: DataFrame, slices: int, shares: np.ndarray) -> DataFrame:
    """Slices of all blocks' words, answered: for each slice and block the counts and classes of its words there, in order; and for each slice
    (block null) how many tokens, words, words seen once and twice and tokens of each class it has, and the most frequent words of each class.
    A slice gets each block's words once, so no word makes it larger than others; where blocks are many, a row holds few words, a plain shuffle
    at worst. shares: of all neighbours, those of each kind."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, counts, beside in zip(*(batch.column(i).to_pylist() for i in range(4))):
                words, counts, beside = opened(words, np.uint64), opened(counts, np.uint32), opened(beside, np.uint32).reshape(-1, KINDS)
                of = ((words >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)
                starts = np.flatnonzero(np.diff(of, prepend=-1))
                rows = [(int(of[a]), block, packed(words[a:b]), packed(counts[a:b]), packed(beside[a:b].ravel())) for a, b in zip(starts, [*starts[1:], len(of)])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), *[pa.binary()] * 3))], names=["slice", "block", "words", "counts", "beside"])

    def merge(t: pa.Table) -> pa.Table:
        of, named, words, counts, beside = (t.column(c).to_pylist() for c in ("slice", "block", "words", "counts", "beside"))
        words = [opened(x, np.uint64) for x in words]
        ends = np.cumsum([0, *map(len, words)])
        known, at = distinct(np.concatenate(words))
        n = np.bincount(at, np.concatenate([opened(x, np.uint32) for x in counts]), len(known)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        rows = np.concatenate([opened(x, np.uint32) for x in beside]).reshape(-1, KINDS)
        seen = np.add.reduceat(rows[order].astype(np.float64), np.flatnonzero(np.diff(at[order], prepend=-1)), axis=0)
        usual = seen.sum(1, keepdims=True) * shares
        classes = np.where(n > 1, ((seen - usual) / np.sqrt(usual + 0.1)).argmax(1), RARE).astype(np.uint8)
        tops = []
        for c in range(CLASSES):
            mine = np.flatnonzero(classes == c)
            for i in mine[np.lexsort((known[mine], -n[mine]))[: SLOTS - 1]].tolist():
                tops.append({"class": c, "word": int(known[i].astype(np.int64)), "n": int(n[i])})
        sums = [int(n.sum()), int((n > 0).sum()), int((n == 1).sum()), int((n == 2).sum()), *np.bincount(classes, n, CLASSES + 1).astype(np.int64).tolist()[:CLASSES]]
        answers = [(of[0], b, packed(n[at[i:j]].astype(np.uint64)), packed(classes[at[i:j]]), None, None) for b, i, j in zip(named, ends, ends[1:])]
        columns = zip(*answers, (of[0], None, None, None, sums, tops))
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in MERGED.split(", ")])

    top = pa.list_(pa.struct([("class", pa.int32()), ("word", pa.int64()), ("n", pa.int64())]))
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), top)
    bound_batches(table.sparkSession)
    pieces = table.select("block", "words", "counts", "beside").mapInArrow(cut, "slice int, block long, words binary, counts binary, beside binary")
    return pieces.groupBy("slice").applyInArrow(merge, MERGED)


@dataclass(frozen=True)
class Vocabulary:
    """Counts of the whole vocabulary: tokens, words, words seen once and twice; tokens of each class, and the words that have slots: their hashes
    in order, and the class, slot and count of each."""

    tokens: int = 0
    words: int = 0
    once: int = 0
    twice: int = 0
    mass: tuple[int, ...] = (0,) * CLASSES
    heads: np.ndarray = None
    classes: np.ndarray = None
    slots: np.ndarray = None
    counts: np.ndarray = None

    def unknown(self) -> float:
        """The share of unknown words in the class of rare ones: of such a word's next places as many as there are words seen once, against the
        two places of each word seen twice."""
        return (self.once + 0.5) / (self.once + 2 * self.twice + 1) if self.once else 1.0

    def shared(self) -> np.ndarray:
        """Tokens of each class whose words have no slot."""
        return np.array(self.mass) - np.bincount(self.classes, self.counts, CLASSES).astype(np.int64)


def vocabulary(answers: DataFrame) -> Vocabulary:
    """From merged(): one row of sums, and SLOTS - 1 words a class."""
    stats = answers.where("block IS NULL")
    sums = stats.agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(4 + CLASSES)]).first()
    place = F.row_number().over(Window.partitionBy("class").orderBy(F.col("n").desc(), "word"))
    top = stats.select(F.explode("tops").alias("t")).select("t.*").withColumn("slot", place).where(F.col("slot") < SLOTS).collect()
    top = sorted((r["word"] & (1 << 64) - 1, r["class"], r["slot"], r["n"]) for r in top)
    heads, classes, slots, counts = (np.array([t[i] for t in top], k) for i, k in enumerate((np.uint64, np.int64, np.int64, np.int64)))
    s = [x or 0 for x in sums]
    return Vocabulary(*s[:4], tuple(s[4:]), heads, classes, slots, counts)


CODED = "block long, doc_ids array<long>, held array<boolean>, lengths array<long>, places binary, marks binary, counts binary, classes binary, slots binary"


def coded(table: DataFrame, answers: DataFrame, v: Vocabulary) -> DataFrame:
    """Blocks whose words have their counts, classes and slots, and 16 bits of hash for features: all that a model needs of a text."""
    heads, slot = table.sparkSession.sparkContext.broadcast(v.heads), v.slots.astype(np.uint8)  # SLOTS - 1 a class

    def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, slots = [], []
            for data in batch.column(5).to_pylist():
                words = opened(data, np.uint64)
                at = np.minimum(np.searchsorted(words, heads.value), len(words) - 1)
                own = np.zeros(len(words), np.uint8)
                here = words[at] == heads.value
                own[at[here]] = slot[here]
                marks.append(packed((words >> np.uint64(16)).astype(np.uint16)))
                slots.append(packed(own))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(marks, pa.binary()), pa.array(slots, pa.binary())], names=[*batch.schema.names[:5], "marks", "slots"])

    def joined(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a):
            return a.select(CODED_NAMES[:6]).append_column("counts", pa.array([], pa.binary())).append_column("classes", pa.array([], pa.binary())).append_column("slots", pa.array([], pa.binary()))
        b = b.sort_by("slice")
        counts = np.concatenate([opened(x, np.uint64) for x in b.column("counts").to_pylist()])
        classes = np.concatenate([opened(x, np.uint8) for x in b.column("classes").to_pylist()])
        new = [a.column("slots")] + [pa.chunked_array([pa.array([packed(x)], pa.binary())]) for x in (counts, classes)]
        return pa.table([*(a.column(c) for c in CODED_NAMES[:6]), new[1], new[2], new[0]], names=CODED_NAMES)

    slimmed = table.select("block", "doc_ids", "held", "lengths", "places", "words").mapInArrow(slim, SLIM)
    replies = answers.where("block IS NOT NULL").select("slice", "block", "counts", "classes")
    return slimmed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(lambda a, b: joined(a, b), CODED)


CODED_NAMES = [c.split()[0] for c in CODED.split(", ")]
SLIM = "block long, doc_ids array<long>, held array<boolean>, lengths array<long>, places binary, marks binary, slots binary"


@dataclass
class Tokens:
    """A coded block: by token its count, class, slot, and the marks of the two tokens before it; where documents begin."""

    starts: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    slots: np.ndarray
    before: np.ndarray
    second: np.ndarray

    @classmethod
    def of(cls, lengths: list[int], places: bytes, marks: bytes, counts: bytes, classes: bytes, slots: bytes) -> Tokens:
        at, ends = opened(places, np.uint32), np.cumsum(lengths)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        mark = opened(marks, np.uint16).astype(np.uint64)[at]
        before, second = (np.concatenate([np.full(k, BEFORE, np.uint64), mark[:-k]])[: len(mark)] for k in (1, 2))
        before[starts] = BEFORE
        second[starts] = second[np.minimum(starts + 1, ends - 1)] = BEFORE
        return cls(starts, opened(counts, np.uint64)[at], opened(classes, np.uint8)[at], opened(slots, np.uint8)[at], before, second)

    def features(self, at: slice | np.ndarray) -> list[np.ndarray]:
        """What stands before tokens, by template: one word, two, the second alone."""
        a, b = self.before[at], self.second[at]
        return [a, (a << np.uint64(20)) + b + np.uint64(1 << 40), b + np.uint64(1 << 41)]


def rows_of(feature: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """Rows of weights by hash: at the second level a class takes part in it."""
    x = feature if of is None else feature ^ ((of.astype(np.uint64) + np.uint64(1)) << np.uint64(48))
    x = (x ^ (x >> np.uint64(23))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - 15)).astype(np.uint16)


@dataclass
class Level:
    """A softmax over hashed features: start values by group (one, or one a class) and weights by feature; what cannot be is minus infinity."""

    start: np.ndarray
    weights: np.ndarray

    def log_probabilities(self, group: np.ndarray | int, rows: list[np.ndarray]) -> np.ndarray:
        x = self.sums(group, rows)
        x -= x.max(1, keepdims=True)
        x -= np.log(np.exp(x).sum(1, keepdims=True))
        return x

    def sums(self, group: np.ndarray | int, rows: list[np.ndarray]) -> np.ndarray:
        x = self.weights.take(rows[0], 0, mode="clip")  # rows are below BUCKETS: what clips is only faster than what checks
        for r in rows[1:]:
            x += self.weights.take(r, 0, mode="clip")
        x += self.start if len(self.start) == 1 else self.start.take(group, 0)
        return x

    def probabilities(self, group: np.ndarray | int, rows: list[np.ndarray]) -> np.ndarray:
        """As exp(log_probabilities()), without a row's largest value taken off first, unless some row needs it."""
        x = self.sums(group, rows)
        with np.errstate(over="ignore"):
            np.exp(x, out=x)
        total = np.einsum("ij->i", x)
        if not (total.min(initial=1) > LEAST and total.max(initial=1) < MOST):
            return np.exp(self.log_probabilities(group, rows))
        x /= total[:, None]
        return x

    def log_probabilities_of(self, group: np.ndarray | int, rows: list[np.ndarray], right: np.ndarray) -> np.ndarray:
        """log_probabilities() of one place a row, whatever other rows hold."""
        x, at = self.sums(group, rows), np.arange(len(right))
        own = x[at, right]
        with np.errstate(over="ignore"):
            np.exp(x, out=x)
        total = x.sum(1)
        far = np.flatnonzero(~((total > LEAST) & (total < MOST)))
        total[far] = 1
        own -= np.log(total)
        if far.size:
            own[far] = self.log_probabilities(group if np.ndim(group) == 0 else group[far], [r[far] for r in rows])[np.arange(len(far)), right[far]]
        return own


def first_levels(v: Vocabulary) -> tuple[Level, Level]:
    """Before training: the shares of classes in the tokens learnt from, and of slots in their class."""
    mass = np.array([*v.mass, v.once], float)
    share = np.where(mass > 0, np.log(np.maximum(mass, 0.5) / max(v.tokens, 1)), -np.inf)
    share[RARE] = np.log(max(mass[RARE], 0.5) / max(v.tokens, 1))
    slots = np.zeros((CLASSES, SLOTS))
    slots[v.classes, v.slots] = v.counts
    slots[:, 0] = v.shared()
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = np.log(slots / slots.sum(1, keepdims=True))
    inner[slots.sum(1) == 0] = 0  # a class without words, which has no tokens
    return Level(share[None], np.zeros((BUCKETS, CLASSES + 1))), Level(inner, np.zeros((BUCKETS, SLOTS)))


def put_rows(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """table[at] = rows, each row copied as one item."""
    whole = f"V{table.itemsize * table.shape[1]}"
    table.view(whole)[:, 0][at] = rows.view(whole)[:, 0]


class Learner:
    """Gradient steps of one task on one level, each feature at its own pace (by the squares of its gradients so far)."""

    def __init__(self, level: Level, width: float = WIDTH):
        self.width = np.float32(width)
        self.level = Level(level.start.astype(np.float32), level.weights.astype(np.float32))
        self.old, self.squares, self.seen = self.level.weights.copy(), np.full_like(self.level.weights, 1e-2), np.zeros(BUCKETS, np.int64)
        self.marks, self.places = np.zeros(BUCKETS, bool), np.zeros(BUCKETS, np.int64)

    def step(self, group: np.ndarray | int, rows: list[np.ndarray], right: np.ndarray) -> None:
        error = self.level.probabilities(group, rows)
        error[np.arange(len(right)), right] -= 1
        width = error.shape[1]
        errors, columns = np.ascontiguousarray(error.T, np.float64).ravel(), np.arange(width)[:, None]
        for r in rows:
            self.marks[r] = True
            at = np.flatnonzero(self.marks)
            self.marks[at], self.places[at] = False, np.arange(len(at))
            place = self.places.take(r, mode="clip")
            cells = (place * width + columns).ravel()  # where each error is added up
            total = np.bincount(cells, errors, len(at) * width).astype(np.float32).reshape(-1, width)
            squares = self.squares.take(at, 0, mode="clip")
            squares += total * total
            put_rows(self.squares, at, squares)
            np.sqrt(squares, out=squares)
            total *= self.width
            total /= squares
            np.subtract(self.level.weights.take(at, 0, mode="clip"), total, out=total)
            put_rows(self.level.weights, at, total)
            self.seen[at] += np.bincount(place)

    def change(self) -> np.ndarray:
        """How often each feature occurred, times its change, in units; and how often."""
        moved = (self.level.weights - self.old).astype(np.float64) * self.seen[:, None]
        return np.concatenate([np.rint(moved / UNIT).astype(np.int64).ravel(), self.seen])


def learn_levels(outer: Learner, inner: Learner, t: Tokens, chosen: np.ndarray) -> None:
    """Steps over chosen tokens of a block, level by level, so that the weights of one stay near the processor."""
    for i in range(0, len(chosen), STEP):
        at = chosen[i : i + STEP]
        outer.step(0, [rows_of(f) for f in t.features(at)], t.classes[at])
    for i in range(0, len(chosen), STEP):
        at = chosen[i : i + STEP]
        if (at := at[t.classes[at] < RARE]).size:
            group = t.classes[at]
            inner.step(group, [rows_of(f, group) for f in t.features(at)], t.slots[at])


def averaged(level: Level, total: np.ndarray) -> Level:
    wide = level.weights.size
    moved, seen = total[:wide].reshape(level.weights.shape) * UNIT, total[wide:]
    return replace(level, weights=level.weights + moved / (seen + STILL)[:, None])


def trained(table: DataFrame, v: Vocabulary, rounds: int = ROUNDS, width: float = WIDTH) -> tuple[Level, Level]:
    """Both levels after all rounds. In round r, tasks learn from each rounds-th document of their blocks, beginning with the r-th, and from no
    document that is held out. The levels have a fixed size; sums of changes meet in a tree."""
    levels, spark = first_levels(v), table.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-v.tokens // TASK_TOKENS))
    for turn in range(rounds if v.tokens else 0):
        shared = spark.sparkContext.broadcast(levels)  # of fixed size: BUCKETS

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            outer, inner = (Learner(x, width) for x in shared.value)
            for batch in batches:
                for block in zip(*(batch.column(i).to_pylist() for i in range(2, len(CODED_NAMES)))):
                    t = Tokens.of(*block[1:])
                    learn = ~np.array(block[0], bool) & (np.arange(len(block[0])) % rounds == turn)
                    chosen = np.flatnonzero(np.repeat(learn, block[1]))
                    learn_levels(outer, inner, t, chosen)
            flat = np.concatenate([outer.change(), inner.change()])
            pieces = [pack(x.tobytes()) for x in np.array_split(flat, PARTS)]
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([part] * PARTS, pa.int32()), pa.array(pieces, pa.binary())], names=["slice", "part", "data"])

        parts = table.select(*CODED_NAMES).coalesce(tasks).mapInArrow(run, "slice int, part int, data binary")
        found = {r["slice"]: np.frombuffer(unpack(r["data"]), np.int64) for r in tree_sum(parts).collect()}  # PARTS rows of fixed size
        flat = np.concatenate([found[i] for i in range(PARTS)]) if found else np.zeros(sum(x.weights.size + BUCKETS for x in levels), np.int64)
        first = levels[0].weights.size + BUCKETS
        levels = averaged(levels[0], flat[:first]), averaged(levels[1], flat[first:])
        shared.unpersist()
    return levels


def log_probabilities(t: Tokens, v: Vocabulary, levels: tuple[Level, Level]) -> np.ndarray:
    """Natural logarithms of the probabilities of a block's tokens, after what stands before them."""
    out, unknown = np.empty(len(t.counts)), v.unknown()
    with np.errstate(divide="ignore"):
        shared = np.log(v.shared().astype(float))
    for i in range(0, len(out), BATCH):
        at = slice(i, i + BATCH)
        features, right, n, slot = t.features(at), t.classes[at], t.counts[at], t.slots[at]
        p = levels[0].log_probabilities_of(0, [rows_of(f) for f in features], right)
        some = np.flatnonzero(right < RARE)
        group, own = right[some], slot[some]
        p[some] += levels[1].log_probabilities_of(group, [rows_of(f[some], group) for f in features], own)
        tail = some[own == 0]
        p[tail] += np.log(n[tail].astype(float)) - shared[right[tail]]
        rare = right == RARE
        p[rare & (n == 0)] += np.log(unknown)
        if v.once:
            p[rare & (n > 0)] += np.log((1 - unknown) / v.once)
        out[at] = p
    return out


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(table: DataFrame, v: Vocabulary, levels: tuple[Level, Level]) -> DataFrame:
    """A row of RESULT for each document of coded blocks."""
    shared = table.sparkSession.sparkContext.broadcast((v, levels))  # of fixed size: BUCKETS, and SLOTS - 1 words a class

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, levels = shared.value
        for batch in batches:
            for ids, held, *block in zip(*(batch.column(i).to_pylist() for i in range(1, len(CODED_NAMES)))):
                t = Tokens.of(*block)
                base = np.log10((t.counts.astype(float) + 0.5) / (v.tokens + 0.5 * (v.words + 1)))
                own = log_probabilities(t, v, levels) / np.log(10)
                sums = [np.round(np.add.reduceat(x, t.starts), 9) + 0.0 for x in (base, own)]
                known = np.add.reduceat((t.counts > 0).astype(np.int64), t.starts)
                columns = (ids, held, block[0], known, [v.tokens] * len(ids), *sums)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in RESULT.split(", ")])

    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    return table.select(*CODED_NAMES).mapInArrow(run, RESULT)


def score_documents(docs: DataFrame, held_out, size: int = BLOCK) -> DataFrame:
    """held_out, tokens, known tokens, tokens learnt from, base score and model score (both log10 of the text's probability) of each row of
    docs(doc_id, text), learning from those for which the column held_out isn't true.

    A null text counts as empty and is its end alone; rows that repeat are counted each and score alike; a null doc_id stays null and is learnt
    from. Without rows to learn from every token is unknown and certain, and all scores are 0; an empty table gives none. A text of any length is
    counted and scored whole; other columns are ignored, whatever their names. Counts are exact but for words that share 64 bits of hash (one pair
    is to be expected among some 6 billion distinct words). The model depends on how rows lie in partitions, as each task learns in its own order;
    from the same tables a lost task gives the same again. A task holds a block's tokens or a slice's words, and weights of fixed size."""
    table = stored(blocks(docs, F.coalesce(held_out, F.lit(False)), size), "blocks")
    about = table.agg(F.sum("n_words").alias("n"), *[F.sum(F.col("kinds")[i]).alias(f"k{i}") for i in range(KINDS)]).first()
    beside = np.array([about[f"k{i}"] or 0 for i in range(KINDS)], float)
    slices = max(1, -(-(about["n"] or 0) // SLICE))
    answers = stored(merged(table, slices, beside / max(beside.sum(), 1)), "words")
    v = vocabulary(answers)
    ready = stored(coded(table, answers, v), "coded")
    discard(table, answers)
    return scored(ready, v, trained(ready, v))


def op13_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, remainder(F.col("doc_id"), 5) == 1)
