"""Mixture-controlled packing: documents of every source cut into fixed windows whose shares follow target proportions.

Each source is a queue of tokens. Windows consist of cells. A deficit round robin deals cells to queues: every round adds a quantum in
proportion to the queue's weight to its deficit, a queue whose deficit pays for a cell is served, and what is left over stays as its deficit,
across windows and partitions. With quanta that are small against a cell, and half a cell to begin with, the k-th cell of queue i is dealt in
the round that (k + 1/2) / weight_i falls into, so its place among all cells is a sum of counts that any partition can compute by itself. A
partition needs just where its part of each queue begins, and neither tokens nor windows are shuffled. Exhausted queues
drop out and the rest share what follows in proportion. With the default weights (a queue's own size) all end together, and only
the last sequence of the whole table can be short.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import bound_batches, local_path, stored, texts_of

WINDOW, CELL, END_ID = 2048, 256, 1
#: Queues that sources get one each of; where there are more sources, their hashes share as many queues.
QUEUES = 1024
TOKENS = "part int, doc_id long, source string, start long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def _bytes_by_letter() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one letter: visible Latin-1 characters as themselves, the others in order from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Tokenizer:
    """Ids of a byte-level BPE file of the tokenizers library, without special ones. Its merges stand in the order of their ids, so the ids are
    ranks. Literals of added tokens become one id wherever they stand."""

    def __init__(self, file: str, pattern: str):
        import tiktoken

        with open(local_path(file) or file, encoding="utf-8") as f:
            read = json.load(f)
        letters, added = _bytes_by_letter(), {t["content"]: t["id"] for t in read["added_tokens"]}
        ranks = {bytes(letters[c] for c in word): i for word, i in read["model"]["vocab"].items() if word not in added}
        if [ranks[bytes(letters[c] for c in "".join(m))] for m in read["model"]["merges"]] != sorted(ranks.values())[-len(read["model"]["merges"]) :]:
            raise ValueError(f"{file}: merges don't stand in the order of their ids")
        self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.added = added
        self.marks = re.compile("|".join(f"({re.escape(t)})" for t in sorted(added, key=len, reverse=True))) if added else None
        self.kind = np.uint16 if max([*ranks.values(), *added.values()]) < 1 << 16 else np.uint32

    def __call__(self, text: str) -> list[int]:
        if not self.marks or not self.marks.search(text):
            return self.plain.encode_ordinary(text)
        ids: list[int] = []
        for piece in filter(None, self.marks.split(text)):
            ids += [self.added[piece]] if piece in self.added else self.plain.encode_ordinary(piece)
        return ids


@functools.lru_cache(2)
def tokenizer(file: str, pattern: str) -> Tokenizer:
    return Tokenizer(file, pattern)


def token_table(docs: DataFrame, file: str, pattern: str) -> DataFrame:
    """A row per document: its ids with the end id, as unsigned 16-bit where they fit, else 32-bit; and where they begin in its source's
    tokens of this partition. Null texts count as empty, a null source as a source of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of, part, so_far = tokenizer(file, pattern), TaskContext.get().partitionId(), {}

        for batch in batches:
            sources, starts, lengths, data = batch.column(2).to_pylist(), [], [], []
            for source, text in zip(sources, texts_of(batch)):
                ids = np.array(ids_of(text) + [END_ID], ids_of.kind)
                starts.append(so_far.get(source, 0))
                so_far[source] = starts[-1] + len(ids)
                lengths.append(len(ids))
                data.append(ids.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(data), pa.int32()), batch.column(0), batch.column(2), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(data, pa.binary())], names=["part", "doc_id", "source", "start", "n", "ids"])

    bound_batches(docs.sparkSession)
    source = "cast(source as string) source" if "source" in docs.columns else "cast(null as string) source"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text", source).mapInArrow(run, TOKENS)


def due_order(queue: int, cells: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Places, in the order of all cells of all queues, of these cells of one queue: how many cells fall due before each; ties go to the queue
    with the smaller number. sizes: cells of each queue; weights: integers up to 2^20."""
    odd = 2 * cells.astype(np.int64) + 1
    place = np.zeros(len(cells), np.int64)
    for j, (size, w) in enumerate(zip(sizes.tolist(), weights.tolist())):
        if j == queue:
            place += cells
            continue
        top = odd * w
        due = (top // int(weights[queue]) + 1) // 2 if j < queue else -(-top // int(weights[queue])) // 2
        place += np.minimum(size, due)
    return place


def cut(start: int, n: int, queue: int, sizes: np.ndarray, weights: np.ndarray, rest: np.ndarray, window: int, cell: int) -> np.ndarray:
    """Pieces of a document that takes start to start + n of its queue: rows (start in the document, length, place in the packed stream).
    rest: where each queue's tokens beyond its whole cells go."""
    first, last = start // cell, (start + n - 1) // cell
    k = np.arange(first, last + 1, dtype=np.int64)
    lo, hi = np.maximum(k * cell, start), np.minimum((k + 1) * cell, start + n)
    whole = k < sizes[queue]
    at = np.empty(len(k), np.int64)
    at[whole] = due_order(queue, k[whole], sizes, weights) * cell + (lo - k * cell)[whole]
    at[~whole] = rest[queue] + (lo - sizes[queue] * cell)[~whole]
    pieces: list[list[int]] = []
    for a, size, x in zip((lo - start).tolist(), (hi - lo).tolist(), at.tolist()):
        while size:
            if pieces and pieces[-1][2] + pieces[-1][1] == x and x % window:
                take = min(size, window - x % window)
                pieces[-1][1] += take
            else:
                take = min(size, window - x % window)
                pieces.append([a, take, x])
            a, size, x = a + take, size - take, x + take
    return np.array(pieces, np.int64).reshape(-1, 3)


def pack(docs: DataFrame, file: str, pattern: str, weights: dict[str | None, float] | None = None, window: int = WINDOW, cell: int = CELL) -> DataFrame:
    """Pieces of all documents (see PIECES); each id lies in exactly one. file: a byte-level BPE file of the tokenizers library, pattern: what it
    splits texts by. weights: target shares by source; 0 or none given: the source's own size. Of more than QUEUES sources those with equal hashes share a queue, whose target is the sum of theirs; they keep their share together, not
    each. An empty text is its end id alone; an empty table has no pieces; repeated rows are packed each. Documents of a queue stand in the
    order of the partitions read. A null doc_id stays null; a null source is a source; columns besides doc_id, text and source are ignored,
    whatever their names; a text of any length is cut into as many pieces as it takes."""
    spark = docs.sparkSession
    if window % cell:
        raise ValueError("a window holds whole cells")
    tokens = stored(token_table(docs, file, pattern), "tokens")
    parts = tokens.groupBy("part", "source").agg(F.sum("n").alias("part_n"))
    many = parts.select("source").distinct().count() > QUEUES
    name = F.concat(F.lit("#"), F.pmod(F.xxhash64("source"), F.lit(QUEUES))) if many else F.col("source")
    parts = parts.withColumn("queue", name)
    before = Window.partitionBy("queue").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1)
    # Stored, so that its size is known: few rows are sent to all tasks, many are joined by a shuffle.
    bases = stored(parts.select("part", "source", "queue", F.coalesce(F.sum("part_n").over(before), F.lit(0)).alias("base")), "bases")
    totals = sorted(((r["queue"], r["n"]) for r in parts.groupBy("queue").agg(F.sum("part_n").alias("n")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    number = {q: i for i, (q, _) in enumerate(totals)}
    n = np.array([t for _, t in totals], np.int64)
    sizes, left = n // cell, n % cell
    rest = sizes.sum() * cell + np.concatenate([[0], np.cumsum(left)[:-1]]).astype(np.int64) if len(n) else n
    if many and weights:
        given = F.broadcast(spark.createDataFrame([(q, float(w or 0)) for q, w in weights.items()], "of string, weight double"))  # the caller's
        own = parts.groupBy("queue", "source").agg(F.sum("part_n").alias("n")).join(given, F.expr("source <=> of"), "left")
        own = own.withColumn("target", F.when(F.col("weight") != 0, F.col("weight")).otherwise(F.greatest(F.lit(1.0), F.floor(F.col("n") / cell))))
        weights = {r["queue"]: r["target"] for r in own.groupBy("queue").agg(F.sum("target").alias("target")).collect()}  # QUEUES rows at most
    target = np.array([float((weights or {}).get(q) or max(1, s)) for (q, _), s in zip(totals, sizes.tolist())])
    shares = np.maximum(1, np.round(target / max(target.max(initial=1), 1e-300) * (1 << 20))).astype(np.int64)
    kind = tokenizer(file, pattern).kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], kind).astype("<u4")
                for a, size, x in cut(r["base"] + r["start"], r["n"], number[r["queue"]], sizes, shares, rest, window, cell).tolist():
                    rows.append((r["doc_id"], a, size, zlib.crc32(ids[a : a + size].tobytes()), r["n"], x // window, x % window, r["source"]))
            kinds = [pa.int64()] * 7 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 8, kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

    placed = tokens.alias("t").join(bases.alias("b"), F.expr("t.part = b.part and t.source <=> b.source"))
    return placed.select("t.doc_id", "t.source", "t.start", "t.n", "t.ids", "b.base", "b.queue").mapInArrow(run, PIECES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
