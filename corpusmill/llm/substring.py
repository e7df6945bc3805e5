"""Substring dedup: windows of words that start anywhere else too, found with a count-min prefilter.

A window's anchor is the least of the hashes of its shorter runs, so equal windows have equal anchors at equal places, and a text has far fewer
anchors than windows. Every partition counts its anchors in a count-min sketch of two rows. A sketch is cut into slices of SLICE cells a row,
as many as keep the cells sparse, so a partition sends only the slices, and in them the cells, that anything fell into; merging adds up equal
cells of a slice in an array of fixed size, and no cell counts less than what fell into it. Cells that count two or more become a set of bits
of bounded size that every task gets. A window is estimated repeated where both cells of its anchor are in the set. A second pass over the
texts groups exactly what is estimated repeated: per anchor, the runs of windows that share it. Equal runs are collapsed first; where an anchor
has several different runs, their windows are counted, by 128 bits of hash. The words of repeated windows go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import bound_batches, discard, marked, pack, stored, texts_of, tree_fold, unpack
from .wordhash import BASE_A, BASE_B, BASE_C, WORD, Runs, hashes_of, mixed, words_of

#: Words of a window, and of the runs that anchors are chosen from; the window must hold at most 63 of them.
WINDOW, ANCHOR = 35, 12
#: Bits of a slice's width, anchors that a slice is meant for, bytes of text that give one anchor, and anchors that a task gathers before it
#: counts them.
SLICE_BITS, SLICE_ANCHORS, ANCHOR_BYTES, GATHER = 24, 1 << 18, 64, 1 << 20
#: Bits of the set of repeated cells: 16 a cell, within these bounds (as powers of two); beyond them more windows go through the second pass.
LEAST_SET, MOST_SET, SET_SLICES = 20, 28, 16


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """Where the least of each size neighbours stands, the first of equals: from windows that double, then two that overlap."""
    least, at, width, n = values, np.arange(len(values)), 1, len(values) - size + 1
    while 2 * width <= size:
        later = least[width:] < least[:-width]
        least, at, width = np.where(later, least[width:], least[:-width]), np.where(later, at[width:], at[:-width]), 2 * width
    off = size - width
    return np.where(least[off : off + n] < least[:n], at[off : off + n], at[:n])


def runs_by_anchor(hashes: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's windows, in order: first starts of the runs that share an anchor, their numbers of windows, and the anchors' hashes."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = Runs(hashes, BASE_A).all(anchor)
    at = _least(short, window - anchor + 1)
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    return first, np.diff(np.concatenate([first, [n]])), short[at[first]]


def cells(anchors: np.ndarray, slice_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each anchor in the first and the second row: its slice's number, then a bit for the row, then the place in the slice. Anchors
    are least hashes, so they are mixed again to spread evenly."""
    h = mixed(anchors ^ np.uint64(BASE_C))
    wide = np.uint64((1 << SLICE_BITS) - 1)
    base = (h >> np.uint64(64 - slice_bits) if slice_bits else h & np.uint64(0)) << np.uint64(SLICE_BITS + 1)
    first = (h >> np.uint64(64 - slice_bits - SLICE_BITS)) & wide
    return base | first, base | np.uint64(1 << SLICE_BITS) | (h & wide)


def sketch(texts: DataFrame, window: int, anchor: int, slice_bits: int) -> DataFrame:
    """The merged sketch's cells that count two or more: slice, n, data (their codes within the slice). A partition sends, for each slice,
    its cells in order, each with a bit that says whether it counts more than one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(cells(np.concatenate(held), slice_bits)), return_counts=True)
            slices = (found >> np.uint64(SLICE_BITS + 1)).astype(np.int64)
            codes = ((found & np.uint64((2 << SLICE_BITS) - 1)) << np.uint64(1)).astype(np.uint32) | (times > 1)
            edges = np.flatnonzero(np.diff(np.concatenate([[-1], slices, [-1]])))
            data = [pack(np.diff(codes[a:b], prepend=np.uint32(0)).tobytes()) for a, b in zip(edges, edges[1:])]
            return pa.RecordBatch.from_arrays([pa.array(slices[edges[:-1]], pa.int64()), pa.array(data, pa.binary())], names=["slice", "data"])

        for batch in batches:
            for text in texts_of(batch):
                anchors = runs_by_anchor(hashes_of(words_of(text)), window, anchor)[2]
                held.append(anchors)
                n += len(anchors)
                if n > GATHER:
                    yield counted()
                    held, n = [], 0
        if n:
            yield counted()

    def merge(t: pa.Table) -> pa.Table:
        total = np.zeros(2 << SLICE_BITS, np.uint8)
        for x in t.column("data").to_pylist():
            codes = np.cumsum(np.frombuffer(unpack(x), np.uint32), dtype=np.uint32)
            at = codes >> np.uint32(1)
            total[at] = np.minimum(total[at] + 1 + (codes & np.uint32(1)).astype(np.uint8), 2)  # two and more count alike
        hot = np.flatnonzero(total > 1).astype(np.uint32)
        return pa.table({"slice": t.column("slice").slice(0, 1), "n": pa.array([len(hot)], pa.int64()), "data": pa.array([hot.tobytes()], pa.binary())})

    return texts.mapInArrow(run, "slice long, data binary").groupBy("slice").applyInArrow(merge, "slice long, n long, data binary")


def _places(codes: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(codes) >> np.uint64(64 - bits)).astype(np.int64)


def repeated_cells(merged: DataFrame) -> tuple[np.ndarray, int]:
    """The set of the cells that count two or more, as bytes of eight bits, and the power of two that its bits are."""
    bits = min(MOST_SET, max(LEAST_SET, (16 * (merged.agg(F.sum("n")).first()[0] or 0)).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        some = np.zeros((1 << bits) // 8, np.uint8)
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                codes = np.frombuffer(data, np.uint32).astype(np.uint64) | np.uint64(number << (SLICE_BITS + 1))
                at = _places(codes, bits)
                np.bitwise_or.at(some, at >> 3, (1 << (at & 7)).astype(np.uint8))
        part = TaskContext.get().partitionId()
        blocks = [pack(x.tobytes()) for x in np.split(some, SET_SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SET_SLICES), pa.int32()), pa.array([part] * SET_SLICES, pa.int32()), pa.array(blocks, pa.binary())], names=["slice", "part", "data"])

    rows = tree_fold(merged.mapInArrow(run, "slice int, part int, data binary"), np.uint8, np.bitwise_or).collect()
    slices = {r["slice"]: np.frombuffer(unpack(r["data"]), np.uint8) for r in rows}
    return np.concatenate([slices[i] for i in range(SET_SLICES)]) if slices else np.zeros((1 << bits) // 8, np.uint8), bits


SPANS = "key long, id string, times long, anchor long, first int, span long, windows array<long>"


def spans_of(docs: DataFrame, window: int, anchor: int, slice_bits: int, cells_set: np.ndarray, bits: int) -> DataFrame:
    """Runs of windows with anchors that are estimated repeated. docs: key, id, text. Equal rows of a batch come once, with their number."""
    shared = docs.sparkSession.sparkContext.broadcast(cells_set)  # 2^MOST_SET bits at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def among(codes: np.ndarray) -> np.ndarray:
            at = _places(codes, bits)
            return (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

        for batch in batches:
            rows: dict[tuple, int] = {}
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch)):
                rows[row] = rows.get(row, 0) + 1
            out: list[list] = [[] for _ in range(7)]
            for (key, id_, text), times in rows.items():
                hashes = hashes_of(words_of(text))
                first, n, found = runs_by_anchor(hashes, window, anchor)
                one, two = cells(found, slice_bits)
                hot = np.flatnonzero(among(one) & among(two)) if len(found) else ()
                if not len(hot):
                    continue
                all_windows = Runs(hashes, BASE_B).all(window).astype(np.int64)
                first, n = first[hot], n[hot]
                out[0] += [key] * len(hot)
                out[1] += [id_] * len(hot)
                out[2] += [times] * len(hot)
                out[3] += found[hot].astype(np.int64).tolist()
                out[4] += first.tolist()
                out[5] += Runs(hashes, BASE_C).of(first, first + n + window - 1).astype(np.int64).tolist()
                out[6] += [all_windows[a : a + k] for a, k in zip(first.tolist(), n.tolist())]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[x.split()[0] for x in SPANS.split(", ")])

    return docs.select("key", "id", "text").mapInArrow(run, SPANS)


def without(text: str, removed: np.ndarray) -> str:
    """text without the words marked; each run of them goes with the white space behind it, all else stays as it is."""
    out, at, spans = [], 0, [m.start() for m in WORD.finditer(text)] + [len(text)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], removed.astype(np.int8), [0]])))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        out.append(text[at : spans[a]])
        at = spans[b]
    return "".join(out) + text[at:]


DIGEST = "n_words long, n_removed long, kept_sha256 string"


def _finish(docs: DataFrame, keep: list[str], window: int, with_text: bool) -> DataFrame:
    """Columns keep of docs, with the digest of what is left, from text and marks (starts of runs with a bit a window)."""
    extra = DIGEST + ", kept string" * with_text
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, marks in zip(texts_of(batch, "_text"), batch.column(batch.num_columns - 1).to_pylist()):
                words = words_of(text)
                change = np.zeros(len(words) + 1, np.int64)
                for mark in marks or ():
                    starts = mark["first"] + np.flatnonzero([(mark["bits"] >> i) & 1 for i in range(64)])
                    np.add.at(change, starts, 1)
                    np.add.at(change, starts + window, -1)
                gone = np.cumsum(change)[:-1] > 0
                left = b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if marks else words)
                row = (len(words), int(gone.sum()), hashlib.sha256(left).hexdigest())
                rows.append((*row, without(text, gone)) if with_text else row)
            kinds = [pa.int64(), pa.int64(), pa.string()] + [pa.string()] * with_text
            columns = [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + columns, names=keep + [x.split()[0] for x in extra.split(", ")])

    return docs.select(*keep, F.col("text").alias("_text"), "marks").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """Columns keep (doc_id), n_words, n_removed and kept_sha256 of each document, and with with_text the kept text. A null text has no words;
    texts shorter than a window lose nothing; a row that is repeated counts as another place, so all its windows are repeated; doc_id may be
    null; an empty table gives no rows; other columns may have any name. Only texts that lose words are shuffled. All counts are aggregated
    before they are shuffled, and the joins on runs and windows may split what very many documents share."""
    if not window - 62 <= anchor <= window:
        raise ValueError("a run's windows must fit the bits of a long")
    keep = keep or ["doc_id"]
    bound_batches(docs.sparkSession)
    docs = docs.select(*dict.fromkeys([*keep, "doc_id", "text"])).withColumn("text", F.coalesce("text", F.lit("")))
    docs = docs.withColumn("id", F.col("doc_id").cast("string")).withColumn("key", F.xxhash64("id", "text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slice_bits = min(32, max(0, (size // ANCHOR_BYTES // SLICE_ANCHORS).bit_length()))
    merged = stored(sketch(docs.select("text"), window, anchor, slice_bits), "sketch")
    spans = stored(spans_of(docs, window, anchor, slice_bits, *repeated_cells(merged)), "spans")
    discard(merged)

    # Equal runs first; only where an anchor has several different runs must their windows be counted one by one.
    distinct = stored(spans.groupBy("anchor", "span").agg(F.sum("times").alias("n"), F.first("windows").alias("windows")), "distinct-spans")
    several = stored(distinct.groupBy("anchor").agg(F.count("*").alias("runs")).filter("runs > 1").select("anchor"), "several")
    checked = marked(distinct, F.col("anchor"), several)
    alone = checked.filter("not _marked and n > 1").select("anchor", "span", F.expr("shiftleft(1L, size(windows)) - 1").alias("bits"))
    single = checked.filter("_marked").select("anchor", "span", "n", F.posexplode("windows").alias("i", "hash"))
    repeated = single.groupBy("anchor", "hash").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor", "hash")
    mixed_ = single.join(repeated, ["anchor", "hash"]).groupBy("anchor", "span").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("bits"))
    bits = alone.unionByName(mixed_)
    marks = spans.select("key", "id", "anchor", "span", "first").join(bits, ["anchor", "span"])
    marks = stored(marks.groupBy("key", "id").agg(F.collect_set(F.struct("first", "bits")).alias("marks")), "marks")
    discard(spans, distinct, several)

    looked = marked(docs, F.col("key"), marks.select("key"))
    again = looked.filter("_marked").select(*docs.columns)
    joined = again.alias("d").join(marks.alias("m"), F.expr("d.key = m.key and d.id <=> m.id"), "left").select("d.*", "m.marks")
    none = F.lit(None).cast("array<struct<first:int,bits:bigint>>").alias("marks")
    return _finish(joined, keep, window, with_text).unionByName(_finish(looked.filter("not _marked").select(*docs.columns, none), keep, window, with_text))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """docs with the words of repeated windows taken out of text, and n_chars (if there) set anew; other texts stay as they are, null becomes
    empty."""
    own = [f"_column_{i}" for i in range(len(docs.columns))]  # so that no name of docs meets one used here
    rows = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, own)])
    out = remove_repeats(rows, keep=own, with_text=True)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return out.select(*[new.get(c, F.col(n)).alias(c) for c, n in zip(docs.columns, own)])


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP5_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 34], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
rep AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win WHERE s IN (SELECT s FROM rep)),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
