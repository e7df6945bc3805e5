"""N-gram Jaccard join: a grouped prefix join over sets of word shingles, and the components of its links.

Sets that are equal are one set from the start. All sets are ordered alike, shingles that are frequent last, then by hash; a prefix is long
enough that two similar sets share an entry of it. Sets with identical prefixes and sizes are one group. Prefix entries go to buckets by
their hash, where lists of groups that share one give group pairs; their sizes and the number of entries they share rule most out. A list
that is long gives no pairs: its members are compared with one of them first, and one by one only where that leaves them unconnected. Pairs
of groups expand to pairs of their sets, which are verified on the whole sets; sets already in one component need no comparison.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .runtime import bound_batches, discard, marked, pack, stored, texts_of, unpack
from .wordhash import BASE_A, Runs, hashes_of

SHINGLE, PERCENT = 5, 75
#: Members from which a list is long; shingles that a task counts at a time; counts in such a unit, and in all, from which one is frequent;
#: frequent shingles that the order knows at most (its choice affects speed, never links); rounds with one set of each list.
LONG, UNIT, OFTEN, FREQUENT, KNOWN, ROUNDS = 48, 2_000_000, 3, 32, 1 << 17, 3
#: Prefix entries that a bucket holds, about.
BUCKET = 1_000_000


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles; of its whole sequence where it has fewer words; none without words."""
    hashes = hashes_of(text.encode().lower().split())  # bytes: only A to Z change, only the ASCII white space splits
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return np.unique(Runs(hashes, BASE_A).all(min(size, len(hashes))))


def needed(n: int, percent: int = PERCENT) -> int:
    """The least overlap that a set of n shares with any similar set."""
    return -(-percent * n // 100)


def frequent_shingles(docs: DataFrame, size: int, often: int = OFTEN, frequent: int = FREQUENT) -> np.ndarray:
    """The shingles that most sets hold, KNOWN at most, from counts over all documents; equal sets of a task count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, n = [], set(), 0

        def counted() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            many = times >= often
            return pa.RecordBatch.from_arrays([pa.array(found[many].astype(np.int64), pa.int64()), pa.array(times[many].astype(np.int64), pa.int64())], names=["shingle", "n"])

        for batch in batches:
            for text in texts_of(batch):
                s = shingles(text, size)
                key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if len(s) and key not in seen:
                    seen.add(key)
                    held.append(s)
                    n += len(s)
            if n > UNIT:
                yield counted()
                held, n = [], 0
                seen.clear()
        if n:
            yield counted()

    counts = docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= frequent)
    rows = counts.orderBy(F.desc("n"), "shingle").limit(KNOWN).collect()
    return np.sort(np.array([r["shingle"] for r in rows], np.int64).astype(np.uint64))


PREFIXES = "doc_id long, n long, set_hash binary, group_hash binary, frequent int, prefix binary"


def prefixes(docs: DataFrame, known: np.ndarray, size: int, percent: int) -> DataFrame:
    """A row per document: its set's size and hash, its prefix, and how many frequent shingles end it."""
    shared = docs.sparkSession.sparkContext.broadcast(known)  # KNOWN numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            rows = []
            for text in texts_of(batch):
                s = shingles(text, size)
                if not len(s):
                    rows.append((0, None, None, 0, None))
                    continue
                n, late = len(s), np.zeros(len(s), bool)
                if len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    late = often[at] == s
                length = n - needed(n, percent) + 1
                early = s[~late]
                prefix = np.concatenate([early, s[late]])[:length]
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                group = hashlib.blake2b(prefix.tobytes() + n.to_bytes(8, "little"), digest_size=16).digest()
                rows.append((n, digest, group, max(0, length - len(early)), prefix.tobytes()))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 5, kinds))], names=[x.split()[0] for x in PREFIXES.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, PREFIXES)


#: Packed: entries of a bucket. Candidates: kind 0, a pair of groups a < b that share n entries of one bucket and must share need in all to be
#: similar; kind 1, group a of size n stands in the long list b.
PACKED, CANDIDATES = "bucket int, data binary", "kind int, a long, b long, n long, need int"


def packed(groups: DataFrame, n_buckets: int) -> DataFrame:
    """Prefix entries that aren't frequent, by bucket. groups: gid, n, frequent, prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            parts = [np.frombuffer(r["prefix"], np.uint64) for r in rows]
            parts = [p[: len(p) - r["frequent"]] for p, r in zip(parts, rows)]
            sizes = [len(p) for p in parts]
            h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            gid, n = np.repeat(np.array([r["gid"] for r in rows], np.int64), sizes), np.repeat(np.array([r["n"] for r in rows], np.int64), sizes)
            place = np.concatenate([np.arange(k) for k in sizes]) if sizes else np.zeros(0, np.int64)
            bucket = (h % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(np.concatenate([[-1], bucket[order], [-1]])))
            out_b, out_d = [], []
            for a, b in zip(edges, edges[1:]):
                some = order[a:b]
                out_b.append(int(bucket[some[0]]))
                out_d.append(pack(b"".join(c[some].tobytes() for c in (h, gid, n, place))))
            yield pa.RecordBatch.from_arrays([pa.array(out_b, pa.int32()), pa.array(out_d, pa.binary())], names=["bucket", "data"])

    return groups.select("gid", "n", "frequent", "prefix").mapInArrow(run, PACKED)


def frequent_entries(groups: DataFrame) -> DataFrame:
    """Prefix entries that are frequent, as members of long lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            parts = [np.frombuffer(r["prefix"], np.int64)[-r["frequent"] :] for r in rows]
            sizes = [len(p) for p in parts]
            gid, n = (np.repeat(np.array([r[c] for r in rows], np.int64), sizes) for c in ("gid", "n"))
            h = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), np.int32), pa.int32()), pa.array(gid, pa.int64()), pa.array(h, pa.int64()), pa.array(n, pa.int64()), pa.array(np.zeros(len(h), np.int32), pa.int32())], names=["kind", "a", "b", "n", "need"])

    return groups.filter("frequent > 0").select("gid", "n", "frequent", "prefix").mapInArrow(run, CANDIDATES)


def _bucket_pairs(table: pa.Table, percent: int, long_list: int = LONG) -> pa.Table:
    """Candidates of one bucket."""
    data = [np.frombuffer(unpack(x), np.int64).reshape(4, -1) for x in table.column("data").to_pylist()]
    h, gid, n, place = np.concatenate(data, axis=1)
    order = np.lexsort((gid, h))
    h, gid, n, place = h[order], gid[order], n[order], place[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.concatenate([starts, [len(h)]]))
    size = np.repeat(size, size)
    long_, few = size > long_list, (size > 1) & (size <= long_list)
    out = [(np.ones(int(long_.sum()), np.int64), gid[long_], h[long_], n[long_], np.zeros(int(long_.sum()), np.int64))]
    h, gid, n, place = h[few], gid[few], n[few], place[few]
    pairs_a, pairs_b, needs = [], [], []
    for lag in range(1, long_list):
        same = h[lag:] == h[:-lag] if lag < len(h) else np.zeros(0, bool)
        if not same.any():
            break
        x, y = n[:-lag][same], n[lag:][same]
        close = 100 * np.minimum(x, y) >= percent * np.maximum(x, y)
        pairs_a.append(gid[:-lag][same][close])
        pairs_b.append(gid[lag:][same][close])
        x, y, i, j = x[close], y[close], place[:-lag][same][close], place[lag:][same][close]
        overlap = -(-percent * (x + y) // (100 + percent))
        # Entries up to this one that only one side has count against it, and what the longer set has behind its prefix can make up for few.
        needs.append(np.maximum.reduce([overlap + (-percent * np.maximum(x, y) // 100) + 1, i + 1 - (x - overlap), j + 1 - (y - overlap)]))
    if pairs_a:
        a, b, need = np.concatenate(pairs_a), np.concatenate(pairs_b), np.concatenate(needs)
        order = np.lexsort((b, a))
        a, b, need = a[order], b[order], need[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        times = np.diff(np.concatenate([first, [len(a)]]))
        most = np.maximum.reduceat(need, first) if len(first) else need
        out.append((np.zeros(len(first), np.int64), a[first], b[first], times, most))
    kind, a, b, c, need = (np.concatenate(x) for x in zip(*out))
    columns = {"kind": kind.astype(np.int32), "a": a, "b": b, "n": c, "need": need.astype(np.int32)}
    return pa.table({k: pa.array(v) for k, v in columns.items()})


def set_table(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node and its sorted shingles, for documents in nodes(node) only; no other text is shuffled, but for few that are marked by chance."""
    likely = marked(docs, F.col("doc_id"), nodes.select("node")).filter("_marked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, size).tobytes() for t in texts_of(batch)], pa.binary())], names=["node", "data"])

    wanted = likely.select(F.col("doc_id").alias("node"), "text").join(nodes, "node", "left_semi")
    return wanted.mapInArrow(run, "node long, data binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b) whose whole sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, keep = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([pa.array([v for v, k in zip(c, keep) if k], pa.int64()) for c in (a, b)], names=["a", "b"])

    def of(column: str, data: str) -> DataFrame:
        some = marked(sets, F.col("node"), pairs.select(column)).filter("_marked")  # only sets of these pairs are shuffled
        return some.select(F.col("node").alias(column), F.col("data").alias(data))

    return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def similar_documents(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, long_list: int = LONG, often: int = OFTEN, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of each row of docs(doc_id, text). Null and empty texts, and
    texts without words, have no shingles and link with nothing. Rows with a null doc_id keep their row; they take part where another document
    has the same set, and else have a null component. Rows that share a doc_id count as one document with several texts."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    rows = stored(prefixes(docs, frequent_shingles(docs, size, often, frequent), size, percent), "prefixes")
    some = rows.filter("n > 0 and doc_id is not null")
    sets = some.groupBy("set_hash").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("group_hash").alias("group_hash"))
    groups = some.groupBy("group_hash").agg(F.min("doc_id").alias("gid"), F.first("n").alias("n"), F.first("frequent").alias("frequent"), F.first("prefix").alias("prefix"))
    groups = stored(groups, "groups")
    members = stored(sets.join(groups.select("group_hash", "gid"), "group_hash").select("node", "gid", "n", "set_hash"), "members")

    entries = groups.agg(F.sum(F.length("prefix") / 8).cast("long")).first()[0] or 0
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = max(64, 4 * parallel, -(-entries // BUCKET))
    found = packed(groups, n_buckets).groupBy("bucket").applyInArrow(lambda t: _bucket_pairs(t, percent, long_list), CANDIDATES)
    found = stored(found.unionByName(frequent_entries(groups)), "candidates")

    # Pairs of groups must share enough entries; entries in long lists count as shared, for lack of knowing.
    lists = found.filter("kind = 1").select(F.col("b").alias("list"), F.col("a").alias("gid"), "n")
    apart = stored(lists.groupBy("gid").agg(F.count("*").alias("apart")), "apart")
    shared = stored(found.filter("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("shared"), F.max("need").alias("need")), "shared")
    weak = shared.filter("shared < need")
    weak = marked(weak, F.col("a"), apart.select("gid")).filter("_marked").drop("_marked")
    weak = marked(weak, F.col("b"), apart.select("gid")).filter("_marked").drop("_marked")
    weak = weak.join(apart.toDF("a", "apart_a"), "a").join(apart.toDF("b", "apart_b"), "b").filter("shared + least(apart_a, apart_b) >= need")
    pairs = stored(shared.filter("shared >= need").select("a", "b").union(weak.select("a", "b")), "group-pairs")

    # Long lists, and the sets of one group, are lists of sets; a list's sets are in bands of size.
    crowded = members.groupBy("gid").agg(F.count("*").alias("k")).filter("k > 1").select("gid")
    same = F.lit(2**31).alias("apart")
    inside = members.join(crowded, "gid").select(F.col("gid").alias("list"), "node", "n", F.lit(1).alias("what"), same)
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)))
    lists = lists.select("list", "gid").join(members.select("gid", "node", "n"), "gid").join(apart, "gid").select("list", "node", "n", F.lit(0).alias("what"), "apart")
    lists = stored(lists.unionByName(inside).withColumn("band", band), "lists")

    expand = members.select("gid", "node")
    candidates = pairs.select("a").union(pairs.select("b")).toDF("gid").distinct().join(expand, "gid").select("node").union(lists.select("node")).distinct()
    whole = stored(set_table(docs, stored(candidates, "nodes"), size), "sets")

    # A list's sets are compared with one of them, another one each round, which costs as many comparisons as the list has members; groups with
    # their smallest partner. What is in one component by then needs no comparison.
    def placed(df: DataFrame, column: str, to: str) -> DataFrame:
        return df.withColumn(to, F.col(column)) if where is None else df.join(where.toDF(column, "_c"), column, "left").withColumn(to, F.coalesce("_c", column)).drop("_c")

    def compare(new: DataFrame, name: str) -> None:
        nonlocal links, where, done
        new = new.select("a", "b").distinct()
        new = stored(new if done is None else new.join(done, ["a", "b"], "left_anti"), name)
        if not new.isEmpty():
            done = new if done is None else done.union(new)
            found_links = stored(verified(new, whole, percent), "links")
            links = found_links if links is None else links.union(found_links)
            where = components(links)

    links = where = done = None
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    open_lists = lists.withColumn("c", F.col("node"))
    for turn in range(ROUNDS):
        hubs = open_lists.groupBy("what", "list", "band").agg(F.min_by(F.struct("node", "c", "n", "apart"), F.struct(F.xxhash64("node", F.lit(turn)) if turn else F.col("node"), F.col("node"))).alias("hub"))
        tried = open_lists.join(hubs, ["what", "list", "band"]).filter(F.col("c") != F.col("hub.c"))
        tried = tried.filter(_possible("n", "hub.n", "least(apart, hub.apart)", percent)).select(*ordered("node", "hub.node"))
        if not turn:
            tried = tried.union(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
        compare(tried, f"tried-{turn}")
        open_lists = stored(_open(placed(lists, "node", "c")), "open-lists")
        if open_lists.isEmpty():
            break

    # Then every pair of groups, and in lists that still fall apart every set outside the largest component against all the others, where both
    # have enough entries in long lists. Pairs that share other entries are among the pairs of groups.
    sets_a, sets_b = expand.toDF("ga", "a"), expand.toDF("gb", "b")
    rest = pairs.toDF("ga", "gb").join(sets_a, "ga").join(sets_b, "gb").select(*ordered("a", "b"))
    rest = placed(placed(rest, "a", "ca"), "b", "cb").filter("ca <> cb").select("a", "b")
    sizes = open_lists.groupBy("what", "list", "c").agg(F.count("*").alias("k"))
    main = sizes.groupBy("what", "list").agg(F.max(F.struct("k", "c")).alias("main"))
    outside = open_lists.join(main, ["what", "list"]).filter("c <> main.c").select("what", "list", *[F.col(c).alias(f"{c}_x") for c in ("node", "n", "c", "band", "apart")])
    outside = outside.withColumn("band", F.explode(F.array(F.col("band_x") - 1, F.col("band_x"), F.col("band_x") + 1)))
    left = outside.join(open_lists, ["what", "list", "band"])
    left = left.filter((F.col("c_x") != F.col("c")) & _possible("n", "n_x", "least(apart, apart_x)", percent))
    left = left.groupBy(*ordered("node", "node_x")).agg(F.count("*").alias("together"), F.first("n").alias("n"), F.first("n_x").alias("n_x"), F.max("what").alias("what"))
    rest = rest.union(left.filter((F.col("what") == 1) | _possible("n", "n_x", "together", percent)).select("a", "b"))
    compare(rest, "rest")
    where = where if where is not None else members.select("node", F.col("node").alias("component")).limit(0)

    discard(groups, found, apart, shared, pairs, lists, whole)
    known = members.select("set_hash", "node").join(where.withColumnRenamed("component", "c"), "node", "left").select("set_hash", F.coalesce("c", "node").alias("c"))
    out = rows.select("doc_id", "n", "set_hash").join(known, "set_hash", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))


def _possible(x: str, y: str, most: str, percent: int) -> Column:
    """Whether sets of x and y shingles can be similar if their prefixes share most entries at best: their sizes allow it, and what the longer
    one has behind its prefix can make up the overlap."""
    overlap, beyond = f"ceil({percent} * ({x} + {y}) / {100 + percent})", f"ceil({percent} * greatest({x}, {y}) / 100) - 1"
    return F.expr(f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y}) and {most} >= {overlap} - ({beyond})")


def _open(lists: DataFrame) -> DataFrame:
    """The lists whose sets lie in several components."""
    several = lists.groupBy("what", "list").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("what", "list")
    return lists.join(several, ["what", "list"])


def keep_representatives(docs: DataFrame) -> DataFrame:
    """docs without those that have a smaller doc_id in their component; of rows that share a doc_id the one with the smallest text stays. Rows
    with a null doc_id all stay. Only rows with an id that goes, or that is repeated, are shuffled with their texts."""
    own = [f"_column_{i}" for i in range(len(docs.columns))]  # so that no name of docs meets one used here
    at = dict(zip(docs.columns, own))
    where = stored(similar_documents(docs.select("doc_id", "text")), "components")
    gone = where.filter("component_id < doc_id").select("doc_id").distinct()
    repeated = where.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    rows = marked(docs.toDF(*own), F.col(at["doc_id"]).cast("long"), gone.union(repeated))
    order = Window.partitionBy(at["doc_id"]).orderBy(at["text"])
    kept = rows.filter(F.col("_marked") & F.col(at["doc_id"]).isNotNull()).join(gone, F.col(at["doc_id"]) == F.col("doc_id"), "left_anti")
    kept = kept.withColumn("_row", F.row_number().over(order)).filter("_row = 1")
    rest = rows.filter(~F.col("_marked") | F.col(at["doc_id"]).isNull())
    return rest.select(*own).unionByName(kept.select(*own)).toDF(*docs.columns)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, s.y FROM reach r JOIN sides s ON s.x = r.b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) ON a = d.doc_id
"""
