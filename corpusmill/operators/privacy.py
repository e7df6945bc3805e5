"""Personal data: found by ordered rules, numbered, replaced, and looked for again.

A text is a row of segments: stretches that no rule has taken, and finds. Each rule looks at the stretches left and cuts them where it finds
something, so text is never marked and nothing in it can be taken for a mark. Names given are found first, all in one pass. Values get global numbers
by first appearance, so a value has the same token everywhere; a folder may keep them, and later runs go on from there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..storage import commit_version, last_version, numbered, spread, stored
from .patterns import alone, automaton

#: Labels and shapes in the order that they apply.
RULES = (
    ("EMAIL", r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b"),
    ("IBAN", r"(?U)\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}\b"),
    ("PHONE", r"(?U)(?<![\w.])\+?\d[\d\s().-]{7,}\d(?![\w.])"),
    ("HANDLE", r"(?U)(?<![\w/])@[A-Za-z][\w.]{2,}\b"),
    ("PERSON", r"(?U)\b(?:Dr|Prof|Mr|Mrs|Ms|Mx|Ing|Eng|Sr|Sra|Herr|Frau)\.?[ \t]+(?:[A-ZÀ-Þ][\w'’-]+[ \t]+){0,2}[A-ZÀ-Þ][\w'’-]+"),
)
#: Shapes that must not survive; a phone number counts only with its plus sign.
LEAKS = (("email", r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b"), ("phone", r"(?U)(?<![\w.])\+\d[\d\s().-]{7,}\d(?![\w.])"))
def hits(x: Column, label: str) -> Column:
    """All finds of one rule in a text, as an array."""
    return F.regexp_extract_all(x, F.lit(dict(RULES)[label]), 0)


SEGMENTS = "array<struct<text:string,rule:int,label:string>>"


def _cut(segments: Column, rule: int, label: str, pattern: str) -> Column:
    """Segments whose free stretches are cut at the finds of one rule. A stretch's end is no word, as a find beside it wouldn't be."""

    def one(s: Column) -> Column:
        found, between = F.regexp_extract_all(s["text"], F.lit(pattern), 0), F.split(s["text"], pattern, -1)
        free = lambda x: F.struct(x.alias("text"), F.lit(None).cast("int").alias("rule"), F.lit(None).cast("string").alias("label"))
        taken = lambda x: F.struct(x.alias("text"), F.lit(rule).alias("rule"), F.lit(label).alias("label"))
        parts = F.filter(F.flatten(F.zip_with(between, found, lambda b, f: F.array(free(b), taken(f)))), lambda p: p["text"].isNotNull())
        nothing = s["label"].isNotNull() | (s["text"] == "")
        if "@" in pattern:  # most texts have no such sign, and looking for one is cheap
            nothing |= ~F.contains(s["text"], F.lit("@"))
        return F.when(nothing, F.array(s)).otherwise(parts)

    return F.flatten(F.transform(segments, one))


def _named(docs: DataFrame, names: list[str]) -> DataFrame:
    """docs(doc, text) with segments cut at the names, the longest first; they are few enough for one automaton."""
    given = sorted({n.strip() for n in names if n.strip()}, key=lambda n: (-len(n), n))
    if not given:
        whole = F.array(F.struct(F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("int").alias("rule"), F.lit(None).cast("string").alias("label")))
        return docs.select("doc", whole.alias("segments"))
    kind = pa.list_(pa.struct([("text", pa.string()), ("rule", pa.int32()), ("label", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(given)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                at, row, text = 0, [], text or ""
                for start, end, n in alone(text, given, a):
                    row += [(text[at:start], None, None), (text[start:end], n - len(given), "PERSON")]
                    at = end
                out.append([{"text": t, "rule": r, "label": x} for t, r, x in [*row, (text[at:], None, None)]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc", "segments"])

    return docs.select("doc", "text").mapInArrow(run, f"doc {docs.schema['doc'].dataType.simpleString()}, segments {SEGMENTS}")


def find_identifiers(docs: DataFrame, names: list[str] | None = None, last: str = RULES[-1][0]) -> DataFrame:
    """docs(doc, text) as doc, segments and finds (array of struct rule, pos, label, original). Names given come first, the longest first; all
    places of a name are one replacement. A null text is empty; rows that repeat a doc are rows of their own. last: the rule that is the last to be
    applied; those behind it can't change what it finds."""
    out = _named(spread(docs.select("doc", "text")), names or [])
    rules = RULES[: 1 + [label for label, _ in RULES].index(last)]
    for rule, (label, pattern) in enumerate(rules):
        out = out.withColumn("segments", _cut(F.col("segments"), rule, label, pattern))
    taken = F.filter("segments", lambda s: s["label"].isNotNull())
    find = lambda s, pos: F.struct(s["rule"].alias("rule"), pos.alias("pos"), s["label"].alias("label"), s["text"].alias("original"))
    given = F.array_sort(F.array_distinct(F.transform(F.filter("_taken", lambda s: s["rule"] < 0), lambda s: find(s, F.lit(0)))))

    def of(rule: int) -> Column:
        return F.transform(F.filter("_taken", lambda s: s["rule"] == rule), lambda s, i: find(s, i))

    by_rule = map(of, range(len(rules)))
    return out.withColumn("_taken", taken).withColumn("finds", F.concat(given, *by_rule)).drop("_taken")


def _values(found: DataFrame) -> DataFrame:
    rows = found.select("doc", F.explode("finds").alias("f")).select("doc", "f.*")
    return rows.withColumn("value", strip(F.col("original")))


def token(label: Column, number: Column) -> Column:
    return F.concat(F.lit("["), label, F.lit("_"), number.cast("string"), F.lit("]"))


def pseudonyms(found: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """label, value, token, number of each value: those of known(label, value, number), and for others numbers of their own behind them by first
    appearance over documents in order, then rules, then places, then values."""
    first = _values(found).groupBy("label", "value").agg(F.min(F.struct("doc", "rule", "pos")).alias("first"))
    if known is not None:
        first = first.join(known.select("label", "value"), ["label", "value"], "left_anti")
    rows = numbered(first, [F.col("first"), F.col("value")], "number", "label").select("label", "value", F.col("number").cast("long").alias("number"))
    if known is not None:
        last = known.groupBy("label").agg(F.max("number").alias("last"))  # a row for each label
        rows = rows.join(last, "label", "left").select("label", "value", (F.col("number") + F.coalesce("last", F.lit(0))).alias("number"))
        rows = rows.unionByName(known.select("label", "value", "number"))
    return rows.select("label", "value", token(F.col("label"), F.col("number")).alias("token"), "number")


def kept_pseudonyms(spark: SparkSession, path: str) -> DataFrame:
    """label, value, number of all values that runs have kept in a folder."""
    _, found = last_version(spark, path)
    schema = "label string, value string, number long"
    return spark.read.schema(schema).parquet(*(f"{path}/{p}" for p in found["parts"])) if found else spark.createDataFrame([], schema)


def keep_pseudonyms(found: DataFrame, path: str) -> DataFrame:
    """pseudonyms() of finds, going on from those kept in a folder; new values are added to it as a part of its own. Two runs that add at the same
    time can't both commit: the second fails and is to be run again."""
    spark = found.sparkSession
    version, before = last_version(spark, path)
    known = kept_pseudonyms(spark, path)
    every = pseudonyms(found, known)
    part = f"part-{version + 1:06d}-{uuid.uuid4().hex[:8]}"
    every.join(known.select("label", "value"), ["label", "value"], "left_anti").select("label", "value", "number").write.parquet(f"{path}/{part}")
    commit_version(spark, path, version + 1, {"parts": [*(before or {"parts": []})["parts"], part]})
    rows = kept_pseudonyms(spark, path)
    return rows.select("label", "value", token(F.col("label"), F.col("number")).alias("token"), "number")


def replacements(found: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """doc, rule, pos, label, original, token of every replacement."""
    tokens = pseudonyms(found) if tokens is None else tokens
    return _values(found).join(tokens, ["label", "value"]).select("doc", "rule", "pos", "label", "original", "token")


def scrub(docs: DataFrame, names: list[str] | None = None, keep: str | None = None, dry_run: bool = False) -> DataFrame:
    """doc, scrubbed: each find replaced by its token; one row for each row of docs. keep names a folder whose numbers hold over all runs that name
    it. A dry run gives anonymisation_report() instead and keeps nothing. Finds are stored, for they number the values and are replaced by them;
    only rows with finds meet the tokens, and no other text is moved."""
    found = stored(find_identifiers(docs, names).withColumn("row", F.monotonically_increasing_id()), "identifiers")
    if dry_run:
        return anonymisation_report(found, kept_pseudonyms(docs.sparkSession, keep) if keep else None)
    tokens = keep_pseudonyms(found, keep) if keep else pseudonyms(found)
    held = found.where(F.size("finds") > 0)
    key = lambda label, text: F.concat(label, F.lit(":"), text)
    values = held.select("row", F.explode("finds").alias("f")).select("row", "f.label", "f.original").distinct().withColumn("value", strip(F.col("original")))
    by_row = values.join(tokens, ["label", "value"]).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(key(F.col("label"), F.col("original")), F.col("token")))).alias("tokens"))
    put = F.transform("segments", lambda s: F.when(s["label"].isNull(), s["text"]).otherwise(F.element_at("tokens", key(s["label"], s["text"]))))
    changed = held.join(by_row, "row").select("doc", F.array_join(put, "").alias("scrubbed"))
    plain = found.where(F.size("finds") == 0).select("doc", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("scrubbed"))
    return plain.unionByName(changed)


def anonymisation_report(found: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc, label, original, token without repeats in a document, with total, all replacements of the document."""
    found = stored(found.select("doc", "finds"), "finds")
    rows = replacements(found, pseudonyms(found, known))
    total = rows.groupBy("doc").agg(F.count("*").alias("total"))
    return rows.dropDuplicates(["doc", "label", "original"]).select("doc", "label", "original", "token").join(total, "doc")


def leaks(docs: DataFrame) -> DataFrame:
    """doc, kind, hit of every shape that should not be there any more."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("text", F.lit(p), 0).alias("hits")) for k, p in LEAKS])
    rows = docs.select("doc", F.explode(kinds).alias("k"))
    return rows.select("doc", "k.kind", F.explode("k.hits").alias("hit"))
