"""Many fixed strings looked for at once: one pass over a text, however many there are.

The strings become an automaton that finds all their places, overlapping ones too, in time that grows with the text and the places. A set that is too
large for one automaton is cut into slices, each with a pass of its own, so a task's memory has a bound.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Characters of the strings in one automaton.
SLICE_CHARS = 1 << 22


def automaton(needles: list[str]):
    """Finds (last place, number) of every occurrence of every string; None without strings. Equal strings have one number, the last."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, needle in enumerate(needles):
        if needle:
            a.add_word(needle, i)
    if not len(a):
        return None
    a.make_automaton()
    return a


def is_word(c: str) -> bool:
    """Letters, digits, marks and joining punctuation, as word boundaries count them."""
    return c.isalnum() or c == "_" or unicodedata.category(c) in ("Mn", "Mc", "Me", "Pc") or c in "‌‍"


def alone(text: str, needles: list[str], a) -> list[tuple[int, int, int]]:
    """(start, end, number) of strings that stand between word boundaries. Where they overlap the string with the smaller number counts, of one
    string the first place; what is taken is no word for its neighbours."""
    found = sorted((n, end - len(needles[n]) + 1, end + 1) for end, n in a.iter(text)) if a is not None else []
    taken: list[tuple[int, int, int]] = []

    def word_at(i: int, i_taken: bool) -> bool:
        return 0 <= i < len(text) and not i_taken and is_word(text[i])

    for n, start, end in found:
        i = bisect_right(taken, (start, len(text) + 1, 0))
        before, behind = taken[i - 1] if i else None, taken[i] if i < len(taken) else None
        if (before and before[1] > start) or (behind and behind[0] < end):
            continue
        left = word_at(start - 1, bool(before) and before[1] == start) != is_word(text[start])
        right = word_at(end, bool(behind) and behind[0] == end) != is_word(text[end - 1])
        if left and right:
            insort(taken, (start, end, n))
    return taken


def slices(needles: DataFrame, key: str, needle: str) -> Iterator[list[tuple]]:
    """needles as lists of (key, string) of SLICE_CHARS characters in all, or one longer string; null and empty strings are left out."""
    rows = needles.select(F.col(key).alias("k"), F.col(needle).alias("s")).where("length(s) > 0")
    out, size = [], 0
    for k, s in rows.toLocalIterator():  # a partition at a time
        if out and size + len(s) > SLICE_CHARS:
            yield out
            out, size = [], 0
        out.append((k, s))
        size += len(s)
    if out:
        yield out


def holding(docs: DataFrame, key: str, text: str, needles: DataFrame, needle_key: str, needle: str) -> DataFrame:
    """(key, needle_key) of every text and string that it contains anywhere, once. Null texts hold nothing and null or empty strings are in
    nothing; texts stay where they are, only pairs are shuffled. Each slice of strings is one pass over the texts."""
    spark, out = docs.sparkSession, None
    schema = StructType([docs.schema[key], needles.schema[needle_key]])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    base = docs.select(F.col(key), F.col(text).alias("_text")).where("_text is not null")
    for part in slices(needles, needle_key, needle):
        shared = spark.sparkContext.broadcast(part)  # SLICE_CHARS at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            of: dict[str, list] = {}
            for k, s in shared.value:
                of.setdefault(s, []).append(k)
            strings = list(of)
            a = automaton(strings)
            for batch in batches:
                keys, found = [], []
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for i in {i for _, i in a.iter(t)}:
                        keys += [k] * len(of[strings[i]])
                        found += of[strings[i]]
                yield pa.RecordBatch.from_arrays([pa.array(keys, kinds[0]), pa.array(found, kinds[1])], names=schema.names)

        pairs = base.mapInArrow(run, schema)
        out = pairs if out is None else out.unionByName(pairs)
    return (spark.createDataFrame([], schema) if out is None else out).distinct()
