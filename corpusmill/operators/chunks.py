"""Documents into passages: sections, word windows, packed paragraphs, boundary-seeking windows, even samples of chunks."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import padded_name, strip, word_count, words

#: Words of a window and of its overlap, and the section of text before any heading.
SIZE, OVERLAP, NO_SECTION = 180, 40, "(no section)"
HEADING = r"^(#{1,6})\s+(.*)$"


def sections(docs: DataFrame) -> DataFrame:
    """Rows doc, section_no, section, body of docs(doc, text): lines under each heading. Bodies are stripped; empty ones drop out."""
    lines = docs.select("doc", F.posexplode(F.split(F.col("text"), r"\r\n|[\n\r\x0B\f]")).alias("line_no", "line"))
    lines = lines.withColumn("heading", F.when(F.col("line").rlike(HEADING), strip(F.regexp_extract("line", HEADING, 2))))
    order = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section_no", F.count("heading").over(order))
    body = F.array_sort(F.collect_list(F.when(F.col("heading").isNull(), F.struct("line_no", "line"))))
    grouped = lines.groupBy("doc", "section_no").agg(F.max("heading").alias("section"), body.alias("body"))
    text = strip(F.array_join(F.transform("body", lambda s: s["line"]), "\n"))
    return grouped.select("doc", "section_no", F.coalesce("section", F.lit(NO_SECTION)).alias("section"), text.alias("body")).filter("body <> ''")


def window_array(w: Column, whole: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Overlapping windows of words w (a column that is there already: it is used once a window). At most size words are one window, the
    stripped text whole just as it is; no words give none."""
    step, n = max(size - overlap, 1), F.size(w)
    count = 1 + F.ceil(F.greatest(n - size, F.lit(0)) / step).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice(w, i * step + 1, F.lit(size)), " "))
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= size, F.array(whole)).otherwise(cut)


def word_windows(docs: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Rows key, window_no (from 0), window, words."""
    rows = docs.select(F.col(key), words(F.col(text)).alias("_w"), strip(F.col(text)).alias("_t"))
    rows = rows.select(key, F.posexplode(window_array(F.col("_w"), F.col("_t"), size, overlap)).alias("window_no", "window"))
    return rows.withColumn("words", word_count(F.col("window")))


def passages(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Passages of docs(doc, text): id doc#NNN (in order, from 000), doc, title, section, text, words. The title is the first line that isn't
    blank, where it is a heading, else the document's name."""
    first = F.element_at(F.split(F.regexp_replace("text", r"(?U)^\s+", ""), r"\r\n|[\n\r\x0B\f]", 2), 1)
    titles = docs.select("doc", F.when(first.rlike(HEADING), strip(F.regexp_extract(first, HEADING, 2))).otherwise(F.col("doc")).alias("title"))
    split = sections(docs).withColumn("_w", words(F.col("body")))
    cut = split.select("doc", "section_no", "section", F.posexplode(window_array(F.col("_w"), F.col("body"), size, overlap)).alias("window_no", "text"))
    number = F.row_number().over(Window.partitionBy("doc").orderBy("section_no", "window_no")) - 1
    cut = cut.withColumn("chunk_no", number).join(titles, "doc")
    return cut.select(padded_name(F.col("doc"), F.col("chunk_no")).alias("id"), "doc", "title", "section", "text", word_count(F.col("text")).alias("words"), "chunk_no")


def _pieces(text: str, size: int, overlap: int) -> Iterator[tuple[str, bool]]:
    """Paragraphs that aren't blank. One over size comes in strips of size, each overlapping the last; all but the rest stand alone."""
    for paragraph in filter(str.strip, re.split(r"\n\s*\n", text)):
        strips = max(0, -(-(len(paragraph) - size) // (size - overlap)))
        for i in range(strips):
            yield paragraph[i * (size - overlap) :][:size], True
        yield paragraph[strips * (size - overlap) :], False


def _pack_paragraphs(text: str, size: int, overlap: int) -> Iterator[str]:
    """Pieces are gathered while they fit. The tail of a full chunk begins the next one, which may so exceed size; strips that stand alone
    neither take nor leave a tail."""
    gathered: list[str] = []
    for piece, alone in _pieces(text, size, overlap):
        chunk = "\n\n".join(gathered)
        if chunk and (alone or len(chunk) + 2 + len(piece) > size):
            yield chunk
            gathered = [chunk[-overlap:]] if overlap and not alone else []
        if alone:
            yield piece
        else:
            gathered.append(piece)
    if (chunk := "\n\n".join(gathered)).strip():
        yield chunk


def _seek_boundaries(text: str, size: int, overlap: int) -> Iterator[str]:
    """All places where a chunk may end are found first; a chunk then ends at the last one in its second half, a blank line before a full stop."""
    ends = [[m.start() for m in re.finditer(mark, text)] for mark in (r"(?=\n\n)", r"(?=\. )")]
    start, last = 0, len(text)
    while start < last:
        stop = start + size
        if stop < last:
            near = (places[bisect_right(places, stop - 2) - 1] for places in ends if places and places[0] <= stop - 2)
            stop = next((place + 1 for place in near if place >= start + size // 2), stop)
        if piece := text[start:stop].strip():
            yield piece
        start = last if stop >= last else max(stop - overlap, start + 1)


def _folded(docs: DataFrame, key: str, text: str, cut, size: int, overlap: int) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = [(k, i, c) for k, t in zip(batch[key], batch[text]) for i, c in enumerate(cut(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "chunk"]).astype({"chunk_no": "int32"})

    return docs.select(key, text).mapInPandas(run, f"`{key}` {kind}, chunk_no int, chunk string")


def packed_paragraphs(docs: DataFrame, key: str, text: str, size: int = 6000, overlap: int = 300) -> DataFrame:
    """Chunks of whole paragraphs; each step depends on what the one before left over, so documents are folded in Arrow batches."""
    return _folded(docs, key, text, _pack_paragraphs, size, overlap)


def boundary_windows(docs: DataFrame, key: str, text: str, size: int = 12000, overlap: int = 300) -> DataFrame:
    """Chunks cut at blank lines or sentence ends; where one begins depends on where the last was cut."""
    return _folded(docs, key, text, _seek_boundaries, size, overlap)


def sampled_places(n: Column, most: int, profile: str = "head") -> Column:
    """Which of n chunks (numbers from 0) are kept, as an array, where there are more than most. head keeps the first two and takes the rest at
    rounded-down steps; ends keeps the first and the last, with steps rounded half to even."""
    if profile == "head":
        slots = most - 2
        first = F.array(*[F.lit(i) for i in range(min(2, max(most, 2)))])
        if slots <= 0:
            return first
        return F.concat(first, F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: (F.floor(i * ((n - 2) / float(slots))) + 2).cast("int")))
    most = max(2, most)
    return F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * ((n - 1) / float(most - 1))).cast("int"))


def even_sample(chunks: DataFrame, key: str, number: str, most: int, profile: str = "head") -> DataFrame:
    """At most most chunks of each key, evenly spread (see sampled_places). number counts from 0 without gaps."""
    if profile == "head" and most <= 0:
        return chunks
    n, limit = F.count("*").over(Window.partitionBy(key)).cast("int"), most if profile == "head" else max(2, most)
    rows = chunks.withColumn("_n", n)
    return rows.filter((F.col("_n") <= limit) | F.array_contains(sampled_places(F.col("_n"), most, profile), F.col(number).cast("int"))).drop("_n")


def sampled_windows(docs: DataFrame, key: str, text: str, most: int, profile: str = "head", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """word_windows() of which even_sample() keeps most at most. A document's windows are counted where they are cut, so nothing is shuffled."""
    rows = docs.select(F.col(key), words(F.col(text)).alias("_w"), strip(F.col(text)).alias("_t"))
    rows = rows.select(key, window_array(F.col("_w"), F.col("_t"), size, overlap).alias("_a"))
    n, limit = F.size("_a"), most if profile == "head" else max(2, most)
    every = F.transform(F.col("_a"), lambda w, i: F.struct(i.alias("window_no"), w.alias("window")))
    some = F.filter(every, lambda s: F.array_contains(sampled_places(n, most, profile), s["window_no"]))
    kept = every if profile == "head" and most <= 0 else F.when(n <= limit, every).otherwise(some)
    return rows.select(key, F.inline(kept)).withColumn("words", word_count(F.col("window")))
