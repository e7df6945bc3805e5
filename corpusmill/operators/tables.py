"""Tables found in text: pipe tables to rows, rows to a dataset, numbers to groups for charts; and summary files back to records.

Rows keep their columns as an ordered array of key and value, because tables of different documents have different heads.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import parse_number
from ..functions.text import begins_with, once, squeeze, strip
from ..storage import numbered

ENTRIES = "array<struct<key:string,value:string>>"


#: White space and line ends as functions.text.strip() and its patterns count them; a separator line, which a line end of another kind may follow.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_END, RULE = re.compile(r"\r\n|[\n\r\x0b\f]"), re.compile(r"[-: ]*[\x85\u2028\u2029]?\Z")
#: Rows of tables in a batch.
ROWS = 4096


def _cells(line: str) -> list[str]:
    return [c.strip(BLANKS) for c in line.strip(BLANKS).strip("|").split("|")]


def _tables(text: str | None) -> Iterator[tuple[list[str], list[str]]]:
    """(heads, cells) of each row of each table in a text, line by line. The head of a run of lines with bars is its first one that a separator
    follows; what comes two lines later are its rows, up to the run's end."""
    lines = LINE_END.split(text) if text is not None else []
    head, keys = None, []
    for n, line in enumerate(lines):
        if not line.lstrip(BLANKS).startswith("|"):
            head = None
        elif head is None:
            if n + 1 < len(lines) and RULE.match(lines[n + 1].strip(" ").replace("|", "")):
                head, keys = n, _cells(line)
        elif n > head + 1:
            yield keys, _cells(line)


def pipe_rows(docs: DataFrame) -> DataFrame:
    """doc, row_no (from 0, over all tables of a document), entries of docs(doc, text). A table is a line that begins with a bar, a separator
    line, and the lines with bars after it. Short rows are filled with empty cells, long ones cut; what else stands there is left out. Texts are read
    where they lie, one after another, so nothing is sorted; a doc that repeats is a document of its own each time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, numbers, keys, values, ends = [], [], [], [], [0]

            def out() -> pa.RecordBatch:
                entries = pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string())], names=["key", "value"])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(numbers, pa.int32()), lists], names=["doc", "row_no", "entries"])

            for i, text in enumerate(batch.column(1)):
                for row_no, (heads, cells) in enumerate(_tables(text.as_py())):
                    at.append(i)
                    numbers.append(row_no)
                    keys += heads
                    values += (cells + [""] * (len(heads) - len(cells)))[: len(heads)]
                    ends.append(len(keys))
                    if len(at) == ROWS:
                        yield out()
                        at, numbers, keys, values, ends = [], [], [], [], [0]
            if at:
                yield out()

    return docs.select("doc", "text").mapInArrow(run, f"doc {docs.schema['doc'].dataType.simpleString()}, row_no int, entries {ENTRIES}")


def as_map(entries: Column) -> Column:
    """Entries as a map; of equal keys the last counts."""
    last = lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda f: f["key"] == e["key"]))
    return F.map_from_entries(once(entries, last))


def dataset(rows: DataFrame) -> DataFrame:
    """doc, row_no, category, numeric (key, text, number) of rows(doc, row_no, entries) that have a category, their first column, and at least
    one number in another; cells that aren't numbers are left out."""
    category = strip(F.get("entries", F.lit(0))["value"])
    others = F.transform(F.slice("entries", F.lit(2), F.size("entries")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("text"), parse_number(e["value"]).alias("number")))
    out = rows.select("doc", "row_no", category.alias("category"), F.filter(others, lambda e: e["number"].isNotNull()).alias("numeric"))
    return out.filter("category <> '' and size(numeric) > 0")


def chart_groups(flat: DataFrame, parts: int | None = None) -> DataFrame:
    """doc, category, value, first_seen of a dataset: the first number of each row; a category that a document repeats keeps the last. Given parts
    (storage.parts_of), documents are dealt to so many partitions, once for this and for what groups by document after it."""
    rows = flat.select("doc", "category", "row_no", F.get("numeric", F.lit(0))["number"].alias("number"))
    rows = rows.repartition(parts, "doc") if parts else rows
    return rows.groupBy("doc", "category").agg(F.max_by("number", "row_no").alias("value"), F.min("row_no").alias("first_seen"))


def category_order(groups: DataFrame) -> DataFrame:
    """category, place: all categories by first appearance, documents in order of their names. groups(doc, category, first_seen) are those of
    chart_groups(), or rows of a dataset as they are: a category's first row is the first of its groups."""
    first = groups.groupBy("category").agg(F.min(F.struct("doc", "first_seen")).alias("first"))
    return numbered(first, [F.col("first")], "place").select("category", "place")


def pivot_groups(groups: DataFrame, categories: list[str]) -> DataFrame:
    """A row a document and a column a category; what is missing counts 0."""
    return groups.groupBy("doc").pivot("category", categories).agg(F.first("value")).na.fill(0.0)


def parse_summary_a(text: Column) -> Column:
    """Struct(title, fields, summary, keywords) of a rendered record: title line, two-cell rows (escaped bars kept), sections up to a rule."""
    title = F.nullif(strip(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1)), F.lit(""))
    line = F.transform(F.filter(F.split(text, r"\r?\n"), lambda x: begins_with(x, "|")), strip)
    inside = lambda x: F.transform(F.split(F.substring(x, F.lit(2), F.length(x) - 2), r"(?<!\\)\|"), strip)
    rows = F.filter(F.transform(line, inside), lambda c: (F.size(c) == 2) & ~c[0].isin("Field", "") & ~c[0].rlike("^[-: ]+$"))
    fields = as_map(F.transform(rows, lambda c: F.struct(c[0].alias("key"), F.replace(c[1], F.lit("\\|"), F.lit("|")).alias("value"))))
    words = F.filter(F.transform(F.split(_section(text, "keywords"), ";"), strip), lambda k: k != "")
    return F.struct(title.alias("title"), fields.alias("fields"), _section(text, "summary").alias("summary"), words.alias("keywords"))


def _section(text: Column, name: str) -> Column:
    """The last section of this name, to the next head or rule; null where there is none."""
    blocks = F.split(F.concat(F.lit("\n"), text), r"(?m)^##\s+")
    mine = F.filter(blocks, lambda b, i: (i > 0) & (F.lower(strip(F.substring_index(b, "\n", 1))) == name))
    last = once(mine, lambda m: F.when(F.size(m) > 0, F.element_at(m, -1)))
    return strip(F.element_at(F.split(F.regexp_replace(last, r"^[^\n]*\n?", ""), r"(?m)^\s*---\s*$", 2), 1))


def parse_summary_b(text: Column, labels: tuple[str, ...]) -> Column:
    """Struct(title, fields, summary, keywords, method, status): a row by label, sections on one line, method and status of the foot."""
    title = F.nullif(F.regexp_extract(text, r"(?m)^#\s+(.+?)\s*$", 1), F.lit(""))
    row = lambda n: rf"(?m)^\|\s*\Q{n}\E\s*\|\s*(.*?)\s*\|\s*$"
    found = F.array(*[F.struct(F.lit(n).alias("key"), F.when(text.rlike(row(n)), F.regexp_extract(text, row(n), 1)).alias("value")) for n in labels])
    fields = F.map_from_entries(F.filter(found, lambda e: e["value"].isNotNull()))
    foot = r"(?m)Method:\s*(.*?)\s*\|\s*Status:\s*(.+?)\s*$"
    words = F.filter(F.transform(F.split(_section(text, "keywords"), ";"), strip), lambda k: k != "")
    return F.struct(title.alias("title"), fields.alias("fields"), squeeze(_section(text, "summary")).alias("summary"), words.alias("keywords"), F.regexp_extract(text, foot, 1).alias("method"), F.regexp_extract(text, foot, 2).alias("status"))
