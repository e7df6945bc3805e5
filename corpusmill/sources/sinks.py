"""Outputs: passages and index, append-only logs, rendered records and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.payload import META_FIELDS
from ..functions.text import NOT_STATED, escape_cell, fill_template, flatten, html_escape, shortened, title_of_name, word_count
from ..functions.numbers import parse_number
from . import export


def write_passages(passages: DataFrame, path: str) -> None:
    """The index's passages as Parquet; the header (a row) and the passages can be exported as one document by export_index()."""
    passages.write.mode("overwrite").parquet(path)


def export_index(passages: DataFrame, built_at: str, source: str, size: int, overlap: int, embedding_model: str | None = None) -> DataFrame:
    """One row, json: the whole index nested in its header, for indexes that fit one document."""
    fields = [c for c in ("id", "doc", "title", "section", "text", "words", "embedding") if c in passages.columns]
    rows = passages.agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("chunks"), F.array_sort(F.collect_set("doc")).alias("documents"))
    head = [F.lit(built_at).alias("built_at"), F.lit(source).alias("source_folder"), "documents", F.lit(embedding_model).cast("string").alias("embedding_model"), F.lit(size).alias("target_words"), F.lit(overlap).alias("overlap_words")]
    return rows.select(F.to_json(F.struct(*head, "chunks"), {"ignoreNullFields": "false"}).alias("json"))


def write_index_document(passages: DataFrame, path: str, built_at: str, source: str, size: int, overlap: int, embedding_model: str | None = None) -> None:
    """The whole index as one JSON file, by document and id: the header's fields, then all passages as the list chunks. Tasks write the parts, so memory
    doesn't grow with the index; the documents are those that chunks name."""
    fields = [c for c in ("id", "doc", "title", "section", "text", "words", "embedding") if c in passages.columns]
    head = {"built_at": built_at, "source_folder": source, "embedding_model": embedding_model, "target_words": size, "overlap_words": overlap}
    rows = passages.select(*fields).repartitionByRange("doc", "id").sortWithinPartitions("doc", "id")
    export.write_json(rows, path, head, "chunks")


def write_index_file(files: DataFrame, path: str) -> None:
    """The summary index as one CSV file that spreadsheet programs open: a mark of UTF-8, one header, keywords joined, nulls empty."""
    export.write_csv(files.withColumn("keywords", F.array_join("keywords", "; ")) if dict(files.dtypes).get("keywords", "").startswith("array") else files, path)


def append_log(rows: DataFrame, path: str, time: str = "time") -> None:
    """Rows as JSON lines, in a folder a month; what is there stays."""
    rows.withColumn("yyyymm", F.date_format(F.col(time).cast("timestamp"), "yyyyMM")).write.mode("append").partitionBy("yyyymm").json(path)


def write_index_csv(files: DataFrame, path: str) -> None:
    """The summary index, rewritten as a whole: keywords joined, nulls empty."""
    rows = files.withColumn("keywords", F.array_join("keywords", "; ")) if dict(files.dtypes).get("keywords", "").startswith("array") else files
    rows.na.fill("").write.mode("overwrite").option("header", "true").option("quoteAll", "true").csv(path)


def render_record_a(record: Column, source: Column, agent: str, model: str, day: str, most: int = 80) -> Column:
    """A summary record as Markdown; without a title the file's name is one."""
    title = F.when(F.coalesce(record["title"], F.lit(NOT_STATED)) == NOT_STATED, F.regexp_replace(source, r"\.[^.]*$", "")).otherwise(record["title"])
    row = lambda label, value: F.concat(F.lit(f"| {label} | "), escape_cell(value), F.lit(" |"))
    words = F.coalesce(F.nullif(F.array_join(record["keywords"], "; "), F.lit("")), F.lit(NOT_STATED))
    labels = ("Issuing body", "Country / region", "Year", "Document type")
    foot = F.concat(F.lit("*Word count: "), word_count(record["summary"]).cast("string"), F.lit(f"/{most} | Generated: {day} | Agent: {agent} | Model: {model}*"))
    lines = [
        F.concat(F.lit("# "), flatten(title)), F.lit(""), F.lit("| Field | Value |"), F.lit("|---|---|"), row("Source file", source),
        *[row(label, record[key]) for label, key in zip(labels, META_FIELDS[1:])], F.lit(""), F.lit("## Summary"), F.lit(""), F.trim(record["summary"]),
        F.lit(""), F.lit("## Keywords"), F.lit(""), words, F.lit(""), F.lit("---"), F.lit(""), foot, F.lit(""),
    ]
    return F.concat_ws("\n", *lines)


def render_record_b(template: str, record: Column, source: Column, method: str, status: Column, day: str, most: int = 80) -> Column:
    """A template's place holders filled; in table fields bars become slashes."""
    bar = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("/"))
    values = {k: bar(record[k]) for k in META_FIELDS if k != "title"} | {
        "title": record["title"], "source_file": bar(source), "summary": record["summary"], "word_count": word_count(record["summary"]),
        "keywords": F.coalesce(F.nullif(F.array_join(record["keywords"], "; "), F.lit("")), F.lit(NOT_STATED)), "max_words": F.lit(most),
        "generated": F.lit(day), "method": F.lit(method), "status": status,
    }
    return fill_template(template, values, last="summary")


def export_text(pages: DataFrame) -> DataFrame:
    """doc and text with a head of source and number of pages."""
    head = F.concat(F.lit("SOURCE FILE: "), F.col("doc"), F.lit("\nPAGES: "), F.size("pages").cast("string"), F.lit("\n\n"))
    return pages.select("doc", F.concat(head, "text").alias("text"))


def markdown_table(rows: list[dict], columns: list[str], most: int = 160) -> str:
    """Collected rows of a small report as a pipe table; long cells are cut."""
    cut = lambda v: (s if len(s := " ".join(str("" if v is None else v).split())) <= most else s[:most] + "...").replace("|", "\\|")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(cut(r.get(c)) for c in columns) + " |" for r in rows)])


def html_rows(flat: DataFrame, columns: list[str]) -> DataFrame:
    """html of each row of a dataset: numbers stand right, and all text is escaped."""
    cells = [F.concat(F.when(parse_number(F.col(c)).isNotNull(), F.lit('<td class="n">')).otherwise(F.lit("<td>")), html_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns]
    return flat.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("html"))


def report(title: str, sections: dict[str, str], sources: list[str], provenance: str) -> dict[str, str]:
    """A report as Markdown and HTML; a part heads each source, and both say where the numbers come from."""
    parts = [f"# {title}", "", f"*{provenance}*", ""]
    for name in sources:
        parts += [f"### {name.rsplit('.', 1)[0].replace('_', ' ')}", "", sections.get(name, ""), ""]
    md = "\n".join(parts)
    mask = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    body = "".join(f"<h3>{mask(n.rsplit('.', 1)[0].replace('_', ' '))}</h3><p>{mask(sections.get(n, ''))}</p>" for n in sources)
    return {"md": md, "html": f"<!doctype html><meta charset=utf-8><title>{mask(title)}</title><h1>{mask(title)}</h1><p>{mask(provenance)}</p>{body}"}


def detail_cells(x: Column) -> Column:
    return shortened(flatten(x), 160)


def record_title(source: Column) -> Column:
    return title_of_name(source)
