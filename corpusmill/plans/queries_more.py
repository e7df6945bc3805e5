"""Named queries over the driver tables with equal SQL: tables and datasets, evaluation, lookups, loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalogue import query
from ..functions import numbers, payload, text
from ..operators import chunks, evaluation, patterns, retrieval, tables, validation
from ..session import table
from ..storage import numbered, parts_of, spread, stored
from . import loops, models, sql_texts
from .queries import BM25, GATE, OBJECTIVE, REASON, count_sql

#: Orders and their lines as documents with a heading, some text and a pipe table, for the parsers.
MARKDOWN = """
items AS (SELECT l_orderkey AS doc, l_linenumber, l_partkey % 7 AS part, CAST(l_quantity AS INTEGER) AS q, '| part ' || l_partkey % 7 || ' | ' || CAST(l_quantity AS INTEGER) || ' | ' ||
    CASE WHEN l_linenumber % 3 = 0 THEN 'n/a' ELSE CAST(l_quantity AS INTEGER) * 2 || ',5' END || ' |' AS t FROM lineitem),
lines AS (SELECT doc, string_agg(t, e'\\n' ORDER BY l_linenumber, t) AS body FROM items GROUP BY doc),
md AS (SELECT doc, '# Order ' || doc || e'\\n\\nSome text.\\n\\n## Lines\\n\\n| Part | Count | Twice |\\n|---|---:|---|\\n' || body || e'\\n\\n## End\\nDone.' AS text FROM lines)"""
#: Rows of those tables, straight from the lines.
ROWS = (
    MARKDOWN
    + """,
rows AS (SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY l_linenumber, t) - 1 AS INTEGER) AS row_no, 'part ' || part AS category,
    CAST(q AS DOUBLE) AS first_number, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE q * 2 + 0.5 END AS second_number FROM items)"""
)


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity = F.col("l_quantity").cast("int")
    twice = F.when(F.col("l_linenumber") % 3 == 0, "n/a").otherwise(F.concat((quantity * 2).cast("string"), F.lit(",5")))
    line = F.concat(F.lit("| part "), (F.col("l_partkey") % 7).cast("string"), F.lit(" | "), quantity.cast("string"), F.lit(" | "), twice, F.lit(" |"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), "l_linenumber", "l_partkey", "l_quantity")
    rows = lines.repartition(parts_of(lines), "doc").groupBy("doc")  # dealt out before they are collected, in partitions that stay small
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("t")))), lambda s: s["t"]), "\n")
    head = F.concat(F.lit("# Order "), F.col("doc").cast("string"), F.lit("\n\nSome text.\n\n## Lines\n\n| Part | Count | Twice |\n|---|---:|---|\n"))
    return rows.agg(body.alias("body")).select("doc", F.concat(head, "body", F.lit("\n\n## End\nDone.")).alias("text"))


@query(
    "pipe_table_rows",
    f"WITH {ROWS} SELECT doc, row_no, 'Part=' || category || ';Count=' || CAST(first_number AS INTEGER) || ';Twice=' || coalesce(CAST(CAST(second_number - 0.5 AS INTEGER) AS VARCHAR) || ',5', 'n/a') AS cells FROM rows",
)
def pipe_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.pipe_rows(_markdown(spark, sf_dir))
    return rows.select("doc", "row_no", F.array_join(F.transform("entries", lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("cells"))


@query(
    "dataset_rows",
    f"WITH {ROWS} SELECT doc, row_no, category, first_number, second_number FROM rows",
)
def dataset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = tables.dataset(tables.pipe_rows(_markdown(spark, sf_dir)))
    number = lambda key: F.get(F.filter("numeric", lambda e: e["key"] == key), F.lit(0))["number"]
    return flat.select("doc", "row_no", "category", number("Count").alias("first_number"), number("Twice").alias("second_number"))


@query(
    "dataset_long_pivot",
    f"""WITH {ROWS}, g AS (SELECT doc, category, arg_max(first_number, row_no) AS value FROM rows GROUP BY ALL)
    SELECT doc, {', '.join(f"coalesce(max(value) FILTER (category = 'part {i}'), 0) AS part{i}" for i in range(7))} FROM g GROUP BY doc""",
)
def dataset_long_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = tables.dataset(tables.pipe_rows(_markdown(spark, sf_dir)))
    groups = tables.chart_groups(flat, parts_of(table(spark, sf_dir, "lineitem")))
    out = tables.pivot_groups(groups, [f"part {i}" for i in range(7)])
    return out.toDF("doc", *[f"part{i}" for i in range(7)])


@query(
    "category_order",
    f"WITH {ROWS}, f AS (SELECT category, min((doc, row_no)) AS first FROM rows GROUP BY category) SELECT category, row_number() OVER (ORDER BY first) AS place FROM f",
)
def category_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = tables.dataset(tables.pipe_rows(_markdown(spark, sf_dir)))
    return tables.category_order(flat.withColumn("first_seen", F.col("row_no"))).select("category", F.col("place").cast("long").alias("place"))


@query(
    "section_passages",
    f"""WITH {MARKDOWN}, parts AS (SELECT doc, 0 AS k, '(no section)' AS section, '' AS body FROM md UNION ALL
      SELECT doc, 1, 'Order ' || doc, 'Some text.' FROM md UNION ALL SELECT doc, 2, 'Lines', e'| Part | Count | Twice |\\n|---|---:|---|\\n' || body FROM lines UNION ALL SELECT doc, 3, 'End', 'Done.' FROM md)
    SELECT doc || '#' || lpad(CAST(row_number() OVER (PARTITION BY doc ORDER BY k) - 1 AS VARCHAR), 3, '0') AS id, section, 'Order ' || doc AS title, md5(body) AS digest, {count_sql('body')}::BIGINT AS words FROM parts WHERE body <> ''""",
)
def section_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks.passages(_markdown(spark, sf_dir).withColumn("doc", F.col("doc").cast("string")))
    return rows.select("id", "section", "title", F.md5(F.col("text").cast("binary")).alias("digest"), "words")


@query("packed_paragraphs", sql_texts.PACKED)
def packed_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks.packed_paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text", 2000, 100)
    return rows.select("doc_id", "chunk_no", F.md5(F.col("chunk").cast("binary")).alias("digest"))


@query("boundary_windows", sql_texts.SOUGHT)
def boundary_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks.boundary_windows(table(spark, sf_dir, "documents"), "doc_id", "text", 4000, 100)
    return rows.select("doc_id", "chunk_no", F.md5(F.col("chunk").cast("binary")).alias("digest"))


@query(
    "number_parse",
    """WITH s AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(CAST(floor(o_totalprice) AS INTEGER) AS VARCHAR) WHEN 1 THEN CAST(CAST(floor(o_totalprice) AS INTEGER) // 1000 AS VARCHAR) || ',' || lpad(CAST(CAST(floor(o_totalprice) AS INTEGER) % 1000 AS VARCHAR), 3, '0') || '.5'
      WHEN 2 THEN CAST(CAST(floor(o_totalprice) AS INTEGER) // 1000 AS VARCHAR) || ' ' || lpad(CAST(CAST(floor(o_totalprice) AS INTEGER) % 1000 AS VARCHAR), 3, '0') || ',5' WHEN 3 THEN o_orderpriority ELSE '12%' END AS t FROM orders)
    SELECT o_orderkey, try_cast(CASE WHEN contains(t, ',') AND contains(t, '.') THEN replace(replace(t, ' ', ''), ',', '') ELSE replace(replace(t, ' ', ''), ',', '.') END AS DOUBLE) AS number FROM s""",
)
def number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, kind = F.col("o_totalprice").cast("int"), F.col("o_orderkey") % 5
    high, low = (whole / 1000).cast("int").cast("string"), F.lpad((whole % 1000).cast("string"), 3, "0")
    written = (
        F.when(kind == 0, whole.cast("string")).when(kind == 1, F.concat(high, F.lit(","), low, F.lit(".5"))).when(kind == 2, F.concat(high, F.lit(" "), low, F.lit(",5")))
        .when(kind == 3, F.col("o_orderpriority")).otherwise("12%")
    )
    rows = table(spark, sf_dir, "orders").filter("o_totalprice is not null")
    rows = rows.withColumn("o_totalprice", F.floor("o_totalprice"))
    return rows.select("o_orderkey", numbers.parse_number(written).alias("number"))


DAILY = "daily AS (SELECT event_type, CAST(ts AS DATE) AS day, round(avg(value), 6) AS score FROM events GROUP BY ALL), scaled AS (SELECT event_type, day, score / (SELECT max(score) FROM daily) AS score FROM daily)"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("score"))
    top = daily.agg(F.max("score").alias("top"))
    return daily.crossJoin(F.broadcast(top)).select("event_type", "day", (F.col("score") / F.col("top")).alias("score"))  # one row


@query(
    "impact_gate_replay",
    f"""WITH {DAILY}, b AS (SELECT *, greatest(0.1, coalesce(max(score) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.1)) AS best_before FROM scaled)
    SELECT event_type, day, round(score, 6) AS score, round(best_before, 6) AS best_before, score > best_before AS kept FROM b WHERE best_before < 1""",
)
def impact_gate_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.gate_replay(_daily(spark, sf_dir), F.lit(0.1), "event_type", "day")
    return rows.select("event_type", "day", F.round("score", 6).alias("score"), F.round("best_before", 6).alias("best_before"), "kept")


@query(
    "impact_final_scores",
    f"""WITH {DAILY}, b AS (SELECT *, greatest(0.1, coalesce(max(score) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.1)) AS best_before FROM scaled)
    SELECT event_type, round(coalesce(max(score) FILTER (score > best_before), 0.1), 6) AS final_score, count(*) FILTER (score > best_before) AS kept_runs, count(*) FILTER (score <= best_before) AS rolled_back FROM b WHERE best_before < 1 GROUP BY event_type""",
)
def impact_final_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.gate_replay(_daily(spark, sf_dir), F.lit(0.1), "event_type", "day")
    out = evaluation.final_scores(rows, F.lit(0.1), "event_type")
    return out.withColumn("final_score", F.round("final_score", 6))


STATUS_SQL = "CASE WHEN len(trim(text)) < 300 THEN 'skipped' WHEN doc_id % 10 = 0 THEN 'needs_review' ELSE 'ok' END"


@query(
    "status_histogram",
    f"WITH b(status) AS (VALUES ('ok'), ('auto_trimmed'), ('needs_review'), ('skipped'), ('failed')) SELECT b.status, count(d.s) AS n FROM b LEFT JOIN (SELECT {STATUS_SQL} AS s FROM documents) d ON d.s = b.status GROUP BY b.status",
)
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.length(F.trim("text")) < 300, "skipped").when(F.col("doc_id") % 10 == 0, "needs_review").otherwise("ok")
    return evaluation.status_histogram(table(spark, sf_dir, "documents").select(status.alias("status")))


@query(
    "grouped_pass_rates",
    "SELECT source, lang, count(*) FILTER (quality = 1) AS passed_n, count(*) AS total FROM labels JOIN documents USING (doc_id) GROUP BY ALL",
)
def grouped_pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").withColumn("passed", F.col("quality") == 1)
    return evaluation.pass_counts(rows, ["source", "lang"])


@query("mean_score_by_source", "SELECT source, round(sum(quality) / greatest(count(*), 1), 6) AS mean_score FROM labels JOIN documents USING (doc_id) GROUP BY source")
def mean_score_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    out = evaluation.mean_score(rows, ["source"], "quality")
    return out.withColumn("mean_score", F.round("mean_score", 6))


@query(
    "first_acceptable_turn",
    f"""WITH a AS (SELECT conv_id, turn, text, {count_sql('text')} AS n FROM conversations WHERE role = 'assistant')
    SELECT conv_id, coalesce(min(turn) FILTER (n BETWEEN 10 AND 60), max(turn) FILTER (n >= 10)) AS turn,
      coalesce(arg_min(text, turn) FILTER (n BETWEEN 10 AND 60), arg_max(text, turn) FILTER (n >= 10)) AS text,
      CASE WHEN count(*) FILTER (n BETWEEN 10 AND 60) > 0 THEN 'ok' WHEN count(*) FILTER (n >= 10) > 0 THEN 'fallback' ELSE 'none' END AS status FROM a GROUP BY conv_id""",
)
def first_acceptable_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("role = 'assistant'").withColumn("n", text.word_count(F.col("text")))
    return evaluation.first_acceptable(rows, "conv_id", "turn", F.when(F.col("n") > 60, 1).otherwise(0), F.col("n") >= 10, "text")


@query(
    "non_worsening_revision",
    f"""WITH a AS (SELECT conv_id, turn, abs({count_sql('text')} - 50)::BIGINT AS problems FROM conversations), m AS (SELECT *, min(problems) OVER (PARTITION BY conv_id ORDER BY turn) AS best FROM a)
    SELECT conv_id, max(turn) AS turn, arg_max(problems, turn) AS problems FROM m WHERE problems = best GROUP BY conv_id""",
)
def non_worsening_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.abs(text.word_count(F.col("text")) - 50).alias("problems"), F.col("turn").alias("ord"))
    return evaluation.non_worsening(rows, "conv_id", "ord", "problems", "turn")


@query("last_finished_turn", "SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def last_finished_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("data", F.when(F.col("role") == "assistant", F.col("text")))
    return evaluation.last_finished(rows, "conv_id", "turn", "data").withColumnRenamed("data", "text")


@query("newest_run", "SELECT max(strftime(ts, '%Y%m%d-%H%M%S')) AS run FROM events")
def newest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.newest(table(spark, sf_dir, "events").select(F.date_format("ts", "yyyyMMdd-HHmmss").alias("run")), "run")


@query(
    "run_log_months",
    "SELECT strftime(ts, '%Y%m') AS month, count(*) AS runs, round(sum(value), 3) AS seconds, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
)
def run_log_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyyMM").alias("month"))
    return rows.agg(F.count("*").alias("runs"), F.round(F.sum("value"), 3).alias("seconds"), F.countDistinct("user_id").alias("users"))


@query(
    "document_lookup_with_default",
    "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def document_lookup_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query("skip_finished", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def skip_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "labels").filter("quality = 1")
    return loops.skip_done(table(spark, sf_dir, "documents"), done, "doc_id").select("doc_id")


@query(
    "minimum_text_filter",
    "SELECT doc_id, CASE WHEN len(trim(text)) < 300 THEN 'skipped' ELSE 'kept' END AS profile_a, CASE WHEN len(trim(text)) < 200 THEN 'skipped' ELSE 'kept' END AS profile_b FROM documents",
)
def minimum_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length(F.trim("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(n < 300, "skipped").otherwise("kept").alias("profile_a"), F.when(n < 200, "skipped").otherwise("kept").alias("profile_b"))


@query(
    "substring_semi_join",
    "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM (VALUES ('Licensed under'), ('idiot'), ('password')) v(t) WHERE contains(d.text, v.t))",
)
def substring_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = ("Licensed under", "idiot", "password")
    hit = F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.col("text"), t))
    return table(spark, sf_dir, "documents").filter(hit).select("doc_id")


@query(
    "benchmark_in_documents",
    "SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''",
)
def benchmark_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document holds which benchmark text: all texts of one table looked for in all of the other, in one pass."""
    return patterns.holding(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


@query(
    "documents_without_benchmark",
    "SELECT lang, count(*) AS documents FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text <> '' AND contains(d.text, b.text)) GROUP BY lang",
)
def documents_without_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = patterns.holding(docs, "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return docs.select("doc_id", "lang").join(held.select("doc_id").distinct(), "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("documents"))


#: A page's references: those in it, and each of them from some folders further up, up to ten.
REFERENCES = """regexp_extract_all(html, 'href="([^"]*)"', 1)"""
RESOLVED = f"""p AS (SELECT page_id, url, unnest({REFERENCES}) AS h FROM pages),
r AS (SELECT page_id, url, unnest([h, repeat('../', length(h) % 11) || './x/' || h, '?q=' || h, '#' || h, '//other.example/a/../b' || h]) AS link FROM p),
f AS (SELECT *, regexp_extract(link, '^(//[^/?#]*)?([^?#]*)(\\?[^#]*)?', 1) AS host, regexp_extract(link, '^(//[^/?#]*)?([^?#]*)(\\?[^#]*)?', 2) AS path, regexp_extract(link, '^(//[^/?#]*)?([^?#]*)(\\?[^#]*)?', 3) AS query,
  regexp_extract(url, '^([^:]+:)(//[^/?#]*)([^?#]*)(\\?[^#]*)?', 1) AS s, regexp_extract(url, '^([^:]+:)(//[^/?#]*)([^?#]*)(\\?[^#]*)?', 2) AS a, regexp_extract(url, '^([^:]+:)(//[^/?#]*)([^?#]*)(\\?[^#]*)?', 3) AS b,
  regexp_extract(url, '^([^:]+:)(//[^/?#]*)([^?#]*)(\\?[^#]*)?', 4) AS q FROM r),
g AS (SELECT *, CASE WHEN host <> '' OR starts_with(path, '/') THEN path ELSE coalesce(nullif(regexp_replace(b, '[^/]*$', ''), ''), '/') || path END AS whole FROM f),
d AS (SELECT *, string_split(substr(whole, 2), '/') AS n FROM g),
e AS (SELECT *, list_reduce(list_prepend('', n), lambda x, y: CASE y WHEN '.' THEN x WHEN '..' THEN regexp_replace(x, '/[^/]*$', '') ELSE x || '/' || y END) AS done FROM d),
t AS (SELECT page_id, link, s || CASE WHEN host <> '' THEN host ELSE a END || CASE WHEN host = '' AND path = '' THEN b WHEN n[-1] IN ('.', '..') THEN done || '/' WHEN done = '' THEN '/' ELSE done END
  || CASE WHEN host = '' AND path = '' AND query = '' THEN q ELSE query END AS target FROM e)"""


def _referring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    up = lambda h: F.concat(F.repeat(F.lit("../"), F.length(h) % 11), F.lit("./x/"), h)
    every = lambda h: F.array(h, up(h), F.concat(F.lit("?q="), h), F.concat(F.lit("#"), h), F.concat(F.lit("//other.example/a/../b"), h))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.flatten(F.transform(found, every)).alias("refs"))


@query("resolved_links", f"WITH {RESOLVED} SELECT page_id, link, target FROM t")
def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.page_links(_referring(spark, sf_dir), "page_id", "url", "refs")


@query(
    "link_audit",
    f"""WITH {RESOLVED}, u AS (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS address FROM pages), w AS (SELECT DISTINCT target AS address FROM t)
    SELECT 'unlinked' AS state, address FROM (SELECT * FROM u EXCEPT SELECT * FROM w) UNION ALL SELECT 'missing', address FROM (SELECT * FROM w EXCEPT SELECT * FROM u)""",
)
def link_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.link_audit(_referring(spark, sf_dir), "page_id", "url", "refs")


#: A field's type as a VARIANT has it: whole numbers, else strings; of both together it is one that holds any.
_SHAPED = """CASE WHEN event_id % 7 = 3 THEN replace(props, '"k"', '"j"') WHEN event_id % 5 = 1 THEN replace(props, ': ', ': "x') ELSE props END"""


@query(
    "props_shape_by_day",
    f"""WITH e AS (SELECT event_id, event_type, CAST(ts AS DATE) AS day, {_SHAPED} AS p FROM events),
    v AS (SELECT event_type, day, event_id, json_valid(p) AS ok, p FROM e),
    f AS (SELECT event_type, day, unnest(json_keys(p)) AS k, p FROM v WHERE ok),
    t AS (SELECT event_type, day, k, CASE WHEN count(DISTINCT json_type(p, '$.' || k) = 'VARCHAR') > 1 THEN 'VARIANT' WHEN bool_and(json_type(p, '$.' || k) = 'VARCHAR') THEN 'STRING' ELSE 'BIGINT' END AS kind FROM f GROUP BY ALL),
    s AS (SELECT event_type, day, 'OBJECT<' || string_agg(k || ': ' || kind, ', ' ORDER BY k) || '>' AS shape FROM t GROUP BY ALL),
    n AS (SELECT event_type, day, count(*) AS n, count(*) FILTER (NOT ok) AS malformed, min(event_id) FILTER (NOT ok) AS least_malformed FROM v GROUP BY ALL)
    SELECT event_type, day, n, malformed, least_malformed, coalesce(shape, 'VOID') AS shape,
      coalesce(coalesce(shape, 'VOID') <> lag(coalesce(shape, 'VOID')) OVER (PARTITION BY event_type ORDER BY day), false) AS drifted FROM n LEFT JOIN s USING (event_type, day)""",
)
def props_shape_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields and types of events' properties by type and day, and where they change. Some events get another field, some a text that breaks off."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.to_date("ts").alias("day"), F.expr(_SHAPED).alias("p"))
    return evaluation.drifted(evaluation.field_shapes(rows, "event_id", "p", "event_type", "day"), "event_type", "day")


@query(
    "half_even_rounding",
    "SELECT l_orderkey, l_linenumber, round_even(CAST(round(l_extendedprice * 100) AS BIGINT) / 8.0, 0) AS eighths FROM lineitem",
)
def half_even_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eighths of prices in cents, one in eight of which is a tie."""
    eighths = F.round(F.col("l_extendedprice") * 100).cast("long") / F.lit(8.0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.round_half_even(eighths).alias("eighths"))


@query(
    "zip_by_position",
    """SELECT a.conv_id, a.turn AS question_turn, b.turn AS answer_turn FROM
    (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role = 'user') a JOIN
    (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role = 'assistant') b USING (conv_id, i)
    WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'user') = count(*) FILTER (role = 'assistant'))""",
)
def zip_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.col("turn")))).alias("q"), F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.col("turn")))).alias("a")
    )
    even = turns.filter(F.size("q") == F.size("a"))  # where the numbers differ nothing is zipped
    return even.select("conv_id", F.inline(F.arrays_zip("q", "a")).alias("question_turn", "answer_turn"))


@query("iteration_join", "SELECT u.conv_id, u.turn, a.text AS reply FROM (SELECT * FROM conversations WHERE role = 'user') u LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1")
def iteration_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    replies = rows.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return rows.filter("role = 'user'").select("conv_id", "turn").join(replies, ["conv_id", "turn"], "left").select("conv_id", "turn", "reply")


@query("distinct_models", "SELECT source, array_to_string(list_sort(list_distinct(list(lang))), ',') AS langs FROM documents GROUP BY source")
def distinct_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").groupBy("source")
    return rows.agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query(
    "required_next_action",
    """WITH s AS (SELECT l.doc_id, quality = 1 AS converted, quality = 1 AND toxic = 0 AS summarised FROM labels l), m AS (SELECT min(CASE WHEN NOT converted THEN 0 WHEN NOT summarised THEN 1 END) AS no FROM s)
    SELECT CASE no WHEN 0 THEN 'convert' ELSE 'summarise' END AS stage, CAST(doc_id AS VARCHAR) AS source FROM s, m WHERE (no = 0 AND NOT converted) OR (no = 1 AND NOT summarised)""",
)
def required_next_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    ok = F.col("quality") == 1
    return loops.next_actions(rows.select(F.col("doc_id").cast("string").alias("source"), ok.alias("converted"), (ok & (F.col("toxic") == 0)).alias("summarised"), F.lit(False).alias("tables")))


@query(
    "precondition_check",
    """SELECT doc_id AS step, CASE doc_id % 3 WHEN 0 THEN 'convert' WHEN 1 THEN 'summarise' ELSE 'publish' END AS tool, CASE WHEN doc_id % 3 = 0 THEN (CASE WHEN quality = 1 THEN 'already done' ELSE '' END)
      WHEN doc_id % 3 = 1 THEN (CASE WHEN quality <> 1 THEN 'not converted' WHEN toxic = 1 THEN 'already done' ELSE '' END) ELSE 'unknown tool' END AS reason FROM labels""",
)
def precondition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    state = rows.select(F.col("doc_id").cast("string").alias("source"), (F.col("quality") == 1).alias("converted"), (F.col("toxic") == 1).alias("summarised"), F.lit(False).alias("tables"))
    kind = F.col("doc_id") % 3
    asked = rows.select(F.col("doc_id").alias("step"), F.when(kind == 0, "convert").when(kind == 1, "summarise").otherwise("publish").alias("tool"), F.col("doc_id").cast("string").alias("target"))
    return loops.precondition(state, asked).select("step", "tool", "reason")


@query("tolerant_json", "SELECT event_id, props AS found, CAST(NULL AS VARCHAR) AS error FROM events WHERE json_valid(props)")
def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 4
    raw = (
        F.when(kind == 0, F.col("props")).when(kind == 1, F.concat(F.lit("<think>a {b}</think>\n```json\n"), "props", F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("Here it is: "), "props", F.lit(" as asked."))).otherwise(F.concat(F.lit("\n\n"), "props", F.lit("\n")))
    )
    rows = table(spark, sf_dir, "events").filter(F.try_parse_json("props").isNotNull()).select("event_id", raw.alias("raw"))
    return rows.select("event_id", text.strip(payload.json_object_text(F.col("raw"))).alias("found"), payload.parse_error(F.col("raw")).alias("error"))


@query(
    "mandatory_fields",
    "SELECT field, missing FROM (SELECT count(*) FILTER (coalesce(text, '') = '') AS text, count(*) FILTER (coalesce(lang, '') = '') AS lang, count(*) FILTER (coalesce(source, '') = '') AS source FROM documents) UNPIVOT (missing FOR field IN (text, lang, source))",
)
def mandatory_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.missing_fields(table(spark, sf_dir, "documents"), ("text", "lang", "source"))


@query(
    "knowledge_text",
    "SELECT lang, md5(string_agg('=== ' || source || e' ===\\n' || n, e'\\n' ORDER BY source)) AS digest FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang",
)
def knowledge_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    page = F.concat(F.lit("=== "), F.col("source"), F.lit(" ===\n"), F.col("n").cast("string"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("source", page.alias("page")))), lambda s: s["page"])
    return pages.groupBy("lang").agg(F.md5(F.array_join(parts, "\n").cast("binary")).alias("digest"))


@query(
    "rendered_records",
    """SELECT page_id, md5('# ' || t || e'\\n\\n| Field | Value |\\n|---|---|\\n| Source file | ' || replace(url, '|', '\\|') || ' |') AS head FROM
    (SELECT page_id, url, trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS t FROM pages)""",
)
def rendered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = text.flatten(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1))
    head = F.concat(F.lit("# "), title, F.lit("\n\n| Field | Value |\n|---|---|\n| Source file | "), text.escape_cell(F.col("url")), F.lit(" |"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(head.cast("binary")).alias("head"))


@query("grounded_prompts", sql_texts.grounded(BM25))
def grounded_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    index = retrieval.index_of(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")
    found = retrieval.top_passages(index, items, "item_id", "text")
    texts = docs.select(F.col("doc_id").alias("key"), F.col("source").alias("doc"), F.col("lang").alias("section"), text.prefix(F.col("text"), 1000).alias("text"))
    sources = retrieval.sources_block(found, texts).join(items.withColumnRenamed("item_id", "qid"), "qid")
    return sources.select("qid", "n_passages", F.md5(retrieval.grounded_prompt(F.col("text"), F.col("sources")).cast("binary")).alias("digest"))


#: What is on record as the answers to each question: a conversation's turns with marks, by hash of the question.
KIND = f"({sql_texts.md5_number('CAST(item_id AS VARCHAR)')}) % 5"
ANSWERS = f"""k AS (SELECT b.item_id AS qid, {KIND} AS kind, coalesce(c1.text, '') AS one, coalesce(c2.text, '') AS two FROM benchmark b
  LEFT JOIN conversations c1 ON c1.conv_id = b.item_id AND c1.turn = 1 LEFT JOIN conversations c2 ON c2.conv_id = b.item_id AND c2.turn = 3)"""


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prompt_id, attempt, reply: answers that cite, cite at the second attempt, cite what isn't there, decline; or none at all."""
    turns = table(spark, sf_dir, "conversations").where("turn IN (1, 3)").select(F.col("conv_id").alias("item_id"), ((F.col("turn") + 1) / 2).cast("int").alias("attempt"), F.col("text").alias("said"))
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"))
    said, kind, attempt = F.coalesce("said", F.lit("")), models.md5_number(F.col("item_id").cast("string")) % 5, F.col("attempt")
    reply = (
        F.when(kind == 0, F.concat(said, F.lit(" [S1]"))).when((kind == 1) & (attempt == 1), said).when(kind == 1, F.concat(said, F.lit(" [S2]")))
        .when(kind == 2, F.concat(said, F.lit(" [S1] [S9]"))).when(kind == 3, "INSUFFICIENT_EVIDENCE")
    )
    return asked.join(turns, ["item_id", "attempt"], "left").select(F.col("item_id").alias("prompt_id"), "attempt", reply.alias("reply"))


@query(
    "answers_with_retry",
    f"""WITH {BM25}, {GATE}, {ANSWERS}, g AS (SELECT qid, CASE WHEN best < 5.0 OR coverage < 0.55 THEN 'refused_no_evidence' END AS refused FROM gates)
    SELECT qid, coalesce(refused, CASE kind WHEN 2 THEN 'refused_failed_verification' WHEN 3 THEN 'refused_by_model' WHEN 4 THEN 'error' ELSE 'answered' END) AS status,
      CASE WHEN refused IS NOT NULL THEN 0 WHEN kind IN (0, 3) THEN 1 ELSE 2 END AS attempts,
      CASE WHEN refused IS NULL AND kind = 0 THEN one || ' [S1]' WHEN refused IS NULL AND kind = 1 THEN two || ' [S2]' END AS answer FROM g JOIN k USING (qid)""",
)
def answers_with_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way of a question set: ranked passages, the gate, prompts over their texts, recorded answers, checks of what they cite, a second
    attempt with the complaint, and how each question ended. Prompts hold whole texts."""
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    index = retrieval.index_of(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")
    found = stored(retrieval.top_passages(index, items, "item_id", "text"), "found")  # so few rows that they are sent to the texts: none is moved but theirs
    gates = stored(retrieval.gate(index, items, "item_id", "text", found), "gates")
    texts = docs.select(F.col("doc_id").alias("key"), F.col("source").alias("doc"), F.col("lang").alias("section"), "text")
    asked = items.select(F.col("item_id").alias("qid"), F.col("text").alias("question")).join(retrieval.sources_block(found, texts), "qid")
    tasks = stored(asked.join(gates.where("gate = 'passed'").select("qid"), "qid"), "grounded")
    prompt = retrieval.grounded_prompt(F.col("question"), F.col("sources"), F.col("complaint"))
    rounds = loops.ask_until(tasks, "qid", prompt, lambda reply: retrieval.citation_check(reply, F.lit(retrieval.TOP_K)), models.replay(_recorded(spark, sf_dir)), most=2)
    return loops.answer_status(rounds, gates).select("qid", "status", "attempts", "answer")


_TRIED = "CASE attempt WHEN 1 THEN 'Learners will understand ' ELSE 'Explain ' END || topic || CASE attempt WHEN 1 THEN '' ELSE '.' END"


@query(
    "objectives_with_retry",
    f"""WITH topics AS (SELECT conv_id * 1000 + turn AS id, trim(regexp_replace(text, '[<>]', '', 'g'), {sql_texts.BLANKS}) AS topic FROM conversations WHERE role = 'user'),
    tried AS (SELECT id, attempt, {_TRIED} AS text FROM topics, (VALUES (1), (2), (3)) v(attempt)),
    judged AS (SELECT id, attempt, {REASON} AS reason FROM (SELECT id, attempt, text, {OBJECTIVE} AS o FROM tried))
    SELECT j.id, CAST(attempt AS INTEGER) AS attempt, reason = 'ok' AS ok, reason FROM judged j WHERE NOT EXISTS (SELECT 1 FROM judged k WHERE k.id = j.id AND k.attempt < j.attempt AND k.reason = 'ok')""",
)
def objectives_with_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users ask for as topics: every attempt and why it was turned down, up to three."""
    topics = table(spark, sf_dir, "conversations").filter("role = 'user'")
    topics = topics.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.regexp_replace("text", "[<>]", "").alias("topic"))
    prompt = F.concat(F.lit("Write one objective. <topic>"), "topic", F.lit("</topic>"), F.coalesce(F.concat(F.lit(" Not accepted: "), "complaint"), F.lit("")))
    check = lambda reply: F.struct((validation.objective_reason(reply) == "ok").alias("ok"), validation.objective_reason(reply).alias("reason"))
    return loops.ask_until(topics, "id", prompt, check, models.mock_objective()).select("id", "attempt", "ok", "reason")


@query("map_reduce_material", sql_texts.MATERIAL)
def map_reduce_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampled = chunks.sampled_windows(spread(table(spark, sf_dir, "documents")), "doc_id", "text", 10, "head", 400, 0)
    rows = loops.map_reduce_summary(sampled, "doc_id", "window_no", "window", "Note what matters.\n<document>{{TEXT}}</document>", models.mock_summary)
    return rows.select("doc_id", F.md5(F.col("material").cast("binary")).alias("digest"))


@query("fake_embeddings", sql_texts.VECTORS)
def fake_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(models.fake_embedding(F.col("text"))).alias("place", "value"))
    return rows.select("item_id", F.col("place").cast("long").alias("place"), F.round("value", 6).alias("value"))


@query(
    "run_outcome_explode",
    """WITH r AS (SELECT doc_id // 8 AS run, ['0', '1', '2', '3', '3b', '4', '5', '6'][doc_id % 8 + 1] AS lab, bool_or(quality = 1) AS a, bool_or(toxic = 1) AS b FROM labels GROUP BY ALL)
    SELECT run, lab, CASE WHEN lab IN ('1', '2') THEN a AND NOT (b AND lab = '2') WHEN lab = '3' THEN a WHEN lab = '3b' THEN a AND b WHEN lab = '4' THEN a AND NOT b WHEN lab = '5' THEN a AND NOT b ELSE NOT b END AS as_expected FROM r""",
)
def run_outcome_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of eight labs each, whose outcomes come from labels: a is the quality, b the toxicity of a lab's document."""
    lab = F.element_at(F.array(*[F.lit(x) for x in ("0", "1", "2", "3", "3b", "4", "5", "6")]), (F.col("doc_id") % 8 + 1).cast("int"))
    rows = table(spark, sf_dir, "labels").groupBy(F.floor(F.col("doc_id") / 8).alias("run"), lab.alias("lab"))
    rows = rows.agg(F.bool_or(F.col("quality") == 1).alias("a"), F.bool_or(F.col("toxic") == 1).alias("b"))
    tried = lambda kind, first, second: F.to_json(F.struct(F.array(F.struct(F.lit(first).alias(kind), F.lit(False).alias("passed")), F.struct(F.lit(second).alias(kind), F.col("a").alias("passed"))).alias("results")))
    number = lambda c: (~c).cast("int")
    data = (
        F.when(F.col("lab") == "1", tried("kind", "vague", "specific")).when(F.col("lab") == "2", tried("variant", "without skill", "with skill"))
        .when(F.col("lab") == "3", F.to_json(F.struct(number(F.col("a")).alias("verify_exit_code"))))
        .when(F.col("lab") == "3b", F.to_json(F.struct(F.col("b").cast("int").alias("verify_exit_code"), F.col("a").alias("corpus_restored"), F.array(F.lit("[anonymisation] an address")).alias("failures"))))
        .when(F.col("lab") == "4", F.to_json(F.struct(F.col("a").alias("stop_condition_met"), F.col("b").alias("hit_step_limit"), F.lit("m").alias("model_recorded_in_state"), F.lit(True).alias("report_written"))))
        .when(F.col("lab") == "5", F.to_json(F.struct(F.lit(0).alias("agent_exit_code"), F.col("b").cast("int").alias("baseline_score"), F.col("a").cast("int").alias("final_score"))))
        .otherwise(F.lit('{"samples": []}'))
    )
    crashed = (F.col("b") & F.col("lab").isin("0", "2", "6")).cast("int")
    runs = rows.select("run", "lab", F.lit(1).alias("attempt"), crashed.alias("exit_code"), data.alias("data"), F.lit("m").alias("model"))
    return evaluation.assess(runs, ["run"])


@query("tokens_per_word", f"SELECT lang, round(sum(t) / sum(w), 4) AS tokens_per_word FROM (SELECT lang, {count_sql('text')} AS w, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents) GROUP BY lang")
def tokens_per_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", text.word_count(F.col("text")).alias("w"), F.size(text.tokens(F.col("text"))).alias("t"))
    return rows.groupBy("lang").agg(F.round(F.sum("t") / F.sum("w"), 4).alias("tokens_per_word"))


@query("names_longest_first", "SELECT c_mktsegment AS name, row_number() OVER (ORDER BY len(c_mktsegment) DESC, c_mktsegment) AS place FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def names_longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")).distinct()
    return numbered(rows, [F.desc(F.length("name")), F.col("name")], "place")


@query(
    "pages_joined",
    "WITH p AS (SELECT conv_id, list(text ORDER BY turn) AS pages FROM conversations GROUP BY conv_id) SELECT conv_id, md5(array_to_string(list_filter(list_transform(pages, lambda t, i: CASE WHEN trim(t, e' \\t\\n\\r\\x0b\\f') <> '' THEN '[Page ' || i || e']\\n' || trim(t, e' \\t\\n\\r\\x0b\\f') END), lambda x: x IS NOT NULL), e'\\n\\n')) AS digest FROM p",
)
def pages_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("pages"))
    return turns.select("conv_id", F.md5(text.join_pages(F.col("pages")).cast("binary")).alias("digest"))


@query(
    "union_of_rankings",
    """WITH s AS (SELECT event_type, user_id, round(sum(value), 9) AS v, count(*) AS n FROM events GROUP BY event_type, user_id),
    a AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY v DESC, user_id) - 1 AS r FROM s),
    b AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) - 1 AS r FROM s),
    u AS (SELECT event_type, user_id, sum(1 / (60 + r)) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)
    SELECT event_type, user_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY event_type ORDER BY round(score, 9) DESC, user_id) AS BIGINT) AS rank FROM u QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY round(score, 9) DESC, user_id) <= 5""",
)
def union_of_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.round(F.sum("value"), 9).alias("v"), F.count("*").alias("n"))
    place = lambda c: numbered(base, [F.desc(c), F.col("user_id")], "n1", "event_type").select("event_type", "user_id", (F.col("n1") - 1).alias("r"))
    both = place("v").unionAll(place("n"))
    scores = both.groupBy(F.col("event_type").alias("qid"), F.col("user_id").alias("ord")).agg(F.sum(numbers.reciprocal_rank(F.col("r"))).alias("score"))
    top = retrieval.best(scores, 5)
    return top.select(F.col("qid").alias("event_type"), F.col("ord").alias("user_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "retry_counts",
    "SELECT conv_id, count(*) FILTER (role = 'assistant') AS attempts, count(*) FILTER (role = 'assistant') > 1 AS retried FROM conversations GROUP BY conv_id",
)
def retry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = F.count_if(F.col("role") == "assistant")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(attempts.alias("attempts"), (attempts > 1).alias("retried"))


@query(
    "no_content_filter",
    "SELECT page_id, NOT contains(lower(substr(html, 1, 60)), 'lang=\"fr\"') AS keep_a, NOT contains(upper(html), 'TRACK(0)') AS keep_b FROM pages",
)
def no_content_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile a looks at the lower-cased start, b anywhere in upper case."""
    a, b = F.lower(F.substring("html", 1, 60)).contains('lang="fr"'), F.upper("html").contains("TRACK(0)")
    return table(spark, sf_dir, "pages").select("page_id", (~a).alias("keep_a"), (~b).alias("keep_b"))


@query("score_split", "SELECT doc_id, CASE WHEN quality < 1 THEN 'failure' ELSE 'success' END AS part FROM labels")
def score_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") < 1, "failure").otherwise("success").alias("part"))


@query(
    "all_pass_exit_code",
    "SELECT source, CASE WHEN bool_and(quality = 1) THEN 0 ELSE 1 END AS exit_code, count(*) FILTER (quality = 1) AS passed FROM labels JOIN documents USING (doc_id) GROUP BY source",
)
def all_pass_exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    ok = F.col("quality") == 1
    return rows.groupBy("source").agg(F.when(F.bool_and(ok), 0).otherwise(1).alias("exit_code"), F.count_if(ok).alias("passed"))


@query("validated_records", sql_texts.RECORDS)
def validated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as summary records: rendered, parsed again and checked."""
    from ..sources.sinks import render_record_a

    body = text.strip_tags(F.col("html"))
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    raw = F.to_json(F.struct(title.alias("title"), F.lit("Body").alias("issuing_body"), F.lit("unknown").alias("country_or_region"), F.lit("2024").alias("year"), F.lit("Page").alias("document_type"), body.alias("summary"), F.lit("a; b, A, c").alias("keywords")))
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    rows = pages.select("page_id", "url", payload.summary_record(payload.json_object_text(raw)).alias("r"))
    # Each step is a column of its own: what later ones use many times is then computed once.
    rows = rows.withColumn("md", render_record_a(F.col("r"), F.col("url"), "agent", "model", "2024-01-01")).withColumn("p", tables.parse_summary_a(F.col("md")))
    return rows.select("page_id", F.array_join(validation.file_errors(F.col("p")), "; ").alias("errors"), F.size("p.keywords").alias("keywords"))


@query(
    "elapsed_and_containment",
    "SELECT event_type, round(date_diff('millisecond', min(ts), max(ts)) / 1000.0, 3) AS seconds, count(*) FILTER (ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 5 SECOND AND TIMESTAMP '2024-01-12 00:00:00' + INTERVAL 5 SECOND) AS inside FROM events GROUP BY event_type",
)
def elapsed_and_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds between first and last, and how many lie in an interval five seconds wider on each side."""
    seconds = (F.unix_millis(F.max("ts").cast("timestamp")) - F.unix_millis(F.min("ts").cast("timestamp"))) / 1000
    lo, hi = F.lit("2024-01-09 23:59:55").cast("timestamp"), F.lit("2024-01-12 00:00:05").cast("timestamp")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(seconds, 3).alias("seconds"), F.count_if(F.col("ts").cast("timestamp").between(lo, hi)).alias("inside"))
