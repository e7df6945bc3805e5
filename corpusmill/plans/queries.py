"""Named queries over the driver tables with equal SQL: text functions, retrieval, chunks, privacy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import query
from ..functions import numbers, payload, text
from ..operators import chunks, evaluation, fusion, privacy, retrieval, validation, vectors
from ..session import table
from ..storage import spread
from . import sql_texts

STOP_SQL = ", ".join(f"'{w}'" for w in retrieval.STOPWORDS)
words_sql, count_sql = sql_texts.words, sql_texts.word_count


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for work on their texts, spread over all cores where the table is one small file."""
    return spread(table(spark, sf_dir, "documents"))


@query(
    "word_stats_by_lang",
    f"""SELECT lang, count(*) AS documents, sum({count_sql('text')})::BIGINT AS words, round(sum({count_sql('text')}) / greatest(count(*), 1), 6) AS mean_words,
    max({count_sql('text')})::BIGINT AS most_words FROM documents GROUP BY lang""",
)
def word_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("lang", text.word_count(F.col("text")).alias("w"))
    mean = F.round(F.sum("w") / F.greatest(F.count("*"), F.lit(1)), 6)
    return rows.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("w").alias("words"), mean.alias("mean_words"), F.max("w").alias("most_words"))


@query(
    "token_frequency_top20",
    """SELECT term, n, CAST(row_number() OVER (ORDER BY n DESC, term) AS BIGINT) AS place FROM (
    SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY term) ORDER BY n DESC, term LIMIT 20""",
)
def token_frequency_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _documents(spark, sf_dir).select(F.explode(text.tokens(F.col("text"))).alias("term"))
    top = terms.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(20)
    from pyspark.sql import Window

    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "term")).cast("long"))


POSTINGS = """
base AS (SELECT doc_id AS key, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS terms FROM documents),
lengths AS (SELECT key, len(terms) AS length FROM base),
stats AS (SELECT count(*) AS n, sum(length) / greatest(count(*), 1) AS mean_length FROM lengths),
postings AS (SELECT key, term, count(*) AS tf FROM (SELECT key, unnest(terms) AS term FROM base) GROUP BY ALL),
frequencies AS (SELECT term, count(*) AS df FROM postings GROUP BY term)"""


@query(
    "term_frequency_by_document",
    f"WITH {POSTINGS} SELECT key AS doc_id, count(*) AS terms, sum(tf)::BIGINT AS tokens, max(tf) AS most FROM postings GROUP BY key",
)
def term_frequency_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    rows = index.postings.select(F.explode("docs").alias("d")).select("d.key", "d.tf")
    return rows.groupBy(F.col("key").alias("doc_id")).agg(F.count("*").alias("terms"), F.sum("tf").alias("tokens"), F.max("tf").alias("most"))


def _index(spark: SparkSession, sf_dir: str) -> retrieval.Index:
    """Built by the first query that asks for it and read by all others, as long as the table is the same."""
    return retrieval.index_of(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")


@query(
    "doc_frequency_idf",
    f"WITH {POSTINGS} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM frequencies, stats",
)
def doc_frequency_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    return index.frequencies.select("term", "df", F.round("weight", 6).alias("idf"))


BM25 = (
    POSTINGS
    + """,
asked AS (SELECT item_id AS qid, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT qid, p.key, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / mean_length))) AS score
  FROM asked JOIN frequencies f USING (term) JOIN postings p USING (term) JOIN lengths l ON l.key = p.key, stats GROUP BY ALL),
every AS (SELECT b.item_id AS qid, l.key, coalesce(s.score, 0) AS score FROM benchmark b CROSS JOIN lengths l LEFT JOIN scored s ON s.qid = b.item_id AND s.key = l.key),
kw AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, key) - 1 AS rank0 FROM every)"""
)


@query("bm25_topk", f"WITH {BM25} SELECT qid, key AS doc_id, CAST(rank0 + 1 AS BIGINT) AS rank, round(score, 6) AS score FROM kw WHERE rank0 < 4")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.top_passages(_index(spark, sf_dir), table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.select("qid", F.col("key").alias("doc_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


GATE = f"""
terms AS (SELECT item_id AS qid, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: len(t) > 2 AND t NOT IN ({STOP_SQL})) AS terms FROM benchmark),
blobs AS (SELECT qid, string_agg(lower(d.text), ' ' ORDER BY rank0) AS blob, max(CASE WHEN rank0 = 0 THEN score END) AS best FROM kw JOIN documents d ON d.doc_id = kw.key WHERE rank0 < 4 GROUP BY qid),
gates AS (SELECT qid, best, CASE WHEN len(terms) = 0 THEN 0 ELSE len(list_filter(terms, lambda t: contains(blob, t))) / len(terms) END AS coverage FROM terms JOIN blobs USING (qid))"""


@query(
    "bm25_gate_status",
    f"""WITH {BM25}, {GATE} SELECT qid, round(best, 6) AS best_score, round(coverage, 6) AS coverage,
    CASE WHEN best < 5.0 THEN 'refused_score' WHEN coverage < 0.55 THEN 'refused_coverage' ELSE 'passed' END AS gate FROM gates""",
)
def bm25_gate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, questions = _index(spark, sf_dir), table(spark, sf_dir, "benchmark")
    found = retrieval.top_passages(index, questions, "item_id", "text")
    rows = retrieval.gate(index, questions, "item_id", "text", found)
    return rows.select("qid", F.round("best_score", 6).alias("best_score"), F.round("coverage", 6).alias("coverage"), "gate")


@query(
    "content_terms",
    f"SELECT item_id, term, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) WHERE len(term) > 2 AND term NOT IN ({STOP_SQL}) GROUP BY ALL",
)
def content_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.explode(retrieval.content_terms(F.col("text"))).alias("term"))
    return rows.groupBy("item_id", "term").agg(F.count("*").alias("n"))


COSINE = "list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i]::DOUBLE * b[i]::DOUBLE)) / (sqrt(list_sum(list_transform(a, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b, lambda x: x::DOUBLE * x::DOUBLE))))"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))


@query(
    "dense_topk",
    f"""WITH pairs AS (SELECT q.vec_id AS qid, e.vec_id AS key, q.embedding AS a, e.embedding AS b FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0),
    scored AS (SELECT qid, key, {COSINE} AS score FROM pairs),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, key) AS rank FROM scored)
    SELECT qid, key AS vec_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 4""",
)
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    asked = rows.filter("key % 100 = 0").select(F.col("key").alias("qid"), "vector")
    found = vectors.nearest(vectors.vector_blocks(rows), asked, 4)
    return found.select("qid", F.col("key").alias("vec_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


HYBRID = f"""
dense AS (SELECT qid, key, CASE WHEN b IS NULL OR a IS NULL THEN 0 ELSE {COSINE} END AS score FROM
  (SELECT k.qid, k.key, q.embedding AS a, e.embedding AS b FROM kw k LEFT JOIN embeddings q ON q.vec_id = k.qid LEFT JOIN embeddings e ON e.vec_id = k.key)),
dn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, key) - 1 AS rank0 FROM dense),
both_ AS (SELECT qid, key, kw.rank0 AS kw_rank, kw.score AS keyword_score, 1 / (60 + kw.rank0) + 1 / (60 + dn.rank0) AS score FROM kw JOIN dn USING (qid, key)),
hybrid AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, kw_rank) AS rank FROM both_)"""


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    passages = docs.select(F.col("doc_id").alias("key")).join(_vectors(spark, sf_dir), "key", "left")
    asked = questions.select(F.col("item_id").alias("qid")).join(_vectors(spark, sf_dir).withColumnRenamed("key", "qid"), "qid", "left")
    return fusion.hybrid_passages(_index(spark, sf_dir), questions, "item_id", "text", vectors.vector_blocks(passages), asked, 4)


@query("hybrid_rrf_topk", f"WITH {BM25}, {HYBRID} SELECT qid, key AS doc_id, rank, round(score, 6) AS score, round(keyword_score, 6) AS keyword_score FROM hybrid WHERE rank <= 4")
def hybrid_rrf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hybrid(spark, sf_dir)
    return rows.select("qid", F.col("key").alias("doc_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), F.round("keyword_score", 6).alias("keyword_score"))


@query(
    "retrieval_eval_rates",
    f"""WITH {BM25}, {GATE}, judged AS (
      SELECT g.qid, CASE WHEN g.qid % 4 = 3 THEN 'refused' ELSE 'answered' END AS expect, CASE WHEN best < 5.0 OR coverage < 0.55 THEN 'refused_no_evidence' ELSE 'answered' END AS status,
        CASE WHEN g.qid % 4 = 3 THEN NULL ELSE 'src' || (g.qid % 20) END AS expect_doc, (SELECT list(DISTINCT d.source) FROM kw JOIN documents d ON d.doc_id = kw.key WHERE kw.qid = g.qid AND rank0 < 4) AS docs FROM gates g),
    marked AS (SELECT *, CASE WHEN expect = 'answered' THEN status = 'answered' ELSE starts_with(status, 'refused') END AS ok,
      CASE WHEN expect_doc IS NOT NULL THEN len(list_filter(docs, lambda d: contains(d, expect_doc))) > 0 END AS hit FROM judged)
    SELECT round(coalesce(count(*) FILTER (hit) / nullif(count(*) FILTER (hit IS NOT NULL), 0), 0), 6) AS retrieval_hit_rate,
      round(coalesce(count(*) FILTER (ok AND expect = 'answered') / nullif(count(*) FILTER (expect = 'answered'), 0), 0), 6) AS answered_rate,
      round(coalesce(count(*) FILTER (ok AND expect <> 'answered') / nullif(count(*) FILTER (expect <> 'answered'), 0), 0), 6) AS refused_rate,
      count(*) FILTER (status = 'answered' AND qid % 5 = 0) AS retried FROM marked""",
)
def retrieval_eval_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, items = _index(spark, sf_dir), table(spark, sf_dir, "benchmark")
    found = retrieval.top_passages(index, items, "item_id", "text")
    gates = retrieval.gate(index, items, "item_id", "text", found)
    results = gates.select("qid", F.when(F.col("gate") == "passed", "answered").otherwise("refused_no_evidence").alias("status"), F.when((F.col("gate") == "passed") & (F.col("qid") % 5 == 0), 2).otherwise(1).alias("attempts"))
    refuse = F.col("item_id") % 4 == 3
    questions = items.select(F.col("item_id").alias("qid"), F.when(refuse, "refused").otherwise("answered").alias("expect"), F.when(~refuse, F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))).alias("expect_doc"))
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("doc"))
    rates = retrieval.evaluation_rates(retrieval.evaluation_rows(questions, results, found.join(sources, "key").select("qid", "doc")))
    return rates.select(*[F.round(c, 6).alias(c) for c in rates.columns[:3]], "retried")


WINDOWS = f"""
win AS (SELECT doc_id, CAST(i AS INTEGER) AS window_no, n, CASE WHEN n <= 180 THEN trim(text, e' \\t\\n\\r\\x0b\\f') ELSE array_to_string(ws[i * 140 + 1 : i * 140 + 180], ' ') END AS win_text,
    least(n - i * 140, 180) AS words FROM (SELECT *, unnest(range(0, 1 + CAST(ceil(greatest(n - 180, 0) / 140) AS BIGINT))) AS i FROM
      (SELECT doc_id, text, {words_sql('text')} AS ws, {count_sql('text')} AS n FROM documents WHERE {count_sql('text')} > 0)))"""


@query("word_windows", f"WITH {WINDOWS} SELECT doc_id, window_no, words::BIGINT AS words, md5(win_text) AS digest FROM win")
def word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks.word_windows(_documents(spark, sf_dir), "doc_id", "text")
    return rows.select("doc_id", "window_no", "words", F.md5(F.col("window").cast("binary")).alias("digest"))


@query(
    "even_sample_head",
    f"""WITH {WINDOWS}, counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS c FROM win)
    SELECT doc_id, window_no FROM counted WHERE c <= 5 OR window_no < 2 OR list_contains(list_transform(range(0, 3), lambda i: CAST(floor(i * ((c - 2) / 3.0)) AS INTEGER) + 2), window_no)""",
)
def even_sample_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.sampled_windows(_documents(spark, sf_dir), "doc_id", "text", 5, "head").select("doc_id", "window_no")


@query(
    "even_sample_first_last",
    f"""WITH {WINDOWS}, counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS c FROM win)
    SELECT doc_id, window_no FROM counted WHERE c <= 4 OR list_contains(list_transform(range(0, 4), lambda i: CAST(round_even(i * ((c - 1) / 3.0), 0) AS INTEGER)), window_no)""",
)
def even_sample_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.sampled_windows(_documents(spark, sf_dir), "doc_id", "text", 4, "ends").select("doc_id", "window_no")


EMAIL = "\\b[\\w.+-]+@[\\w-]+\\.[\\w.-]+\\b"


@query(
    "pii_email_hits",
    f"SELECT doc_id, hit, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) AS hit FROM documents) GROUP BY ALL",
)
def pii_email_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", F.explode(privacy.hits(F.col("text"), "EMAIL")).alias("hit"))
    return rows.groupBy("doc_id", "hit").agg(F.count("*").alias("n"))


@query(
    "pii_person_hits",
    "SELECT doc_id, unnest(regexp_extract_all(text, '\\b(?:Dr|Prof|Mr|Mrs|Ms|Mx|Ing|Eng|Sr|Sra|Herr|Frau)\\.?[ \\t]+(?:[A-ZÀ-Þ][\\pL\\pN_''’-]+[ \\t]+){0,2}[A-ZÀ-Þ][\\pL\\pN_''’-]+')) AS hit FROM documents",
)
def pii_person_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.explode(privacy.hits(F.col("text"), "PERSON")).alias("hit"))


@query("pii_phone_hits", sql_texts.PHONE_HITS)
def pii_phone_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.explode(privacy.hits(F.col("text"), "PHONE")).alias("hit"))


def _numbered_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")


@query(
    "pseudonym_numbering",
    f"""WITH hits AS (SELECT doc_id, i, h[i] AS v FROM (SELECT doc_id, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{EMAIL}') AS h FROM documents))),
    firsts AS (SELECT v, min((doc_id, i)) AS f FROM hits GROUP BY v)
    SELECT v AS value, '[EMAIL_' || row_number() OVER (ORDER BY f) || ']' AS token FROM firsts""",
)
def pseudonym_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = privacy.pseudonyms(privacy.find_identifiers(_numbered_docs(spark, sf_dir), last="EMAIL"))
    return rows.filter("label = 'EMAIL'").select("value", "token")


@query("scrubbed_documents", sql_texts.SCRUBBED)
def scrubbed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.scrub(_numbered_docs(spark, sf_dir)).select(F.col("doc").alias("doc_id"), F.md5(F.col("scrubbed").cast("binary")).alias("digest"))


@query("anonymisation_report", sql_texts.REPORT)
def anonymisation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.anonymisation_report(privacy.find_identifiers(_numbered_docs(spark, sf_dir)))


@query(
    "leak_scan_summary",
    f"""SELECT part, count(DISTINCT doc) AS documents, count(*) AS hits FROM (
      SELECT 'documents' AS part, doc_id AS doc, unnest(regexp_extract_all(text, '{EMAIL}')) AS hit FROM documents UNION ALL
      SELECT 'pages', page_id, unnest(regexp_extract_all(html, '{EMAIL}')) FROM pages UNION ALL
      SELECT 'conversations', conv_id, unnest(regexp_extract_all(text, '{EMAIL}')) FROM conversations) GROUP BY part""",
)
def leak_scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("conversations", "conv_id", "text"))
    found = None
    for name, key, column in parts:
        hits = privacy.leaks(table(spark, sf_dir, name).select(F.col(key).alias("doc"), F.col(column).alias("text"))).filter("kind = 'email'").select(F.lit(name).alias("part"), "doc", "hit")
        found = hits if found is None else found.unionByName(hits)
    return found.groupBy("part").agg(F.countDistinct("doc").alias("documents"), F.count("*").alias("hits"))


@query(
    "slugs",
    "SELECT doc_id, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48), ''), 'pattern') AS slug FROM documents",
)
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", text.slug(F.col("text")).alias("slug"))


@query(
    "rough_tokens",
    """SELECT doc_id, coalesce(list_sum(list_transform(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^\\sA-Za-z0-9]'),
    lambda p: CASE WHEN regexp_matches(p, '^[A-Za-z]{7,}$') THEN CAST(ceil(len(p) / 4) AS BIGINT) ELSE 1 END)), 0)::BIGINT AS tokens FROM documents""",
)
def rough_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", text.rough_tokens(F.col("text")).alias("tokens"))


@query(
    "squeezed_lines",
    "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest, len(regexp_extract_all(text, '[.!?](?:\\s|$)'))::BIGINT AS ends FROM documents",
)
def squeezed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.md5(text.squeeze(F.col("text")).cast("binary")).alias("digest"), text.sentence_ends(F.col("text")).alias("ends"))


@query(
    "clean_text_profiles",
    """SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(173), ''), '([\\pL\\pN_])-\\n([\\pL\\pN_])', '\\1\\2', 'g'), '[ \\t\\f\\x0b]+', ' ', 'g'), ' *\\n *', e'\\n', 'g'), '\\n{3,}', e'\\n\\n', 'g'), e' \\t\\n\\r\\x0b\\f')) AS a,
    md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '([\\pL\\pN_])-\\n([\\pL\\pN_])', '\\1\\2', 'g'), '[ \\t]+', ' ', 'g'), '\\n\\s*\\n\\s*(\\n\\s*)+', e'\\n\\n', 'g'), e' \\t\\n\\r\\x0b\\f')) AS b FROM documents""",
)
def clean_text_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    digest = lambda c: F.md5(c.cast("binary"))
    return _documents(spark, sf_dir).select("doc_id", digest(text.clean_profile_a(x)).alias("a"), digest(text.clean_profile_b(x)).alias("b"))


CUT = f"array_to_string(({words_sql('text')})[1:20], ' ')"


@query(
    "truncate_words",
    f"""SELECT conv_id, turn, CASE WHEN {count_sql('text')} <= 20 THEN text WHEN (CASE WHEN instr(reverse(cut), '.') = 0 THEN -1 ELSE len(cut) - instr(reverse(cut), '.') END) > floor(len(cut) / 2)
    THEN substr(cut, 1, len(cut) - instr(reverse(cut), '.') + 1) ELSE regexp_replace(cut, '[,;:]+$', '') || '.' END AS short FROM (SELECT conv_id, turn, text, {CUT} AS cut FROM conversations)""",
)
def truncate_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.truncate_words(F.col("text"), 20).alias("short"))


@query("sentence_trim", sql_texts.SENTENCES)
def sentence_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    trimmed = text.trim_to_limit(F.col("text"), 40)
    return _documents(spark, sf_dir).select("doc_id", trimmed["mode"].alias("mode"), F.md5(trimmed["text"].cast("binary")).alias("digest"))


BARE = "trim(trim(trim(text, e' \\t\\n\\r\\x0b\\f'), '\"'), '''')"
OBJECTIVE = f"regexp_replace({BARE}, '^[-*0-9.)\\s]+', '')"
VERB_SQL = ", ".join(f"'{v}'" for v in validation.VERBS)
REASON = f"""CASE WHEN {BARE} = '' THEN 'empty answer'
  WHEN lower(string_split_regex(o, '[\\s,.:;]+')[1]) NOT IN ({VERB_SQL}) THEN 'opened with ''' || lower(string_split_regex(o, '[\\s,.:;]+')[1]) || ''', not an allowed verb'
  WHEN {count_sql('o')} > 20 THEN {count_sql('o')} || ' words, limit is 20'
  WHEN len(regexp_extract_all(o, '[.!?](?:\\s|$)')) > 1 THEN len(regexp_extract_all(o, '[.!?](?:\\s|$)')) || ' sentences, one is allowed'
  WHEN contains(trim(o, e' \\t\\n\\r\\x0b\\f'), e'\\n') THEN 'more than one line' ELSE 'ok' END"""


@query("objective_check_reasons", f"SELECT conv_id, turn, {REASON} AS reason FROM (SELECT conv_id, turn, text, {OBJECTIVE} AS o FROM conversations)")
def objective_check_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", validation.objective_reason(F.col("text")).alias("reason"))


@query(
    "objective_reason_groups",
    f"""WITH r AS (SELECT conv_id, turn, text, {REASON} AS reason FROM (SELECT conv_id, turn, text, {OBJECTIVE} AS o FROM conversations)),
    g AS (SELECT regexp_replace(regexp_replace(reason, '''[^'']*''', '''X''', 'g'), '\\d+', 'N', 'g') AS pattern, text, conv_id * 1000 + turn AS ord FROM r WHERE reason <> 'ok')
    SELECT pattern, count(*) AS n, arg_min(text, ord) AS example FROM g GROUP BY pattern""",
)
def objective_reason_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("text", validation.objective_reason(F.col("text")).alias("reason"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"))
    return validation.group_reasons(rows.filter("reason <> 'ok'"), "reason", "ord", "text")


@query("summary_errors_profile_a", sql_texts.SUMMARY_A)
def summary_errors_profile_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    rows = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    joined = lambda c: F.array_join(c, "; ")
    return rows.select("conv_id", "turn", joined(validation.summary_errors_a(x)).alias("errors"), joined(validation.summary_warnings_a(x)).alias("warnings"))


ENGLISH_SQL = ", ".join(f"'{w}'" for w in validation.ENGLISH)


@query(
    "summary_problems_profile_b",
    f"""WITH t AS (SELECT conv_id, turn, text, {count_sql('text')} AS n, regexp_extract_all(lower(text), '[a-z]+') AS tk,
      list_sort(list_distinct(regexp_extract_all(regexp_replace(text, '([^\\pL\\pN_])', '\\1\\1', 'g'), '(?:^|[^\\pL\\pN_])(I|We|we|Our|our|us|You|you|Your|your)(?:$|[^\\pL\\pN_])', 1))) AS pr FROM conversations WHERE role = 'assistant')
    SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN n > 80 THEN 'over the maximum: ' || n || ' words of 80' END, CASE WHEN n < 50 THEN 'too short: ' || n || ' words' END,
      CASE WHEN regexp_matches(text, '(^|\\s)[•▪]\\s|^\\s*[-*]\\s') THEN 'a list instead of prose' END, CASE WHEN contains(text, '!') OR contains(text, '?') THEN 'exclamation or question marks' END,
      CASE WHEN len(pr) > 0 THEN 'not in the third person: ' || array_to_string(pr, ', ') END,
      CASE WHEN len(tk) >= 15 AND len(list_filter(tk, lambda w: w IN ({ENGLISH_SQL}))) / len(tk) < 0.08 THEN 'not in English' END], lambda x: x IS NOT NULL), '; ') AS problems FROM t""",
)
def summary_problems_profile_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return rows.select("conv_id", "turn", F.array_join(validation.summary_problems_b(F.col("text")), "; ").alias("problems"))


@query(
    "citation_checks",
    """WITH a AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN text || ' [S1]' WHEN 1 THEN text || ' [S2][S9]' WHEN 2 THEN 'INSUFFICIENT_EVIDENCE' WHEN 3 THEN text ELSE '' END AS answer FROM conversations),
    c AS (SELECT *, list_transform(regexp_extract_all(answer, '\\[S(\\d+)\\]', 1), lambda n: n::BIGINT) AS cited, upper(trim(answer)) AS bare FROM a)
    SELECT conv_id, turn, CASE WHEN trim(answer) = '' THEN 'empty answer' WHEN starts_with(bare, 'INSUFFICIENT_EVIDENCE') OR (len(bare) < 60 AND contains(bare, 'INSUFFICIENT_EVIDENCE')) THEN 'evidence declared insufficient'
      WHEN len(cited) = 0 THEN 'no source cited' WHEN len(list_filter(cited, lambda n: n < 1 OR n > 4)) > 0 THEN 'sources cited that were not supplied: ' ||
        array_to_string(list_transform(list_sort(list_distinct(list_filter(cited, lambda n: n < 1 OR n > 4))), lambda n: '[S' || n || ']'), ', ')
      ELSE 'cited ' || len(list_distinct(cited)) || ' of 4' END AS reason FROM c""",
)
def citation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, kind = F.col("text"), F.col("turn") % 5
    answer = F.when(kind == 0, F.concat(x, F.lit(" [S1]"))).when(kind == 1, F.concat(x, F.lit(" [S2][S9]"))).when(kind == 2, "INSUFFICIENT_EVIDENCE").when(kind == 3, x).otherwise("")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", retrieval.citation_check(answer, F.lit(4))["reason"].alias("reason"))


@query(
    "keyword_dedup",
    f"""WITH w AS (SELECT conv_id, turn, {words_sql('text')} AS ws FROM conversations WHERE trim(text) <> '')
    SELECT conv_id, turn, array_to_string(list_filter(ws, lambda v, i: list_position(list_transform(ws, lambda y: lower(y)), lower(v)) = i)[1:5], ' ') AS kept FROM w""",
)
def keyword_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("trim(text) <> ''")
    return rows.select("conv_id", "turn", F.array_join(text.distinct_ignoring_case(text.words(F.col("text")), 5), " ").alias("kept"))


@query(
    "json_field_extract",
    "SELECT event_id, json_extract_string(props, '$.' || (json_keys(props)[1])) AS first_value, len(json_keys(props))::BIGINT AS keys FROM events WHERE json_valid(props)",
)
def json_field_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.json_object_keys("props")
    rows = table(spark, sf_dir, "events").select("event_id", payload.json_object_text(F.col("props")).alias("props"))
    values = F.from_json("props", "map<string,string>")
    return rows.filter("props is not null").select("event_id", F.element_at(values, F.get(keys, F.lit(0))).alias("first_value"), F.size(keys).cast("long").alias("keys"))


@query(
    "html_meta_extract",
    """SELECT page_id, regexp_extract(html, '<html[^>]*lang="([a-z]+)"', 1) AS lang, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
    len(regexp_extract_all(html, '<a\\s[^>]*href='))::BIGINT AS links,
    md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM pages""",
)
def html_meta_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("html")
    title = F.regexp_extract(x, r"(?s)<title>(.*?)</title>", 1)
    links = F.regexp_count(x, F.lit(r"<a\s[^>]*href=")).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(x, '<html[^>]*lang="([a-z]+)"', 1).alias("lang"), title.alias("title"), links.alias("links"), F.md5(text.strip_tags(x).cast("binary")).alias("digest"))


@query(
    "stale_and_unindexed",
    "SELECT doc_id, 'stale' AS state FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'unindexed' FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)",
)
def stale_and_unindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.compare_index(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), "doc_id")
