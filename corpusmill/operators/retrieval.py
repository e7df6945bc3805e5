"""BM25 and vector ranking over the stored index, rank fusion, the evidence gate, grounding and citation checks.

All questions of a set are ranked in one plan. Passages without a common term matter only where a question has fewer hits than places, and are filled
in there in index order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import cosine, coverage, reciprocal_rank
from ..functions.text import strip, tokens
from .index import DIGITS, Index, best, best_keyword_scores, build_index, index_of, keyword_scores, texts_at  # noqa: F401

#: Words that say nothing about relevance, passages per question, and the gate's thresholds (which fit one corpus only).
STOPWORDS = (
    "a an the of to in on for and or is are was were be been being do does did can could should would will shall may might must what which "
    "who whom whose how why when where that this these those it its as at by with from into our we you they i not no any all some more most "
    "other such than then there about after before during over under between per"
).split()
TOP_K, LEAST_SCORE, LEAST_COVERAGE = 4, 5.0, 0.55
#: What every grounded prompt begins with.
PROMPT_RULES = (
    "Use nothing but the numbered sources. Put the number of its source, like [S1], behind each statement. "
    "Where the sources do not answer the question, reply INSUFFICIENT_EVIDENCE and nothing else.\n\n"
)


def content_terms(x: Column) -> Column:
    """Tokens of over two letters that aren't stopwords, repeats kept."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(tokens(x), lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t))


def ranked(scores: DataFrame, tie: str = "ord") -> DataFrame:
    """With rank0, from 0: score descending, ties in index order."""
    return scores.withColumn("rank0", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", DIGITS)), tie)) - 1)


def top_passages(index: Index, questions: DataFrame, qid: str, question: str, k: int = TOP_K) -> DataFrame:
    """qid, rank (from 1), key, ord, block, score: k passages for each question. Where fewer have a term in common, the first of the index come with
    a score of 0: the first k and those already found are enough to fill k places, so k rows a question are added, not the whole index."""
    first_hits = best_keyword_scores(index, questions, qid, question, k).select("qid", "key", "ord", "block", "score")
    ids = questions.select(F.col(qid).alias("qid")).distinct()
    found = first_hits.groupBy("qid").agg(F.count("*").alias("found"))
    short = ids.join(found, "qid", "left").filter(F.coalesce("found", F.lit(0)) < k).select("qid")
    first = index.first(2 * k)
    fill = short.crossJoin(F.broadcast(first)).join(first_hits.select("qid", "key"), ["qid", "key"], "left_anti").select("qid", "key", "ord", "block", F.lit(0.0).alias("score"))
    return best(first_hits.unionByName(fill), k)


def dense_scores(vectors: DataFrame, questions: DataFrame) -> DataFrame:
    """qid, key, ord, score by cosine of vectors(key, vector) to questions(qid, vector), every pair: a set of questions against all rows, which
    stream past a block of questions each time."""
    pairs = vectors.select("key", "vector").crossJoin(questions.select("qid", F.col("vector").alias("q")))
    return pairs.select("qid", "key", F.col("key").alias("ord"), cosine(F.col("q"), F.col("vector")).alias("score"))


def fused(keyword: DataFrame, dense: DataFrame, k: int = TOP_K) -> DataFrame:
    """qid, rank, key, score, keyword_score: reciprocal ranks of both rankings (qid, key, ord, score) added up; ties in keyword order. A passage
    in neither ranking can't be in the result."""
    a, b = ranked(keyword), ranked(dense)
    kw = a.select("qid", "key", "ord", F.col("rank0").alias("kw_rank"), F.col("score").alias("keyword_score"), reciprocal_rank(F.col("rank0")).alias("gain"))
    dn = b.select("qid", "key", "ord", F.lit(None).cast("int").alias("kw_rank"), F.lit(None).cast("double").alias("keyword_score"), reciprocal_rank(F.col("rank0")).alias("gain"))
    both = kw.unionByName(dn).groupBy("qid", "key").agg(F.sum("gain").alias("score"), F.min("kw_rank").alias("kw_rank"), F.max("keyword_score").alias("keyword_score"), F.min("ord").alias("ord"))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", DIGITS)), F.coalesce("kw_rank", F.lit(2**31 - 1)), "ord")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "rank", "key", "score", "keyword_score")


def gate(index: Index, questions: DataFrame, qid: str, question: str, found: DataFrame, least_score: float = LEAST_SCORE, least_coverage: float = LEAST_COVERAGE) -> DataFrame:
    """qid, best_score, coverage, gate: passed or why a question is refused before any model is asked. found: qid, rank, key, block, score (the
    keyword score; the first passage's counts). A low score is named before low coverage; a question without passages has both at 0."""
    texts = found.join(texts_at(index, found), "key").groupBy("qid").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("best_score"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "blob"))), lambda s: s["blob"]), " ").alias("blob"),
    )
    asked = questions.select(F.col(qid).alias("qid"), content_terms(F.col(question)).alias("terms"))
    rows = asked.join(texts, "qid", "left")
    rows = rows.select("qid", F.coalesce("best_score", F.lit(0.0)).alias("best_score"), coverage(F.col("terms"), F.coalesce("blob", F.lit(""))).alias("coverage"))
    why = F.when(F.col("best_score") < least_score, "refused_score").when(F.col("coverage") < least_coverage, "refused_coverage").otherwise("passed")
    return rows.withColumn("gate", why)


def sources_block(found: DataFrame, texts: DataFrame) -> DataFrame:
    """qid, sources, n_passages: found passages (qid, rank, key) as numbered sources. texts: key, doc, section, text."""
    part = F.concat(F.lit("[S"), F.col("rank").cast("string"), F.lit("] "), F.col("doc"), F.lit(" / "), F.col("section"), F.lit("\n"), F.col("text"))
    rows = found.join(texts, "key").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))).alias("parts"))
    return rows.select("qid", F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n").alias("sources"), F.size("parts").alias("n_passages"))


def grounded_prompt(question: Column, sources: Column, complaint: Column | None = None) -> Column:
    """Rules, sources and question; a complaint about the last answer is added where there is one."""
    rules = F.lit(PROMPT_RULES)
    again = F.coalesce(F.concat(F.lit("\n\nThe last answer was turned down: "), complaint), F.lit("")) if complaint is not None else F.lit("")
    return F.concat(rules, sources, F.lit("\n\nQuestion: "), question, again)


def citation_check(answer: Column, n_passages: Column) -> Column:
    """Struct(ok, reason): empty fails; the marker of insufficient evidence passes at the start or in a short reply; otherwise sources must be
    cited, and only ones that were supplied."""
    text = F.coalesce(answer, F.lit(""))
    bare = F.upper(strip(text))
    refusal = bare.startswith("INSUFFICIENT_EVIDENCE") | ((F.length(bare) < 60) & bare.contains("INSUFFICIENT_EVIDENCE"))
    cited = F.transform(F.regexp_extract_all(text, F.lit(r"\[S(\d+)\]"), 1), lambda n: n.cast("long"))
    supplied = F.when(n_passages > 0, F.sequence(F.lit(1).cast("long"), n_passages.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    invented = F.array_sort(F.array_except(cited, supplied))
    named = F.array_join(F.transform(invented, lambda n: F.concat(F.lit("[S"), n.cast("string"), F.lit("]"))), ", ")
    reason = (
        F.when(strip(text) == "", "empty answer")
        .when(refusal, "evidence declared insufficient")
        .when(F.size(cited) == 0, "no source cited")
        .when(F.size(invented) > 0, F.concat(F.lit("sources cited that were not supplied: "), named))
        .otherwise(F.concat(F.lit("cited "), F.size(F.array_distinct(cited)).cast("string"), F.lit(" of "), n_passages.cast("string")))
    )
    ok = refusal & (strip(text) != "") | ((F.size(cited) > 0) & (F.size(invented) == 0))
    return F.struct(ok.alias("ok"), reason.alias("reason"))


def evaluation_rows(questions: DataFrame, results: DataFrame, found: DataFrame) -> DataFrame:
    """questions(qid, expect, expect_doc) with results(qid, status, attempts) and found(qid, doc): behaviour_ok, and retrieval_hit, which is
    null where no document is expected."""
    docs = found.groupBy("qid").agg(F.collect_set("doc").alias("docs"))
    rows = questions.join(results, "qid", "left").join(docs, "qid", "left")
    behaved = F.when(F.col("expect") == "answered", F.col("status") == "answered").otherwise(F.col("status").startswith("refused"))
    none = F.array().cast("array<string>")
    hit = F.when(F.col("expect_doc").isNotNull(), F.exists(F.coalesce("docs", none), lambda d: d.contains(F.col("expect_doc"))))
    return rows.select("qid", "expect", "status", "attempts", F.coalesce(behaved, F.lit(False)).alias("behaviour_ok"), hit.alias("retrieval_hit"))


def evaluation_rates(rows: DataFrame) -> DataFrame:
    """One row: the three rates, each 0 over an empty set, and how many answers took a second attempt."""

    def rate(condition: Column, among: Column) -> Column:
        return F.coalesce(F.count_if(condition & among) / F.nullif(F.count_if(among), F.lit(0)), F.lit(0.0))

    answer = F.col("expect") == "answered"
    return rows.agg(
        rate(F.col("retrieval_hit"), F.col("retrieval_hit").isNotNull()).alias("retrieval_hit_rate"),
        rate(F.col("behaviour_ok"), answer).alias("answered_rate"),
        rate(F.col("behaviour_ok"), ~answer).alias("refused_rate"),
        F.count_if(F.col("attempts") > 1).alias("retried"),
    )
