"""Both summary profiles with the mock backend, and the sample corpus through index, ranking and tables."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import chunks, privacy, retrieval, tables
from corpusmill.plans import models, summarise
from corpusmill.sources import files, pdf, samples


@pytest.mark.parametrize("profile", [summarise.A, summarise.B])
def test_profiles(spark, profile):
    body = "The plan for skills in the region is to train young people and to fund places for it with partners. "
    docs = spark.createDataFrame([("short", "tiny"), ("plain", body * 8), ("long", "\n\n".join([body * 10] * 30)), ("null", None)], "doc string, text string")
    rows = {r["doc"]: r for r in summarise.summarise(docs, profile, models.mock_summary).collect()}
    assert rows["short"]["status"] == rows["null"]["status"] == "skipped"
    assert rows["plain"]["status"] in ("ok", "OK") and rows["plain"]["attempts"] == 1 and len(rows["plain"]["record"]["summary"].split()) == 60
    assert rows["long"]["record"] is not None and set(rows) == {"short", "plain", "long", "null"}


def test_bad_replies(spark):
    docs = spark.createDataFrame([("broken", "word " * 100), ("wordy", "word " * 100)], "doc string, text string")
    long_ = '{"title": "T", "summary": "' + "One sentence of six words here. " * 15 + '", "keywords": "a,b,c"}'
    replies = [("broken", i, "no json") for i in range(1, 5)] + [("wordy", i, long_) for i in range(1, 5)]
    backend = models.replay(spark.createDataFrame(replies, "prompt_id string, attempt int, reply string"))
    a = {r["doc"]: r for r in summarise.summarise(docs, summarise.A, backend).collect()}
    assert a["broken"]["status"] == "failed" and a["wordy"]["status"] == "auto_trimmed" and len(a["wordy"]["record"]["summary"].split()) <= 80
    b = {r["doc"]: r["status"] for r in summarise.summarise(docs, summarise.B, backend).collect()}
    assert b == {"broken": "failed", "wordy": "NEEDS HUMAN REVIEW"}


def test_sample_corpus_end_to_end(spark, tmp_path):
    names = samples.write_corpus(str(tmp_path / "c"))
    docs = files.read_texts(spark, str(tmp_path / "c"))
    assert sorted(r["doc"] for r in docs.collect()) == names[:-1]  # a file without a byte has no row
    clean = privacy.scrub(docs)
    assert privacy.leaks(clean.select("doc", F.col("scrubbed").alias("text"))).count() == 0
    passages = chunks.passages(clean.select("doc", F.col("scrubbed").alias("text")))
    index = retrieval.build_index(passages, "id", F.concat_ws(" ", "text", "section", "title"))
    asked = spark.createDataFrame([(1, "Which measures concern green jobs?"), (2, "What is the capital of Peru?")], "q int, x string")
    found = retrieval.top_passages(index, asked, "q", "x")
    assert found.filter("qid = 1 and rank = 1").first()["key"].startswith("04_green_jobs")
    gates = {r["qid"]: r["gate"] for r in retrieval.gate(index, asked, "q", "x", found, 1.0, 0.5).collect()}
    assert gates[1] == "passed" and gates[2] != "passed"
    assert tables.dataset(tables.pipe_rows(docs)).count() == 24


def test_sample_pdfs(spark, tmp_path):
    samples.write_pdfs(str(tmp_path))
    pages = pdf.read_pages(files.scan(spark, str(tmp_path), (".pdf",)))
    assert tables.pipe_rows(pdf.page_markdown(pages)).count() == 12
    checks = samples.preflight([str(tmp_path), str(tmp_path / "no")], [{"backend": "http", "model": "m"}, {"backend": "http", "model": "m"}, {}], {"m:latest": True})
    assert [c[2] for c in checks if c[0] == "folder"] == [True, False] and [c for c in checks if c[0] == "model"] == [("model", "http:m", True), ("model", "mock:", True)]
