"""Chunks, retrieval, privacy, validation, tables and evaluation on small made-up inputs."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import index as index_module
from corpusmill.operators import chunks, evaluation, privacy, retrieval, tables, validation


def test_windows_golden(spark):
    words = " ".join("abcdefghij")
    df = spark.createDataFrame([(1, words), (2, "a\nb"), (3, "  "), (4, None)], "k int, t string")
    got = [(r["k"], r["window"]) for r in chunks.word_windows(df, "k", "t", 4, 1).orderBy("k", "window_no").collect()]
    assert got == [(1, "a b c d"), (1, "d e f g"), (1, "g h i j"), (2, "a\nb")]


@pytest.mark.parametrize(("n", "count"), [(180, 1), (181, 2), (320, 2), (321, 3)])
def test_window_counts(spark, n, count):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "k int, t string")
    rows = chunks.word_windows(df, "k", "t").orderBy("window_no").collect()
    assert len(rows) == count and {w for r in rows for w in r["window"].split()} == {f"w{i}" for i in range(n)}


def test_sections_and_passages(spark):
    doc = "intro line\n\n# Title\n\n## Part one\nbody a\nbody b\n## Empty\n\n## Last\nend"
    df = spark.createDataFrame([("d.md", doc), ("e.md", "# Only a title"), ("f.md", "")], "doc string, text string")
    got = [(r["id"], r["title"], r["section"], r["text"]) for r in chunks.passages(df).orderBy("id").collect()]
    assert got == [("d.md#000", "d.md", "(no section)", "intro line"), ("d.md#001", "d.md", "Part one", "body a\nbody b"), ("d.md#002", "d.md", "Last", "end")]


@pytest.mark.parametrize(("n", "most", "profile", "kept"), [
    (25, 20, "head", [0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 12, 13, 14, 16, 17, 18, 19, 21, 22, 23]),
    (25, 10, "ends", [0, 3, 5, 8, 11, 13, 16, 19, 21, 24]), (6, 3, "ends", [0, 2, 5]), (3, 5, "head", [0, 1, 2]),
])
def test_even_samples(spark, n, most, profile, kept):
    df = spark.createDataFrame([("d", i) for i in range(n)], "k string, no int")
    assert [r["no"] for r in chunks.even_sample(df, "k", "no", most, profile).orderBy("no").collect()] == kept


def test_folded_chunks(spark):
    df = spark.createDataFrame([(1, "aa\n\nbb\n\ncc"), (2, "x" * 25), (3, None)], "k int, t string")
    got = [(r["k"], r["chunk"]) for r in chunks.packed_paragraphs(df, "k", "t", 9, 2).orderBy("k", "chunk_no").collect()]
    assert got[:2] == [(1, "aa\n\nbb"), (1, "bb\n\ncc")] and [len(c) for k, c in got if k == 2] == [9, 9, 9, 4]
    cut = [r["chunk"] for r in chunks.boundary_windows(spark.createDataFrame([(1, "One two. Three four five")], "k int, t string"), "k", "t", 12, 0).orderBy("chunk_no").collect()]
    assert cut[0] == "One two."


DOCS = ["skills policy for young people", "the national skills strategy", "zebra crossing", "skills skills skills", ""]


def plain_bm25(question):
    tok = lambda t: re.findall("[a-z0-9]+", t.lower())
    docs = [tok(d) for d in DOCS]
    df, mean = Counter(t for d in docs for t in set(d)), sum(map(len, docs)) / len(docs)
    out = []
    for d in docs:
        tf = Counter(d)
        out.append(sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in tok(question) if t in tf))
    return out


def test_bm25_against_formula(spark):
    index = retrieval.build_index(spark.createDataFrame(list(enumerate(DOCS)), "k int, t string"), "k", F.col("t"))
    asked = spark.createDataFrame([(1, "skills skills policy"), (2, "nothing here")], "q int, x string")
    rows = retrieval.top_passages(index, asked, "q", "x").orderBy("qid", "rank").collect()
    plain = plain_bm25("skills skills policy")
    order = sorted(range(5), key=lambda i: (-plain[i], i))[:4]
    assert [r["key"] for r in rows if r["qid"] == 1] == order
    assert [r["score"] for r in rows if r["qid"] == 1] == [pytest.approx(plain[i]) for i in order]
    assert [(r["key"], r["score"]) for r in rows if r["qid"] == 2] == [(0, 0.0), (1, 0.0), (2, 0.0), (3, 0.0)]


def test_gate(spark):
    index = retrieval.build_index(spark.createDataFrame(list(enumerate(DOCS)), "k int, t string"), "k", F.col("t"))
    asked = spark.createDataFrame([(1, "skills policy"), (2, "capital of Peru"), (3, "zebra unrelated words entirely missing")], "q int, x string")
    found = retrieval.top_passages(index, asked, "q", "x")
    got = {r["qid"]: r["gate"] for r in retrieval.gate(index, asked, "q", "x", found, 0.5, 0.55).collect()}
    assert got == {1: "passed", 2: "refused_score", 3: "refused_coverage"}


def test_fusion_golden(spark):
    kw = spark.createDataFrame([(1, "a", 0, 9.0), (1, "b", 1, 5.0)], "qid int, key string, ord int, score double")
    dn = spark.createDataFrame([(1, "b", 1, 0.9), (1, "a", 0, 0.1)], "qid int, key string, ord int, score double")
    rows = retrieval.fused(kw, dn).orderBy("rank").collect()
    assert [r["key"] for r in rows] == ["a", "b"] and rows[0]["score"] == pytest.approx(1 / 60 + 1 / 61)


def test_citations(spark):
    answers = ["", "INSUFFICIENT_EVIDENCE", "x" * 70 + " insufficient_evidence", "no marks", "a [S1] b [S1]", "c [S9][S5] d", None]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string")
    got = [r["c"] for r in df.select("i", retrieval.citation_check(F.col("a"), F.lit(4)).alias("c")).orderBy("i").collect()]
    assert [c["ok"] for c in got] == [False, True, False, False, True, False, False]
    assert got[4]["reason"] == "cited 1 of 4" and got[5]["reason"].endswith("[S5], [S9]")


def test_evaluation_rates(spark):
    questions = spark.createDataFrame([(1, "answered", "d1"), (2, "refused", None), (3, "answered", "zz")], "qid int, expect string, expect_doc string")
    results = spark.createDataFrame([(1, "answered", 2), (2, "refused_by_model", 1), (3, "error", 1)], "qid int, status string, attempts int")
    found = spark.createDataFrame([(1, "d1.md"), (3, "d1.md")], "qid int, doc string")
    r = retrieval.evaluation_rates(retrieval.evaluation_rows(questions, results, found)).first()
    assert (r["retrieval_hit_rate"], r["answered_rate"], r["refused_rate"], r["retried"]) == (0.5, 0.5, 1.0, 1)
    empty = retrieval.evaluation_rates(retrieval.evaluation_rows(questions.limit(0), results, found)).first()
    assert empty["answered_rate"] == 0.0


PEOPLE = [
    ("a.md", "Mail ana.b@example.org or +41 22 791 61 11. Dr Maria\nSanchez met Dr Maria Sanchez and @handle_1. Call Bo Li."),
    ("b.md", "Again ana.b@example.org; IBAN CH93 0076 2011 6238 5295 7; see https://x.org/a@b.ch. Bo Lindt."),
    ("c.md", None),
]


def test_scrub(spark):
    docs = spark.createDataFrame(PEOPLE, "doc string, text string")
    out = {r["doc"]: r["scrubbed"] for r in privacy.scrub(docs, ["Bo", "Bo Li", ""]).collect()}
    assert "example.org" not in out["a.md"] and out["a.md"].count("[EMAIL_1]") == 1 and "[EMAIL_1]" in out["b.md"]
    assert "[PHONE_1]" in out["a.md"] and "[HANDLE_1]" in out["a.md"] and "[IBAN_1]" in out["b.md"] and "Call [PERSON_" in out["a.md"]
    assert "\nSanchez" in out["a.md"] and out["c.md"] == "" and "Lindt" in out["b.md"]
    tokens = privacy.pseudonyms(privacy.find_identifiers(docs, ["Bo", "Bo Li"])).collect()
    assert len({r["token"] for r in tokens}) == len(tokens) == len({(r["label"], r["value"]) for r in tokens})
    report = privacy.anonymisation_report(privacy.find_identifiers(docs)).filter("doc = 'a.md'").first()
    assert report["total"] == 5
    again = privacy.scrub(spark.createDataFrame(list(out.items()), "doc string, text string"))
    assert {r["doc"]: r["scrubbed"] for r in again.collect()} == out


def test_planted_leak_is_found(spark):
    docs = spark.createDataFrame([("a", "clean"), ("b", "planted x@y.org and 022 791 61 11 and +41 22 791 61 11")], "doc string, text string")
    assert [(r["doc"], r["kind"]) for r in privacy.leaks(docs).orderBy("kind").collect()] == [("b", "email"), ("b", "phone")]


def test_summary_checks(spark):
    texts = ["word " * 81, "- a\n- b", "One.\n\nTwo.", "Great! We did a landmark thing.", "It states facts."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", validation.summary_errors_a(F.col("t")).alias("e"), validation.summary_warnings_a(F.col("t")).alias("w")).orderBy("i").collect()
    assert ["maximum" in rows[0]["e"][0], "list" in rows[1]["e"][0], "paragraph" in rows[2]["e"][0], len(rows[3]["e"]), rows[4]["e"]] == [True, True, True, 3, []]
    assert any("great" in w for w in rows[3]["w"])
    b = df.select("i", validation.summary_problems_b(F.col("t"), least=1).alias("p")).orderBy("i").collect()
    assert b[4]["p"] == [] and "not in English" in b[0]["p"]


def test_objectives(spark):
    answers = ["", '"Explain the policy."', "- Understand it", "Explain " + "a " * 25, "Explain one. Two. ", "Explain a\nb", "1. Design a plan.", "Calibrate a meter."]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string")
    rows = df.select("i", validation.objective_reason(F.col("a")).alias("r"), validation.objective_score(F.col("a")).alias("s")).orderBy("i").collect()
    assert [r["r"] for r in rows] == ["empty answer", "ok", "opened with 'understand', not an allowed verb", "26 words, limit is 20", "2 sentences, one is allowed", "more than one line", "ok", "opened with 'calibrate', not an allowed verb"]
    assert rows[7]["s"]["score"] == 1.0


def test_pipe_tables_are_read_without_sorting(spark):
    df = spark.createDataFrame([("d", "\u2003| A | B |\r\n|-|:-:|\u2028\n|| 1 | x |\x0b| 2\n\n| C |\n\n| lone |"), ("n", None)], "doc string, text string")
    rows = tables.pipe_rows(df)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan and "Exchange" not in plan
    got = [(r["doc"], r["row_no"], [tuple(e) for e in r["entries"]]) for r in rows.collect()]
    assert got == [("d", 0, [("A", "1"), ("B", "x")]), ("d", 1, [("A", "2"), ("B", "")])]


def test_pipe_tables(spark):
    a = "| Year | Count | Note |\n|---|---|---|\n| 2020 | 1 234,5 | x |\n| 2021 | 7 |\n| | 3 | |\n| 2020 | 9 | y | extra |\n\ntext | no\n\n| B | C |\n|:-:|-|\n| k | n/a |"
    df = spark.createDataFrame([("d", a), ("e", "no table"), ("f", "| lone |")], "doc string, text string")
    rows = tables.pipe_rows(df).orderBy("row_no").collect()
    assert len(rows) == 5 and [e["value"] for e in rows[1]["entries"]] == ["2021", "7", ""] and len(rows[3]["entries"]) == 3
    flat = tables.dataset(tables.pipe_rows(df))
    assert [(r["category"], r["numeric"][0]["number"]) for r in flat.orderBy("row_no").collect()] == [("2020", 1234.5), ("2021", 7.0), ("2020", 9.0)]
    groups = tables.chart_groups(flat)
    assert {r["category"]: r["value"] for r in groups.collect()} == {"2020": 9.0, "2021": 7.0}
    assert [r["category"] for r in tables.category_order(groups).orderBy("place").collect()] == ["2020", "2021"]


def test_gate_replay_golden(spark):
    df = spark.createDataFrame([("r", i, s) for i, s in enumerate([0.33, 0.67, 0.0, 1.0, 1.0])], "k string, i int, score double")
    rows = evaluation.gate_replay(df, F.lit(0.0), "k", "i").orderBy("i").collect()
    assert [r["kept"] for r in rows] == [True, True, False, True]
    final = evaluation.final_scores(evaluation.gate_replay(df, F.lit(0.0), "k", "i"), F.lit(0.0), "k").first()
    assert (final["final_score"], final["kept_runs"], final["rolled_back"]) == (1.0, 3, 1)


def test_index_against_disk_and_links(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "doc string"), spark.createDataFrame([("y",), ("z",)], "doc string")
    assert {(r["doc"], r["state"]) for r in evaluation.compare_index(a, b, "doc").collect()} == {("x", "stale"), ("z", "unindexed")}
    pages = spark.createDataFrame([("a/b.md", "[1](c.md#x) [2](../d.md) [3](https://e.org) [4](mailto:f@g) [5](#h) [6](gone.md)")], "path string, text string")
    targets = spark.createDataFrame([("a/c.md",), ("d.md",)], "path string")
    assert [r["link"] for r in evaluation.broken_links(pages, targets).collect()] == ["gone.md"]


def test_plans(spark):
    scores = spark.range(100).selectExpr("id % 5 as qid", "id as key", "id as ord", "cast(id as double) as score")
    plan = retrieval.best(scores, 4)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_pruned_ranking_is_the_whole_one(spark, monkeypatch):
    import random

    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    draw = lambda n: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(300)], k=n))
    docs = spark.createDataFrame([(i, draw(rng.randrange(0, 60))) for i in range(300)], "doc long, text string")
    asked = spark.createDataFrame([(i, draw(rng.randrange(0, 25))) for i in range(30)] + [(99, "nowhere")], "q long, text string")
    monkeypatch.setattr(index_module, "BLOCK", 8)
    index = retrieval.build_index(docs, "doc", F.col("text"))
    every = retrieval.best(retrieval.keyword_scores(index, asked, "q", "text"), 4)
    rows = lambda df: sorted((r["qid"], r["rank"], r["key"], round(r["score"], 9)) for r in df.collect())
    want = rows(every)
    for seeds in (1, 3, 10**9):
        monkeypatch.setattr(index_module, "SEED_BLOCKS", seeds)
        report = {}
        assert rows(retrieval.best_keyword_scores(index, asked, "q", "text", 4, report)) == want
        assert report["read"] < report["blocks"] if seeds == 1 else report["read"] <= report["blocks"]


def test_numbers_over_ranges(spark):
    from corpusmill.storage import numbered

    df = spark.range(1000).selectExpr("id", "(id * 7919) % 1000 as v", "id % 3 as g").repartition(5)
    rows = numbered(df, [F.col("v")], "n").collect()
    assert all(r["n"] == r["v"] + 1 for r in rows) and len(rows) == 1000
    by = {}
    for r in numbered(df, [F.desc("v")], "n", "g").collect():
        by.setdefault(r["g"], {})[r["n"]] = r["v"]
    assert all([v[i] for i in range(1, len(v) + 1)] == sorted(v.values(), reverse=True) for v in by.values())


def test_categories_are_ordered_without_groups_by_document(spark, monkeypatch):
    from corpusmill.plans import queries_more

    made, whole = [], tables.numbered
    monkeypatch.setattr(tables, "numbered", lambda df, *rest: made.append(df) or whole(df, *rest))
    assert sorted(r["place"] for r in queries_more.category_order(spark, "/root/testdata/sf0.001").collect()) == list(range(1, 8))
    assert "max_by" not in (plan := made[0]._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning(doc" not in plan.split("MapInArrow")[0]
    df = spark.createDataFrame([("e", "k", 0), ("d", "m", 7), ("d", "k", 9), ("d", "m", 2)], "doc string, category string, first_seen int")
    assert [r["category"] for r in tables.category_order(df).orderBy("place").collect()] == ["m", "k"]


def test_lines_are_dealt_by_their_number(spark, monkeypatch):
    from corpusmill import storage
    from corpusmill.plans import queries_more

    monkeypatch.setattr(storage, "PART_ROWS", 300)  # of some 6,000 lines
    dealt = queries_more._markdown(spark, "/root/testdata/sf0.001").groupBy(F.spark_partition_id()).agg(F.count("*"))
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(doc" in plan
    wanted = storage.parts_of(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"))
    assert wanted >= 20 and wanted - 3 <= dealt.count() <= wanted


def test_records_are_taken_from_json_once(spark):
    from corpusmill.functions import payload

    reply = ' {"title": ["A", " B "], "issuing_body": "N/A", "year": 2024, "summary": ["One.", "Two."], "keywords": ["a.", "b", "A", null, "c"]} \n'
    df = spark.createDataFrame([(0, reply), (1, f"so: {reply} end"), (2, " "), (3, None), (4, "[1]"), (5, '{"keywords": "x; y, X", "title": null}')], "i int, t string")
    out = df.select("i", payload.summary_record(payload.json_object_text(F.col("t"))).alias("r"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("static_invoke(Variant") == 2 and plan.count("get_json_object") == 7
    got = [tuple(r["r"]) if r["r"] else None for r in out.orderBy("i").collect()]
    none = "Not stated"
    first = ("A, B", none, none, "2024", none, "One. Two.", ["a", "b", "c"])
    assert got == [first, first, None, None, None, (none, none, none, none, none, "", ["x", "y"])]


def test_parts_of_a_record_are_read_once(spark):
    text = "# T\n| Field | Value |\n|---|---|\n| Year | 1 |\n | Year | a\\|b |\n|x|\n## Summary\nold\n## summary \n\n new \n---\n## Keywords\n a; ;b\n"
    df = spark.createDataFrame([(0, text), (1, "## x"), (2, None)], "i int, t string")
    out = df.select("i", tables.parse_summary_a(F.col("t")).alias("p"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(t#") + plan.count("split(concat(") <= 3
    got = [(r["p"]["title"], r["p"]["fields"], r["p"]["summary"], r["p"]["keywords"]) for r in out.orderBy("i").collect()]
    assert got == [("T", {"Year": "a|b"}, "new", ["a", "b"]), (None, {}, None, None), (None, None, None, None)]
