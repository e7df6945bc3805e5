"""Loops with the mock backends, sources and sinks on files."""

from functools import partial

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import payload
from corpusmill.operators import chunks, retrieval, tables, validation
from corpusmill.plans import loops, models, queries_more
from corpusmill.sources import files, pdf, sinks


def judge(reply):
    reason = validation.objective_reason(reply)
    return F.struct((reason == "ok").alias("ok"), reason.alias("reason"))


def test_ask_until(spark):
    tasks = spark.createDataFrame([("t1",), ("t2",)], "topic string")
    prompt = F.concat(F.lit("<topic>"), "topic", F.lit("</topic>"), F.coalesce("complaint", F.lit("")))
    rounds = loops.ask_until(tasks, "topic", prompt, judge, models.mock_objective())
    assert rounds.count() == 4 and {(r["topic"], r["attempts"]) for r in loops.accepted(rounds, "topic").collect()} == {("t1", 2), ("t2", 2)}
    never = loops.ask_until(tasks, "topic", prompt, judge, models.replay(spark.createDataFrame([("t1", 1, "Nope")], "prompt_id string, attempt int, reply string")), most=2)
    assert loops.accepted(never, "topic").count() == 0


def test_answer_status(spark):
    rounds = spark.createDataFrame([(1, 1, "a", False, "x"), (1, 2, "b", True, "cited 1 of 4"), (2, 1, "c", True, "evidence declared insufficient"), (3, 2, "d", False, "x"), (4, 1, None, False, "x")], "qid int, attempt int, reply string, ok boolean, reason string")
    gates = spark.createDataFrame([(i, "passed") for i in range(1, 5)] + [(5, "refused_score")], "qid int, gate string")
    got = {r["qid"]: (r["status"], r["attempts"]) for r in loops.answer_status(rounds, gates).collect()}
    assert got == {1: ("answered", 2), 2: ("refused_by_model", 1), 3: ("refused_failed_verification", 2), 4: ("error", 1), 5: ("refused_no_evidence", 0)}


def test_questions_are_asked_over_whole_passages(spark, tmp_path, monkeypatch):
    """What tells lies at the end of passages of up to 65,000 characters; the prompts of both attempts hold every character of all of them."""
    texts = {i: f"{'filler words ' * n} the granary of tamarisk number {i} opened in autumn {i}" for i, n in enumerate((380, 5000, 0, 77), 1)}
    spark.createDataFrame([(i, t, "src", "en") for i, t in texts.items()], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = range(40)
    spark.createDataFrame([(i, "granary of tamarisk opened in autumn") for i in ids], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, t, "user", "said") for i in ids for t in (1, 3)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    seen, replay = [], models.replay

    def recorded(replies):
        backend = replay(replies)

        def run(prompts):
            seen.extend((r["attempt"], r["prompt"]) for r in prompts.collect())
            return backend(prompts)

        return run

    monkeypatch.setattr(models, "replay", recorded)
    monkeypatch.setattr(retrieval, "gate", partial(retrieval.gate, least_score=0.0, least_coverage=0.0))
    rows = queries_more.answers_with_retry(spark, str(tmp_path)).collect()
    assert len(rows) == 40 and {a for a, _ in seen} == {1, 2} and len(seen) > 40
    for _, prompt in seen:
        assert sorted(p.partition("src / en\n")[2] for p in prompt.partition("\n\nQuestion: ")[0].split("\n\n") if p[:2] == "[S") == sorted(texts.values())


def test_control_loop(spark):
    state = spark.createDataFrame([("b.pdf", False, False, False), ("a.pdf", True, False, False)], "source string, converted boolean, summarised boolean, tables boolean")
    worker = loops.Worker({s: (lambda todo: todo.withColumn("output", F.lit("x"))) for s in loops.STAGES})
    done = worker.run(state)
    assert done.filter("converted and summarised and tables").count() == 2 and [x["stage"] for x in worker.log] == list(loops.STAGES)
    assert loops.next_actions(done).first()["stage"] == "report" and loops.next_actions(state.limit(0)).first()["stage"] == "list"
    assert loops.report_complete(done, "### a\n\n### b\n").first()[0] and not loops.report_complete(done, "### a\n").first()[0]
    asked = spark.createDataFrame([(1, "convert", "a.pdf"), (2, "summarise", "b.pdf"), (3, "fly", "a.pdf"), (4, "convert", "z.pdf"), (5, "report", ""), (6, "summarise", "a.pdf")], "step int, tool string, target string")
    assert [r["reason"] for r in loops.precondition(state, asked).orderBy("step").collect()] == ["already done", "not converted", "unknown tool", "unknown target", "documents not ready", ""]


def test_stuck_worker_stops(spark):
    state = spark.createDataFrame([("a", False, False, False)], "source string, converted boolean, summarised boolean, tables boolean")
    worker = loops.Worker({s: (lambda todo: todo.withColumn("output", F.lit(""))) for s in loops.STAGES})
    assert worker.run(state).filter("converted").count() == 0 and len(worker.log) == 1


def test_evolution_arc():
    scores = {"": 0.0, "s1": 1 / 3, "s2": 2 / 3, "s3": 0.0, "s4": 1.0, "s5": 1.0}
    log = loops.evolve(scores.__getitem__, lambda skill, i: f"s{i}", "", 5)
    assert [(round(x["score"], 2), x["kept"]) for x in log] == [(0.0, True), (0.33, True), (0.67, True), (0.0, False), (1.0, True)]


def test_patterns_grow(spark):
    known = spark.createDataFrame([], "name string, reason string, first_iteration int, evidence array<struct<iteration:int,n:bigint>>")
    failures = spark.createDataFrame([("N words", 2)], "pattern string, n long")
    once = loops.upsert_patterns(known, failures, 1)
    rows = loops.upsert_patterns(once, failures.union(spark.createDataFrame([("other", 1)], "pattern string, n long")), 2).orderBy("name").collect()
    assert [(r["name"], r["first_iteration"], len(r["evidence"])) for r in rows] == [("n-words", 1, 2), ("other", 2, 1)]


def test_map_reduce_and_pairs(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "k int, t string")
    pieces = chunks.word_windows(docs, "k", "t", 2, 0)
    got = loops.map_reduce_summary(pieces, "k", "window_no", "window", "<document>{{TEXT}}</document>", models.mock_summary).first()["material"]
    assert got.count('"summary"') == 3 and got.index("a b") < got.index("c d") < got.index("e f")
    pairs = loops.paired_prompts(docs, "k", {"with": F.lit("x"), "without": F.lit("y")})
    assert sorted(r["prompt_id"] for r in pairs.collect()) == ["1|with", "1|without"]


def test_text_and_front_matter(spark, tmp_path):
    (tmp_path / "b.MD").write_bytes(b"\xef\xbb\xbfhi \xff")
    (tmp_path / "README.md").write_text("x")
    (tmp_path / "c.pdf").write_bytes(pdf.minimal_pdf(["One (1)", "Two"]))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.txt").write_text("deep")
    texts = {r["doc"]: r["text"] for r in files.read_texts(spark, str(tmp_path), recursive=True).collect()}
    assert set(texts) == {"b.MD", "README.md", "sub/d.txt"} and texts["b.MD"].startswith("hi ")
    assert {r["doc"] for r in files.summary_files(files.scan(spark, str(tmp_path), (".md",))).collect()} == {"b.MD"}
    rows = pdf.read_pages(files.scan(spark, str(tmp_path), (".pdf",)).unionByName(files.scan(spark, str(tmp_path), (".txt",), True))).collect()
    got = {r["doc"]: r for r in rows}
    assert "One (1)" in got["c.pdf"]["pages"][0] and got["c.pdf"]["error"] is None and got["sub/d.txt"]["error"]
    settings, body = files.front_matter("---\nname: x # c\nn: 3\nok: true\nl: [a, 2]\nq: \"a: b\"\n---\nBody")
    assert settings == {"name": "x", "n": 3, "ok": True, "l": ["a", 2], "q": "a: b"} and body == "Body" and files.front_matter("none")[0] == {}


def test_config(tmp_path, monkeypatch):
    (tmp_path / "c.json").write_text('{"a": {"b": 2}}')
    monkeypatch.setenv("X_HOST", "h")
    got = files.load_config({"a": {"b": 1, "c": 1}, "host": ""}, str(tmp_path / "c.json"), {"X_HOST": ("host",)})
    assert got == {"a": {"b": 2, "c": 1}, "host": "h"} and files.host_address("0.0.0.0") == "http://127.0.0.1:11434"


def test_records_round_trip(spark):
    raw = '{"title": "T|x", "issuing_body": "B|b", "country_or_region": "", "year": 2024, "document_type": "Report", "summary": "It says so.", "keywords": ["a", "b", "c"]}'
    df = spark.createDataFrame([("f.pdf", raw)], "source string, raw string").withColumn("r", payload.summary_record(payload.json_object_text(F.col("raw"))))
    df = df.withColumn("md", sinks.render_record_a(F.col("r"), F.col("source"), "agent", "model", "2024-01-01"))
    row = df.select("md", tables.parse_summary_a(F.col("md")).alias("p"), validation.file_errors(tables.parse_summary_a(F.col("md"))).alias("e")).first()
    assert row["p"]["fields"]["Issuing body"] == "B|b" and row["p"]["keywords"] == ["a", "b", "c"] and row["p"]["summary"] == "It says so." and row["e"] == []
    broken = df.select(validation.file_errors(tables.parse_summary_a(F.lit("no title"))).alias("e")).first()["e"]
    assert "missing title" in broken and "missing summary" in broken and "missing keywords" in broken


def test_sinks(spark, tmp_path):
    log = spark.createDataFrame([("2024-05-01T10:00:00", "ok"), ("2024-06-01T10:00:00", "failed")], "time string, status string")
    sinks.append_log(log, str(tmp_path / "log"))
    sinks.append_log(log, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).groupBy("yyyymm").count().orderBy("yyyymm").collect()[0]["count"] == 2
    passages = chunks.passages(spark.createDataFrame([("d", "# T\n## A\nx y")], "doc string, text string"))
    assert '"documents":["d"]' in sinks.export_index(passages, "2024", "f", 180, 40).first()["json"]
    html = sinks.html_rows(spark.createDataFrame([("<b>", "1,5")], "a string, b string"), ["a", "b"]).first()["html"]
    assert html == '<tr><td>&lt;b&gt;</td><td class="n">1,5</td></tr>'
    assert "### a b" in sinks.report("R", {"a_b.pdf": "t"}, ["a_b.pdf"], "p")["md"]


def test_streaming_extension(spark, tmp_path):
    from corpusmill.streaming.incremental import process_new, stream_table

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, t string")
    rows.write.parquet(str(tmp_path / "in"))
    query = process_new(stream_table(spark, str(tmp_path / "in"), rows.schema), lambda b: b.filter("k > 1"), str(tmp_path / "out"), str(tmp_path / "c"))
    query.awaitTermination()
    assert [r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2]


def test_backend_choice(monkeypatch):
    monkeypatch.delenv("CORPUSMILL_BACKEND", raising=False)
    assert models.choose(None, {}) == "mock" and models.choose(None, {"backend": "http"}) == "http" and models.choose("replay", {"backend": "http"}) == "replay"
    monkeypatch.setenv("CORPUSMILL_BACKEND", "env")
    assert models.choose(None, {"backend": "http"}) == "env"


@pytest.mark.parametrize("style", ["completion", "chat"])
def test_http_errors_are_data(spark, style):
    prompts = spark.createDataFrame([("p", 1, "x")], "prompt_id string, attempt int, prompt string")
    row = models.http("http://127.0.0.1:9/api", "m", style, timeout=1)(prompts).first()
    assert row["reply"] is None and row["status"].startswith("error")


def test_pdf_with_tables_and_figures(spark):
    from corpusmill.sources.pdf_writer import Figure, Line, Table, markdown_pdf, write_pdf

    table = Table([["Country", "Share (%)"], ["Austria", "12,5"], ["Côte (d'Ivoire)", "7"]])
    data = write_pdf([[Line("Report", 18, True), "Some prose on Austria.", table, "Austria  12,5", Figure("Figure 1: a curve")], ["Second page.", Figure()]])
    assert pdf.extract(data, "b")[0][1] == "Second page." and len(pdf.extract(data)[0]) == 2
    rows = spark.createDataFrame([("my_report.pdf", data), ("bad.pdf", b"nothing")], "doc string, content binary")
    got = {r["doc"]: r for r in pdf.read_layout(rows).select("doc", "error", pdf.index_text(F.col("pages")).alias("i"), pdf.layout_markdown(F.col("doc"), F.col("pages")).alias("m")).collect()}
    assert got["bad.pdf"]["error"] and got["my_report.pdf"]["error"] is None
    assert got["my_report.pdf"]["m"] == """# my report

*Converted from `my_report.pdf`. Figures are noted, not OCR'd.*

## Page 1

Report
Some prose on Austria.
Figure 1: a curve

| Country | Share (%) |
|---|---|
| Austria | 12,5 |
| Côte (d'Ivoire) | 7 |

> **[Image 1 on page 1]** — Figure 1: a curve _(image content not extracted; no OCR was performed)_

## Page 2

Second page.

> **[Image 1 on page 2]** — no caption found in the page text _(image content not extracted; no OCR was performed)_
"""
    assert got["my_report.pdf"]["i"].split("\n")[0] == "## Page 1" and "Austria | 12,5" in got["my_report.pdf"]["i"].split("\n")
    long_ = pdf.extract(write_pdf([[f"line {i}" for i in range(200)]]))[0]
    assert len(long_) > 1 and "\n".join(long_).split("\n") == [f"line {i}" for i in range(200)]
    shown = "\n".join(pdf.extract(markdown_pdf("# Head\n\nSome **bold** text.\n\n| a | b |\n|---|---|\n- one"))[0])
    assert shown == "Head\nSome bold text.\n• one"


def test_foreign_pdf_commands():
    body = rb"BT /F1 10 Tf 14 TL 50 700 Td (A \(b\) \101) Tj T* [(C) -300 (d)] TJ (e) ' ET 10 10 20 20 re S"
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1/Resources<<>>>>", b"<</Type/Page/Parent 2 0 R/Contents[4 0 R]>>", b"<</Length %d>>stream\r\n%b\nendstream" % (len(body), body)]
    data = b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n%b\nendobj" % (i, o) for i, o in enumerate(objects, 1))
    assert pdf.extract(data)[0] == ["A (b) A\nC d\ne"] and pdf.extract(b"%PDF-1.4\n")[0] == []


def test_model_server(spark):
    """Embeddings together, one by one, and not at all; installed models and token counts."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Server(BaseHTTPRequestHandler):
        def answer(self, data, status=200):
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(data).encode())

        def do_GET(self):
            self.answer({"models": [{"name": "small:latest"}]})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if self.path == "/api/embed":
                good = body["model"] == "small" and "odd" not in " ".join(body["input"])
                self.answer({"embeddings": [[len(t), 1.0] for t in body["input"]]} if good else {"error": "x"}, 200 if good else 404)
            elif self.path == "/api/embeddings":
                self.answer({"embedding": [] if body["prompt"] == "very odd" else [len(body["prompt"]), 1.0]})
            else:
                self.answer({"response": "x", "prompt_eval_count": len(body["prompt"].split())})

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        assert models.is_ready(models.installed(url), "small") and not models.is_ready(models.installed(url), "large") and models.installed("http://127.0.0.1:9") == []
        embed = models.http_embeddings(url, "small", together=2)
        vectors = lambda texts: {r["key"]: r["vector"] for r in models.whole_or_none(embed(spark.createDataFrame(list(enumerate(texts)), "key long, text string"))).collect()}
        assert vectors(["a", "bb", "odd"]) == {"0": [1.0, 1.0], "1": [2.0, 1.0], "2": [3.0, 1.0]}
        assert vectors(["a", "very odd"]) == {"0": None, "1": None}
        down = models.http_embeddings("http://127.0.0.1:9", "small", timeout=1)
        assert down(spark.createDataFrame([(1, "a")], "key long, text string")).first()["vector"] is None
        prompts = spark.createDataFrame([("p", "one two three")], "prompt_id string, prompt string")
        assert models.prompt_tokens(url, "small")(prompts).first()["tokens"] == 3 and models.prompt_tokens("http://127.0.0.1:9", "m", 1)(prompts).first()["tokens"] is None
    finally:
        server.shutdown()
