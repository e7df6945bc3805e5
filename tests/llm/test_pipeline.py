"""The pipeline against its parts, stage by stage on what the stage before kept."""


import corpus_pipeline as pipeline
from corpusmill.llm import quality, secrets, substring, wordhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES:
        docs = pipeline.stored(stage(spark, docs, SF), "test-stage")
        seen[name] = {r["doc_id"]: r for r in docs.collect()} if name != "packing" else docs.collect()
        assert name == "packing" or docs.columns == columns
    first, near, windows, clean = (seen[n] for n, _ in pipeline.STAGES[:4])
    scores = {r["doc_id"]: r["score"] for r in quality.op3_quality(spark, SF).collect()}
    assert set(first) == {d for d, s in scores.items() if s >= 0.5}

    def shingles(t):
        w = wordhash.WORD.findall(t.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, keep = {d: shingles(r["text"]) for d, r in first.items()}, {}
    for d in sorted(sets):
        keep[d] = next((e for e in sorted(keep) if sets[d] and 100 * len(sets[d] & sets[e]) >= 75 * len(sets[d] | sets[e])), None)
    assert set(near) <= {d for d, e in keep.items() if e is None or keep[e] is None} and {d for d, e in keep.items() if e is None} >= set(near)
    assert set(windows) == set(near) == set(clean)
    for d, r in windows.items():
        assert len(r["text"]) == r["n_chars"]
        assert clean[d]["text"] == secrets.redact(r["text"])
    digests = {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(spark.createDataFrame([(d, r["text"]) for d, r in near.items()], "doc_id long, text string")).collect()}
    assert all(windows[d]["text"] == near[d]["text"] for d, n in digests.items() if not n)
    assert {p["doc_id"] for p in seen["packing"]} == set(clean)


def test_run_and_names(spark):
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "secret scans", "packing"]
    a = sorted(map(tuple, pipeline.run(spark, SF).collect()))
    assert a and a == sorted(map(tuple, pipeline.run(spark, SF).collect()))


def test_queries_are_registered():
    from corpusmill.llm.queries import ORACLE_SQL, QUERIES

    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} and set(ORACLE_SQL) <= set(QUERIES)


def test_stages_on_empty_and_awkward_tables(spark, awkward):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in enumerate(awkward)] + [(None, "null id", "en", "s", 7)] * 2, schema)
    odd = odd.selectExpr("*", "1 key", "2 marks", "3 kept", "4 node", "5 score", "6 _row", "7 _marked", "8 part", "9 start")
    for docs in (empty, odd):
        for name, stage in pipeline.STAGES:
            before = docs.count()
            out = pipeline.stored(stage(spark, docs, SF), "test-stage")
            after = out.count()
            if name == "packing":
                assert after >= before
            else:
                assert out.columns == docs.columns and (after == before if name in ("substring dedup", "secret scans") else after <= before)
                docs = out if after else docs  # a stage that rejects all rows leaves the next one its own input


def test_two_pipelines_in_one_driver(spark):
    """Each thread deletes only what its own pipeline left."""
    import threading

    got: dict[int, int] = {}

    def go(i):
        got[i] = pipeline.run(spark, SF).count()

    threads = [threading.Thread(target=go, args=(i,)) for i in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(got) == 2 and got[0] == got[1] > 0
