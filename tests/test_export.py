"""One document from many tasks."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import export, sinks


def hidden(folder):
    return [p.name for p in folder.iterdir() if p.name.startswith(".")]


def test_csv_with_one_header(spark, tmp_path):
    path = tmp_path / "index.csv"
    df = spark.range(1000).select("id", F.when(F.col("id") % 7 == 0, F.lit('a "b", é\nc')).alias("t")).repartitionByRange(5, "id").sortWithinPartitions("id")
    export.write_csv(df, str(path))
    raw = path.read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfid,t\r\n") and raw.count(b"id,t") == 1 and hidden(tmp_path) == []
    rows = list(csv.reader(raw.decode("utf-8-sig").splitlines(keepends=True)))
    assert [int(r[0]) for r in rows[1:]] == list(range(1000)) and rows[1][1] == 'a "b", é\nc' and rows[2][1] == ""
    export.write_csv(df.limit(0), str(path), bom=False)
    assert path.read_bytes() == b"id,t\r\n"


def test_json_with_a_head(spark, tmp_path):
    path = tmp_path / "kb.json"
    df = spark.range(300).select("id", F.array(F.lit(0.5)).alias("v"), F.lit(None).cast("string").alias("n")).repartition(4, "id")
    export.write_json(df, f"file://{path}", {"built": "today", "size": 180})
    found = json.loads(path.read_text())
    assert (found["built"], found["size"], sorted(p["id"] for p in found["passages"])) == ("today", 180, list(range(300)))
    assert found["passages"][0]["v"] == [0.5] and found["passages"][0]["n"] is None
    export.write_json(df.limit(0), str(path), {})
    assert json.loads(path.read_text()) == {"passages": []}


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    path = tmp_path / "x.csv"
    export.write_csv(spark.range(3), str(path), bom=False)
    before = path.read_bytes()
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 50, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        export.write_csv(bad, str(path))
    assert path.read_bytes() == before and hidden(tmp_path) == []
    with pytest.raises(Exception, match="x.csv"):
        export.write_csv(spark.range(3), str(path), overwrite=False)
    assert path.read_bytes() == before


def test_the_index_as_one_document(spark, tmp_path):
    rows = [(f"d{i % 3}#{i:03d}", f"d{i % 3}", "t", None, f"text {i}", 2) for i in range(40)]
    passages = spark.createDataFrame(rows, "id string, doc string, title string, section string, text string, words int").repartition(5)
    sinks.write_index_document(passages, str(tmp_path / "kb.json"), "now", "corpus", 180, 40)
    found = json.loads((tmp_path / "kb.json").read_text())
    assert [c["id"] for c in found["chunks"]] == sorted(r[0] for r in rows) and found["target_words"] == 180 and found["embedding_model"] is None
    files = spark.createDataFrame([("a.md", ["x", "y"]), ("b.md", None)], "file string, keywords array<string>")
    sinks.write_index_file(files, str(tmp_path / "index.csv"))
    assert (tmp_path / "index.csv").read_text(encoding="utf-8-sig").splitlines() == ["file,keywords", "a.md,x; y", "b.md,"]
