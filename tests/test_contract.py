"""What the driver relies on: queries, SQL, and that the rest stands without the llm subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from corpusmill import catalogue
from corpusmill.session import TABLES

REPO, SF = Path(__file__).resolve().parent.parent, "/root/testdata/sf0.001"
#: One query of each kind here; the whole list runs against SQL at a larger scale outside the tests.
CHECKED = ["word_stats_by_lang", "bm25_topk", "bm25_gate_status", "word_windows", "even_sample_head", "objective_check_reasons", "summary_problems_profile_b", "dataset_rows", "impact_gate_replay", "first_acceptable_turn", "hybrid_rrf_topk"]


def test_every_sql_has_a_query():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) >= 70


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["qid", "best_score", "coverage", "gate"] and df.count() > 0


def plain(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    con.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in con.description]
    assert sorted(columns) == sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(v) for _, v in sorted(zip(columns, r))) for r in con.fetchall()), key=repr)
    assert mine == theirs


def test_the_rest_stands_alone(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'word_windows' in q and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "r")})
