"""Spans, repeated rows, odd characters and lasting pseudonyms; many patterns at once."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators import patterns, privacy, validation


def scrubbed(spark, rows, **k):
    return sorted((r["doc"], r["scrubbed"]) for r in privacy.scrub(spark.createDataFrame(rows, "doc long, text string"), **k).collect())


def test_private_use_characters_stay(spark):
    rows = [(1, "a  keep me  c x@y.org"), (2, "0:0 and "), (3, "a.b@c.org")]
    assert scrubbed(spark, rows) == [(1, "a  keep me  c [EMAIL_1]"), (2, rows[1][1]), (3, "[EMAIL_2]")]


def test_repeated_rows_are_rows_of_their_own(spark):
    rows = [(1, "x@y.org and x@y.org"), (1, "x@y.org and x@y.org"), (1, "z@y.org"), (1, "plain"), (1, None)]
    assert scrubbed(spark, rows) == [(1, ""), (1, "[EMAIL_1] and [EMAIL_1]"), (1, "[EMAIL_1] and [EMAIL_1]"), (1, "[EMAIL_2]"), (1, "plain")]


def test_pseudonyms_last(spark, tmp_path):
    keep = f"file://{tmp_path}/names"
    one = [(1, "b@y.org met @handle_b"), (2, "a@y.org")]
    assert scrubbed(spark, one, keep=keep) == [(1, "[EMAIL_1] met [HANDLE_1]"), (2, "[EMAIL_2]")]
    two = [(0, "new@y.org and a@y.org"), (9, "b@y.org, @other_one"), (10, "none")]
    assert scrubbed(spark, two, keep=keep) == [(0, "[EMAIL_3] and [EMAIL_2]"), (9, "[EMAIL_1], [HANDLE_2]"), (10, "none")]
    assert scrubbed(spark, one, keep=keep) == [(1, "[EMAIL_1] met [HANDLE_1]"), (2, "[EMAIL_2]")]
    kept = {(r["label"], r["value"]): r["number"] for r in privacy.kept_pseudonyms(spark, keep).collect()}
    assert kept == {("EMAIL", "b@y.org"): 1, ("EMAIL", "a@y.org"): 2, ("EMAIL", "new@y.org"): 3, ("HANDLE", "@handle_b"): 1, ("HANDLE", "@other_one"): 2}


def test_numbers_beside_each_other_keep_their_plus_signs(spark):
    """One space between two numbers belongs to neither, so the second one begins with its plus sign, as the reference's rule has it."""
    content = "94.182.225.142 +1 (705) 555-1902 and 4387393285946913 +1 (438) 555-5817"
    want = re.findall(r"(?<![\w.])\+?\d[\d\s().-]{7,}\d(?![\w.])", content)
    assert want[1::2] == ["+1 (705) 555-1902", "+1 (438) 555-5817"]
    assert spark.createDataFrame([(content,)], "t string").select(privacy.hits(F.col("t"), "PHONE")).first()[0] == want
    assert scrubbed(spark, [(1, content)]) == [(1, "[PHONE_1] [PHONE_2] and [PHONE_3] [PHONE_4]")]


def test_dry_run_keeps_nothing(spark, tmp_path):
    keep = f"file://{tmp_path}/names"
    docs = spark.createDataFrame([(1, "b@y.org b@y.org")], "doc long, text string")
    rows = privacy.scrub(docs, keep=keep, dry_run=True).collect()
    assert [(r["doc"], r["original"], r["token"], r["total"]) for r in rows] == [(1, "b@y.org", "[EMAIL_1]", 2)] and not (tmp_path / "names").exists()


def by_turns(content, names):
    """Names replaced one after another, the longest first, as rules would."""
    for name in sorted(set(names), key=lambda n: (-len(n), n)):
        content = re.sub(rf"\b{re.escape(name)}\b", "", content)
    return content


def test_names_in_one_pass():
    rng = random.Random(4)
    parts = ["Bo", "Li", "Ana", "Bo Li", "Ana Bo", "Lopez", "Li.", "é", "Ana-Li"]
    for _ in range(2000):
        content = "".join(rng.choice([*parts, " ", ", ", "x", "-"]) for _ in range(rng.randrange(12)))
        names = sorted(rng.sample(parts, 4), key=lambda n: (-len(n), n))
        found, at, out = patterns.alone(content, names, patterns.automaton(names)), 0, ""
        for start, end, _ in found:
            out, at = out + content[at:start] + "", end
        assert out + content[at:] == by_turns(content, names), (content, names)


def test_names_are_one_replacement(spark):
    found = privacy.find_identifiers(spark.createDataFrame([(1, "Bo Li saw Bo Li and Bo")], "doc long, text string"), ["Bo", "Bo Li"])
    assert sorted((f["rule"], f["pos"], f["original"]) for f in found.first()["finds"]) == [(-2, 0, "Bo Li"), (-1, 0, "Bo")]


def test_holding(spark, monkeypatch):
    monkeypatch.setattr(patterns, "SLICE_CHARS", 6)  # several passes
    docs = spark.createDataFrame([(1, "abcabd"), (2, None), (3, ""), (None, "xabx"), (1, "abcabd"), (4, "été")], "d long, t string")
    needles = spark.createDataFrame([("n1", "ab"), ("n2", "ab"), ("n3", "cab"), ("n4", ""), ("n5", None), ("n6", "té"), ("n7", "abcabd"), ("n8", "zz")], "n string, s string")
    got = {tuple(r) for r in patterns.holding(docs, "d", "t", needles, "n", "s").collect()}
    assert got == {(1, "n1"), (1, "n2"), (1, "n3"), (1, "n7"), (None, "n1"), (None, "n2"), (4, "n6")}
    assert patterns.holding(docs, "d", "t", needles.limit(0), "n", "s").count() == 0


@pytest.mark.parametrize("hyphens", [True, False])
def test_terms_in_one_pass(spark, hyphens):
    """The same as one test a term, for terms that begin with others too."""
    rng = random.Random(5)
    terms = ["very", "very strong", "strong", "in my opinion", "world-class", "world", "(best)", "Great"]
    texts = ["".join(rng.choice([*terms, " ", "-", "s", ". ", "é"]) for _ in range(rng.randrange(14))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    one = text.terms_alone(F.col("t"), terms, hyphens)
    each = text.array_or_empty([F.when(text.contains_term(F.col("t"), t, hyphens), F.lit(t)) for t in terms])
    assert df.where(one != each).count() == 0 and df.where(F.size(each) > 1).count() > 50


def test_checks_look_once(spark):
    df = spark.createDataFrame([("x",)], "t string").select(validation.summary_errors_a(F.col("t")))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 2 < len(validation.BANNED)  # not once a term


def test_rules_behind_the_last_one_asked_for_are_left_out(spark):
    docs = spark.createDataFrame([(1, "Dr Ada Li, b@y.org, +1 (438) 555-5817"), (2, None)], "doc long, text string")
    found = privacy.find_identifiers(docs, last="EMAIL")
    assert "Prof" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [[f["original"] for f in r["finds"]] for r in found.orderBy("doc").collect()] == [["b@y.org"], []]
    assert [len(r["finds"]) for r in privacy.find_identifiers(docs).orderBy("doc").collect()] == [3, 0]
