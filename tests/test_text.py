"""Text, number and payload functions against hand-made cases."""

import math

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import numbers, payload, text


def values(spark, rows, expression, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_word_count(spark):
    assert values(spark, ["", " a  b ", None, "a\tb\nc"], text.word_count) == [0, 2, 0, 3]


def test_tokens_split_at_accents(spark):
    assert values(spark, ["Été 42-x", ""], text.tokens) == [["t", "42", "x"], []]


def test_clean_profiles(spark):
    raw = "in­ter-\nnational  policy \n\n\n\n next\x00"
    assert values(spark, [raw], text.clean_profile_a) == ["international policy\n\nnext"]
    assert values(spark, ["a-\nb\t c\n \n \n\nd"], text.clean_profile_b) == ["ab c\n\nd"]


def test_join_pages_keeps_numbers(spark):
    assert values(spark, [["one", " ", "three"]], text.join_pages, "array<string>") == ["[Page 1]\none\n\n[Page 3]\nthree"]


def test_slug(spark):
    assert values(spark, ["Opened with 'X', no!", "!!!", "a" * 60], text.slug) == ["opened-with-x-no", "pattern", "a" * 48]


def test_reason_normaliser(spark):
    assert values(spark, ["opened with 'foo', x", "25 words, limit is 20"], text.normalise_reason) == ["opened with 'X', x", "N words, limit is N"]


def test_sentences_and_first_word(spark):
    assert values(spark, ["One. Two! Three"], text.sentences) == [["One.", "Two!", "Three"]]
    assert values(spark, ["Explain, now", ": x"], text.first_word) == ["explain", ""]


def test_rough_tokens(spark):
    assert values(spark, ["the electricity 230 !", ""], text.rough_tokens) == [1 + 3 + 1 + 1, 0]


def test_trim_to_limit_modes(spark):
    got = values(spark, ["a b.", "One two. Three four five.", "one two three, four five"], lambda x: text.trim_to_limit(x, 3))
    assert [(g["text"], g["mode"]) for g in got] == [("a b.", "none"), ("One two.", "sentence"), ("one two three.", "hard")]


def test_truncate_words(spark):
    assert values(spark, ["a b c", "aa bb. cc dd", "a. bb cc, dd"], lambda x: text.truncate_words(x, 3)) == ["a b c", "aa bb.", "a. bb cc."]


def test_template_text_goes_last(spark):
    got = values(spark, ["{{B}}"], lambda x: text.fill_template("{{A}}-{{B}}", {"A": x, "B": F.lit("b")}, last="A"))
    assert got == ["{{B}}-b"]


def test_distinct_ignoring_case(spark):
    assert values(spark, [["Skills", "skills", "VET", "a"]], lambda x: text.distinct_ignoring_case(x, 2), "array<string>") == [["Skills", "VET"]]


def test_terms_and_hyphens(spark):
    assert values(spark, ["a ground-breaking idea", "breaking news"], lambda x: text.contains_term(x, "breaking")) == [False, True]


def test_names_and_cells(spark):
    assert values(spark, ["my_file_1.pdf"], text.title_of_name) == ["my file 1"]
    assert values(spark, ["a|b", None, " "], text.escape_cell) == ["a\\|b", "Not stated", "Not stated"]
    assert values(spark, ["a|b"], lambda x: text.escape_cell(x, "b")) == ["a/b"]


@pytest.mark.parametrize(("written", "number"), [("1 234,5", 1234.5), ("1,234.5", 1234.5), ("12", 12.0), ("1,234", 1.234), ("12%", None), ("", None), ("nan", None), ("1_000", None), ("1 000", 1000.0), (None, None)])
def test_number_parse(spark, written, number):
    assert values(spark, [written], numbers.parse_number) == [number]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(numbers.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(1 / math.sqrt(2)), 0.0, 0.0]


def test_coverage_counts_parts_of_words(spark):
    df = spark.createDataFrame([(["art", "zoo", "art"], "a part"), ([], "x")], "t array<string>, b string")
    assert [r[0] for r in df.select(numbers.coverage(F.col("t"), F.col("b"))).collect()] == [pytest.approx(2 / 3), 0.0]


REPLIES = [
    '{"title": "T", "keywords": "a; b, A"}',
    '<think>{"no": 1}</think>```json\n{"title": "unknown", "summary": ["x", "y"], "keywords": ["k.", "K", " m "]}\n```',
    'Sure: {"title": null, "year": 2020} done',
    "[1, 2]",
    '{"title": ',
    "",
    None,
]


def test_payload_profile_a(spark):
    got = values(spark, REPLIES, lambda x: payload.summary_record(payload.json_object_text(x)))
    assert [(r["title"], r["keywords"]) for r in got[:3]] == [("T", ["a", "b"]), ("Not stated", ["k", "m"]), ("Not stated", [])]
    assert got[1]["summary"] == "x y" and got[2]["year"] == "2020" and got[3:] == [None] * 4


def test_payload_errors(spark):
    got = values(spark, REPLIES, payload.parse_error)
    assert got[:4] == [None] * 4 and got[4] and "empty" in got[5] and "empty" in got[6]


def test_first_small_object(spark):
    got = values(spark, ['x {"tool": "convert"} {"tool": "b"}', "none"], lambda x: payload.first_small_object(x, {"tool": "", "target": "t"}))
    assert (got[0]["tool"], got[0]["target"], got[1]) == ("convert", "t", None)


def test_the_first_distinct_elements_are_found_without_comparing_all(spark):
    rows = [["B", "b", "a", None, "A", "É", "é", "c"], [], None, ["x"] * 9, ["1", "2", "3", "4"]]
    df = spark.createDataFrame([(r,) for r in rows], "x array<string>")
    got = df.select(text.distinct_ignoring_case(F.col("x"), 3))
    assert "array_position" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [r[0] for r in got.collect()] == [["B", "a", "É"], [], None, ["x"], ["1", "2", "3"]]
    assert [r[0] for r in df.select(F.slice(text.distinct_ignoring_case(F.col("x")), 1, 3)).collect()] == [["B", "a", "É"], [], None, ["x"], ["1", "2", "3"]]
