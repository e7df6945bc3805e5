"""References against the standard library, and rounding against Python's."""

import random
import struct
from urllib.parse import urldefrag, urljoin

import pyarrow as pa
from pyspark.sql import functions as F

from corpusmill.functions import links, numbers
from corpusmill.operators import evaluation

#: The examples of RFC 3986, section 5.4, but for those that parsers may differ in.
NORMAL = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y",
    "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q", "g#s": "http://a/b/c/g", "g?y#s": "http://a/b/c/g?y", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x",
    "g;x?y#s": "http://a/b/c/g;x?y", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g",
    "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g",
    "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/",
    "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x",
}


def resolve(spark, pairs):
    df = spark.createDataFrame(pairs, "base string, ref string")
    return [r["x"] for r in df.coalesce(1).select(links.resolved(F.col("base"), F.col("ref")).alias("x")).collect()]


def test_examples_of_the_standard(spark):
    assert resolve(spark, [("http://a/b/c/d;p?q", r) for r in NORMAL]) == list(NORMAL.values())


def test_any_depth_against_the_library(spark):
    rng, pairs = random.Random(3), []
    for _ in range(1500):
        base = "https://h.example/" + "".join(rng.choice("abc") + "/" for _ in range(rng.randrange(14))) + rng.choice(["", "p", "p?x=1", "p#f"])
        ref = "".join(rng.choice(["../", "./", "x/", "y.z/", ".../"]) for _ in range(rng.randrange(16))) + rng.choice(["", "..", ".", "end", "end?q=/../a", "end#f"])
        pairs.append((base, ref))
    pairs.append(("https://h.example/" + "d/" * 12 + "p", "../" * 10 + "up"))
    assert resolve(spark, pairs) == [urldefrag(urljoin(b, r)).url for b, r in pairs]


def test_links_of_files(spark):
    deep = "/".join("abcdefghijkl") + "/page.md"
    pages = spark.createDataFrame([(deep, f"[a]({'../' * 10}there.md) [b]({'../' * 11}gone.md) [c]({'../' * 13}top.md#x) [d](./../l/./next.md)")], "path string, text string")
    targets = spark.createDataFrame([("a/b/there.md",), ("top.md",), ("a/b/c/d/e/f/g/h/i/j/k/l/next.md",)], "path string")
    assert sorted(r["link"] for r in evaluation.broken_links(pages, targets).collect()) == sorted(["../" * 11 + "gone.md", "../" * 13 + "top.md#x"])


def test_audit_of_both_directions(spark):
    pages = spark.createDataFrame([(1, "https://h/a/p#top", ["../b/q", "../../../a/p"]), (2, "https://h/b/q", ["r?x#y"]), (3, "https://h/c", [])], "id int, url string, refs array<string>")
    rows = {(r["state"], r["address"]) for r in evaluation.link_audit(pages, "id", "url", "refs").collect()}
    assert rows == {("unlinked", "https://h/c"), ("missing", "https://h/b/r?x")}


def test_a_million_doubles_round_as_python_does(spark):
    rng, values = random.Random(4), [2.675, 0.125, 0.375, -0.125, 1e16, -2.5, 0.5, 1.5, 1e300, 5e-324, -0.001, 0.0, -0.0, 2.5, 1.005, 0.285, 4503599627370497.5, float("inf"), float("-inf")]
    while len(values) < 1_000_000:
        kind = rng.randrange(4)
        cents = rng.randrange(-(10**9), 10**9)
        x = cents / 1000 if kind == 0 else cents / 8 if kind == 1 else struct.unpack("d", rng.randbytes(8))[0] if kind == 2 else rng.uniform(-1e6, 1e6)
        if x == x:
            values.append(x)
    df = spark.createDataFrame(pa.table({"x": values}))
    for digits in (0, 2, 3):
        got = df.select("x", numbers.round_half_even(F.col("x"), digits).alias("r")).toArrow()
        assert [(x, r) for x, r in zip(got["x"].to_pylist(), got["r"].to_pylist()) if (round(x, digits) if abs(x) < 1e300 else x) != r] == []
    assert df.limit(1).select(numbers.round_half_even(F.lit(None).cast("double")).alias("r")).first()["r"] is None
