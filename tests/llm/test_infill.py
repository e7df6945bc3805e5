import hashlib
import random
import re

from corpusmill.llm import infill

SF = "/root/testdata/sf0.001"


def plain(text, doc_id):
    """The definition, unit by unit."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if text == "" or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_against_definition_and_back():
    rng, forms = random.Random(1), set()
    for i in range(3000):
        text = "".join(rng.choice(["a", "Zb", "é", "漢", "\U0001f600", " ", "\n", "\r\n", "<", ">", "<S", "P>", "M", "[", "`", "@", "{", "1", "́"]) for _ in range(rng.randrange(30)))
        made = infill.transform(text, i)
        assert made == plain(text, i)
        assert infill.restore(made[4], made[1]) == text
        forms.add(made[1])
    assert forms == {"plain", "psm", "spm"}
    assert infill.transform("x <M> y", 1)[1] == "plain" and infill.transform("", 1)[:2] == (0, "plain")


def test_units_are_those_of_the_pattern():
    import numpy as np

    every = "".join(map(chr, range(1, 0xD800, 7))) + "".join(chr(c) + "ab" for c in range(0x3A, 0x80))
    bounds = infill.boundaries(np.frombuffer(every.encode("utf-32-le"), np.uint32)).tolist()
    assert [every[a:b] for a, b in zip(bounds, bounds[1:])] == re.findall(r"[A-Za-z]+|[^A-Za-z]", every)


def test_documents(spark, awkward):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(awkward)] + [(None, "null id", "x"), (4, awkward[4], "x")], "doc_id long, text string, output string")
    made = infill.fill_in_middle(df)
    rows = infill.restored(made).collect()
    assert len(rows) == len(awkward) + 2
    for r in rows:
        want = "null id" if r["doc_id"] is None else awkward[r["doc_id"]] or ""
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain(want, r["doc_id"]) and r["text"] == want
    assert infill.fill_in_middle(df.limit(0)).count() == 0


def test_other_plan():
    always = infill.Plan(cut=100, suffix_first=100, seed="other")
    for i in range(50):
        n, form, _, _, out = infill.transform("one two three", i, always)
        assert form == "spm" and infill.restore(out, form) == "one two three" and n == 5


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = infill.op11_infill(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, form, p, m, out = plain(texts[r["doc_id"]], r["doc_id"])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"]) == (n, form, p, m, hashlib.sha256(out.encode()).hexdigest())
        assert r["restored_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
