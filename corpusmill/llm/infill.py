"""Fill-in-middle: a text is cut into prefix, middle and suffix at places between its units, and put together in another order with marks.

A unit is a run of ASCII letters or one other character. A text becomes an array of its code points; units begin wherever a character and the one
before it aren't both letters. Two numbers from the document's hash pick two of these places, two more pick the form. What is put out holds each
mark once, so text and order come back from it exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from .runtime import bound_batches, texts_of

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Plan:
    """Of a hundred texts so many are cut, and so many of those have the suffix first; the seed begins what is hashed."""

    cut: int = 90
    suffix_first: int = 20
    seed: str = "1"

    def numbers(self, doc_id: int | None) -> list[int]:
        """Four numbers below 2^32; the decimal text of a null id is empty."""
        h = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def boundaries(points: np.ndarray) -> np.ndarray:
    """Where units begin, and the end: one more than there are units."""
    letter = ((points | np.uint32(32)) - np.uint32(97)) < 26
    inside = np.flatnonzero(~(letter[1:] & letter[:-1])) + 1
    return np.concatenate([[0], inside, [len(points)]]) if len(points) else np.zeros(1, np.int64)


def pieces(points: np.ndarray, bounds: np.ndarray, a: int, b: int) -> tuple[str, str, str]:
    """Prefix, middle and suffix, cut at the a-th and b-th boundary, the smaller first."""
    lo, hi = bounds[min(a, b)], bounds[max(a, b)]
    return tuple(x.tobytes().decode("utf-32-le") for x in (points[:lo], points[lo:hi], points[hi:]))


def transform(text: str, doc_id: int | None, plan: Plan = Plan()) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, of the middle, output)."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    bounds = boundaries(points)
    n, (h1, h2, h3, h4) = len(bounds) - 1, plan.numbers(doc_id)
    if not text or h3 % 100 >= plan.cut or any(m in text for m in MARKS):
        return n, PLAIN, None, None, text
    prefix, middle, suffix = pieces(points, bounds, h1 % (n + 1), h2 % (n + 1))
    p, s, m = MARKS
    form = SPM if h4 % 100 < plan.suffix_first else PSM
    out = f"{s}{suffix}{p}{prefix}{m}{middle}" if form == SPM else f"{p}{prefix}{s}{suffix}{m}{middle}"
    return n, form, len(prefix), len(middle), out


def restore(output: str, form: str) -> str:
    """The text that an output was made from. No mark can begin inside another or end in a piece, so each is found where it was put."""
    if form == PLAIN:
        return output
    p, s, m = MARKS
    first, second = (s, p) if form == SPM else (p, s)
    one, _, rest = output.removeprefix(first).partition(second)
    two, _, middle = rest.partition(m)
    prefix, suffix = (two, one) if form == SPM else (one, two)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output of each whole text. Null counts as empty: no units, form plain; plain outputs
    are the text, and their two lengths are null. Rows don't depend on each other: repeated rows give equal rows and rows that share an id are cut
    at places of the same numbers; a null doc_id stays null. An empty table gives none; columns besides doc_id and text are ignored, whatever
    their names. A task holds one Arrow batch, and of one text four bytes a character and eight a unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [transform(t, d, plan) for d, t in zip(batch.column(0).to_pylist(), texts_of(batch))]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    bound_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(made: DataFrame) -> DataFrame:
    """made(form, output, ...) with a column text, rebuilt from these two alone, in place of any that it has; a null output gives null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            texts = [None if o is None else restore(o, f) for o, f in zip(batch.column(at("output")).to_pylist(), batch.column(at("form")).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    made = made.drop("text")
    bound_batches(made.sparkSession)
    return made.mapInArrow(run, StructType([*made.schema.fields, StructField("text", StringType())]))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = restored(fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return back.selectExpr("doc_id", "n", "form", "prefix_chars", "middle_chars", "sha2(output, 256) output_sha256", "sha2(text, 256) restored_sha256")


OP11_SQL = """
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents
), numbers AS (
    SELECT *, len(u) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN [0, 1, 2, 3]] AS x FROM units
), cut AS (
    SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
           CASE WHEN t = '' OR x[3] % 100 >= 90 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN x[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM numbers
), parts AS (
    SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM parts
"""
