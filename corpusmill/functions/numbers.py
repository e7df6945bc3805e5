"""Numeric functions as column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the ranking formulas.
K1, B, RRF = 1.5, 0.75, 60


def parse_number(x: Column) -> Column:
    """A number as people write it: spaces are grouping; with comma and point commas are too; a comma alone is the decimal mark, so that
    1,234 is 1.234. Null for anything else, names of non-numbers and underscores among it."""
    t = F.replace(F.replace(F.trim(x.cast("string")), F.lit("\u00a0"), F.lit("")), F.lit(" "), F.lit(""))
    t = F.when(t.contains(",") & t.contains("."), F.replace(t, F.lit(","), F.lit(""))).otherwise(F.replace(t, F.lit(","), F.lit(".")))
    return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))


def idf(n_documents: Column, frequency: Column) -> Column:
    return F.log(1 + (n_documents - frequency + 0.5) / (frequency + 0.5))


def bm25(tf: Column, length: Column, mean_length: Column, weight: Column, k1: float = K1, b: float = B) -> Column:
    """What a term with idf weight gives to a passage."""
    return weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length))


def reciprocal_rank(rank0: Column, constant: int = RRF) -> Column:
    """From a rank that begins at 0."""
    return 1.0 / (constant + rank0)


def dot(a: Column, b: Column) -> Column:
    """Over the components that both vectors have."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is missing, empty or zero; norms are those of the whole vectors."""
    a, b = (F.coalesce(v, F.array().cast("array<double>")) for v in (a.cast("array<double>"), b.cast("array<double>")))
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def coverage(terms: Column, blob: Column) -> Column:
    """Share of terms (repeats count) that the text contains, inside words too; 0 without terms."""
    found = F.size(F.filter(terms, lambda t: F.contains(blob, t)))
    return F.when(F.size(terms) == 0, F.lit(0.0)).otherwise(found / F.size(terms))


def safe_rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def _halves(x: Column) -> tuple[Column, Column]:
    """A double as the sum of two that have half its digits each."""
    c = x * F.lit(134217729.0)
    high = c - (c - x)
    return high, x - high


def _nearest(x: Column, power: float, even: Column) -> Column:
    """x times a power of ten as the nearest whole number, from the product and its exact error; a tie goes up where even plus the number below is odd."""
    a, b = _halves(x)
    c, d = (F.lit(v) for v in _split(power))
    product = x * F.lit(power)
    error = b * d - (((product - a * c) - b * c) - a * d)
    whole = F.floor(product).cast("double")
    rest = product - whole
    odd = F.pmod(whole + even, F.lit(2.0)) == 1
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & odd)))
    return whole + F.when(up, 1.0).otherwise(0.0)


def round_half_even(x: Column, digits: int = 0) -> Column:
    """A double rounded to digits places (0 to 15), a tie to the even side, by its exact binary value: 2.675 lies under the tie and gives 2.67, where
    its shortest decimal form would give 2.68. Where the scaled value has too many digits for a double, whole and rest are scaled apart and put
    together as decimals."""
    x, power = x.cast("double"), float(10**digits)
    plain = _nearest(x, power, F.lit(0.0)) / F.lit(power)
    below = F.floor(x).cast("double")
    rest = _nearest(x - below, power, below if digits == 0 else F.lit(0.0)).cast("decimal(16,0)") * F.lit(Decimal(1).scaleb(-digits))
    apart = (below.cast("decimal(20,0)") + rest).cast("double")
    rounded = F.when(F.abs(x * F.lit(power)) < F.lit(2.0**52), plain).otherwise(apart)
    signed = F.when((rounded == 0) & (x < 0), F.lit(-0.0)).otherwise(rounded)
    return F.when(F.isnan(x) | (F.abs(x) >= F.lit(2.0**53)), x).otherwise(signed)


def _split(power: float) -> tuple[float, float]:
    c = power * 134217729.0
    high = c - (c - power)
    return high, power - high


def seconds_of_nanoseconds(x: Column) -> Column:
    return round_half_even(x / F.lit(1e9), 2)
