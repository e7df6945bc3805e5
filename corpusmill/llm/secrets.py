"""Secret scans: fixed patterns, and a battery of randomness tests for strings that no pattern knows.

A candidate is a long run of characters that encodings use; inside it the longest runs of either base64 alphabet are tested, outside what the
patterns found, so a name before `=` or the path before a token doesn't hide it. A run's encoding is the smallest alphabet that holds it. Three
statistics say how little it resembles structured text in that encoding: chi-squared uniformity over the alphabet, runs of character classes,
and serial correlation of neighbours. Each gives a p-value under a model of structured text in that encoding; Stouffer's method combines them, and
weights make longer runs count more.

False discoveries are controlled over all runs of a table, by stratum: the encoding and the kinds of characters that a run has. A first pass counts
p-values by stratum. To these a mixture is fitted: random strings of the encoding, whose p-values are known by making some, and structured text of
this corpus, a normal law of z-values. The step-up takes the largest limit at which that null explains no more than RATE of the discoveries. So whether a run is found doesn't
depend on how many other runs its text has, nor on those of other strata. Runs under LEAST_RUN characters say too little and aren't tested.
"""

from __future__ import annotations

import functools
import hashlib
import math
import operator
import re
from bisect import bisect, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import bound_batches, discard, stored, texts_of

#: The patterns that the base spans are defined by, their kinds in order, and the least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
#: Runs that may encode something, and the rate of false discoveries allowed (over a table, or in a text that is scanned on its own).
CANDIDATE, RATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 0.01
#: Runs of one alphabet inside a candidate, with the filling at its end, and the least length of what is tested.
RUNS, LEAST_RUN = (re.compile(r"[A-Za-z0-9+/]{16,}(?:=+\Z)?"), re.compile(r"[A-Za-z0-9_-]{16,}(?:=+\Z)?")), 20


@dataclass(frozen=True)
class Encoding:
    """An alphabet and its structured text: the chance that two characters agree, how often neighbours' classes change, and their mean serial
    correlation. Text of letters changes class more often than random letters do, in all others less."""

    name: str
    alphabet: str
    agree: float = 0.066
    change: float = 0.34
    correlated: float = 0.45
    classes: str = "kinds"

    def places(self) -> dict[str, int]:
        return {c: i for i, c in enumerate(self.alphabet)}


DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
UPPER, SPREAD = LOWER.upper(), 0.25
#: Encodings from the smallest alphabet to the largest; each infers as the first that holds all characters before the filling. The models are
#: rounded from identifiers, paths and numbers in Python source, without separators: about one in a hundred has a p-value under 0.01 to 0.03.
ENCODINGS = (
    Encoding("decimal", DIGITS, 0.25, 0.25, classes="halves"),
    Encoding("hex", DIGITS + LOWER[:6], 0.142, 0.2),
    Encoding("HEX", DIGITS + UPPER[:6], 0.142, 0.2),
    Encoding("letters", LOWER, 0.066, 0.6, classes="vowels"),
    Encoding("LETTERS", UPPER, 0.066, 0.6, classes="vowels"),
    Encoding("base32", UPPER + "234567", 0.08, 0.08),
    Encoding("base36", DIGITS + LOWER, 0.066, 0.13),
    Encoding("BASE36", DIGITS + UPPER, 0.066, 0.13),
    Encoding("base62", DIGITS + UPPER + LOWER),
    Encoding("base64", UPPER + LOWER + DIGITS + "+/", change=0.4),
    Encoding("base64url", UPPER + LOWER + DIGITS + "-_", change=0.4),
)
SETS = [(e, frozenset(e.alphabet), e.places()) for e in ENCODINGS]
VOWELS = frozenset("aeiouyAEIOUY")


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _quantile(p: float) -> float:
    """z with _tail(z) = p, by bisection."""
    lo, hi = -9.0, 9.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _tail(mid) > p else (lo, mid)
    return lo


def _class(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


CLASSES = {"kinds": _class, "halves": lambda c: c >= "5", "vowels": VOWELS.__contains__}


def infer(token: str) -> tuple[Encoding, dict[str, int]] | None:
    """The smallest encoding whose alphabet holds the token, apart from filling at its end."""
    chars = set(token.rstrip("="))
    return next(((e, order) for e, alphabet, order in SETS if chars <= alphabet), None)


def battery(token: str) -> tuple[str, float] | None:
    """(encoding, combined p-value that structured text looks as random as this); None for what is too short or no encoding holds. A word with
    a capital is tested as its small letters."""
    body = token.rstrip("=")
    if body[1:].islower() and body.isalpha():
        body = body.lower()
    if len(body) < 16 or (found := infer(body)) is None:
        return None
    e, order = found
    n, k = len(body), len(order)
    x = sum(c * c for c in Counter(body).values()) * k / n - n
    excess = (n - 1) * max(k * e.agree - 1, 0.5)
    z_uniform = (k - 1 + excess - x) / math.sqrt(2 * (k - 1) + 4 * excess)
    classes = list(map(CLASSES[e.classes], body))
    changes, mean = sum(map(operator.ne, classes, classes[1:])), (n - 1) * e.change
    z_runs = ((mean - changes if e.classes == "vowels" else changes - mean) - 0.5) / math.sqrt(mean * (1 - e.change))
    v = [order[c] for c in body]
    middle = sum(v) / n
    power = sum((a - middle) ** 2 for a in v)
    r = abs(sum((a - middle) * (b - middle) for a, b in zip(v, v[1:])) / power) if power else 1.0
    z_serial = (e.correlated - r) / math.hypot(SPREAD, 1 / math.sqrt(n))
    p = [min(max(_tail(z), 1e-15), 1 - 1e-15) for z in (z_uniform, z_runs, z_serial)]
    return e.name, _tail(sum(map(_quantile, p)) / math.sqrt(3))


def discoveries(tested: list[tuple[int, int, float]], rate: float = RATE) -> list[tuple[int, int]]:
    """Spans kept of (start, end, p) by a weighted step-up: weights in proportion to length, one on average."""
    if not tested:
        return []
    mean = sum(e - s for s, e, _ in tested) / len(tested)
    ranked = sorted((p * mean / (e - s), s, e) for s, e, p in tested)
    last = max((i for i, (q, _, _) in enumerate(ranked, 1) if q <= rate * i / len(ranked)), default=0)
    return [(s, e) for _, s, e in ranked[:last]]


#: Limits that are tried, from the largest, by eighths of powers of ten; the larger p-values that end places before them; and where GRID is cut into
#: places for the fit.
GRID = [10 ** (-i / 8) for i in range(14, 130)]
BULK = (0.84, 0.5, 0.31, 0.16, 0.067, GRID[0])
CUTS = (4, 8, 12, 16, 20, 26, 34, 50)
PLACES = (*BULK, *(GRID[i] for i in CUTS))


def stratum(encoding: str, token: str) -> str:
    """The encoding and the kinds of characters in a run."""
    return encoding + ":" + "".join(map(str, sorted({_class(c) for c in token.rstrip("=")})))


@dataclass(frozen=True)
class Limits:
    """By stratum: the largest weighted p-value that counts as random, and the mean length of runs, by which p-values are weighted."""

    largest: dict[str, float]
    mean: dict[str, float]

    def keeps(self, kind: str, length: int, p: float) -> bool:
        return p * self.mean.get(kind, length) / length <= self.largest.get(kind, RATE)


#: Runs as promised p-values have them that take part in every fit, random strings that are made to see how theirs lie, the difference of
#: log-likelihoods that says nothing, and what is tried: means and deviations of a null's z-values, and shares of random strings.
PRIOR, MADE, ALIKE = 10, 1000, 3.0
MEANS, DEVIATIONS, SHARES = np.linspace(-1, 2, 31), np.linspace(0.3, 1.2, 19), np.concatenate([[0], np.geomspace(1e-4, 0.5, 40), 1 - np.geomspace(0.5, 1e-4, 40)])


@functools.cache
def _laws() -> tuple[np.ndarray, np.ndarray]:
    """(mean, deviation) of every null that is tried, and the shares of PLACES under each."""
    z = np.array([_quantile(p) for p in PLACES])
    laws = np.array([(m, d) for m in MEANS for d in DEVIATIONS])
    above = np.vectorize(_tail)((z - laws[:, :1]) / laws[:, 1:])
    edges = np.hstack([np.ones((len(laws), 1)), above, np.zeros((len(laws), 1))])
    return laws, np.maximum(edges[:, :-1] - edges[:, 1:], 1e-15)


@functools.cache
def places_of_random(encoding: str, length: int) -> tuple[float, ...]:
    """Shares of random strings of an encoding in PLACES."""
    alphabet = next(e.alphabet for e in ENCODINGS if e.name == encoding)
    rng = Random(f"{encoding}:{length}")
    tested = [battery("".join(rng.choices(alphabet, k=length))) for _ in range(MADE)]
    n = Counter(sum(t[1] <= p for p in PLACES) for t in tested if t and t[0] == encoding)
    return tuple((n[i] + 0.2) / (sum(n.values()) + 0.2 * (len(PLACES) + 1)) for i in range(len(PLACES) + 1))


def fit_null(n: np.ndarray, random: tuple[float, ...]) -> tuple[float, float, float]:
    """Mean and deviation of the null's z-values, and how many runs are its own: of the mixtures of a normal law and of random strings that are about
    as likely as the likeliest, the one with the most random strings."""
    laws, shares = _laws()
    standard = shares[np.abs(laws - (0, 1)).sum(1).argmin()]
    nulls = n + PRIOR * standard
    found = []
    for share in SHARES:
        fits = np.log((1 - share) * shares + share * np.array(random)) @ nulls
        found.append((fits[i := int(fits.argmax())], laws[i], share))
    top = max(f for f, _, _ in found)
    _, (mean, deviation), share = [f for f in found if f[0] >= top - ALIKE][-1]
    return float(mean), float(deviation), float((1 - share) * (n.sum() + PRIOR))


def largest_limit(counts: dict[int, int], bulk: list[int], rate: float = RATE, random: tuple[float, ...] | None = None) -> float:
    """The step-up of a stratum: counts of runs by the place in GRID of the least limit that keeps them, and of runs in BULK's places; random: shares
    of random strings in PLACES. The largest limit at which the null fitted to these explains no more than rate of what is kept, or 0."""
    fine = Counter()
    for i, c in counts.items():
        fine[sum(i >= cut for cut in CUTS)] += c
    n = np.array([*bulk, *(fine[i] for i in range(len(CUTS) + 1))], float)
    mean, deviation, nulls = fit_null(n, random or places_of_random("base62", 32))
    nulls = max(nulls - PRIOR, 1.0)
    kept, best = 0, 0.0
    for i in range(len(GRID) - 1, -1, -1):  # from the strictest
        kept += counts.get(i, 0)
        if kept and nulls * _tail((_quantile(GRID[i]) - mean) / deviation) <= rate * kept:
            best = GRID[i]
    return best


def runs_of(token: str) -> list[tuple[int, int]]:
    """The longest runs of each alphabet in a candidate, in order; runs of different alphabets may overlap."""
    return sorted({r.span() for pattern in RUNS for r in pattern.finditer(token) if r.end() - r.start() >= LEAST_RUN})


def apart(tested: list[tuple[int, int, float]], rate: float) -> list[tuple[int, int, float]]:
    """Of overlapping runs those that pass the rate alone before others, then the longest that passes, or the least p where none does."""
    out: list[tuple[int, int, float]] = []
    for s, e, p in sorted(tested, key=lambda x: (x[2] > rate, x[0] - x[1] if x[2] <= rate else x[2], x[0])):
        i = bisect(out, (s, e))
        if (i == 0 or out[i - 1][1] <= s) and (i == len(out) or out[i][0] >= e):
            out.insert(i, (s, e, p))
    return out


def _merged(spans: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches that overlapping spans cover, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def tested_runs(text: str, taken: list[tuple[int, int]], rate: float) -> list[tuple[int, int, float, str]]:
    """(start, end, p, stratum) of the runs of a text outside of what is taken; of overlapping runs one."""
    starts, out = [s for s, _ in taken], []
    for m in CANDIDATE.finditer(text):
        runs, kinds = [], {}
        for a, b in runs_of(m[0]):
            token, start, end = m[0][a:b], m.start() + a, m.start() + b
            i = bisect_right(starts, start)
            if (i and taken[i - 1][1] > start) or (i < len(taken) and starts[i] < end):
                continue
            if found := battery(token):
                runs.append((start, end, found[1]))
                kinds[start, end] = stratum(found[0], token)
        out += [(s, e, p, kinds[s, e]) for s, e, p in (apart(runs, rate) if len(runs) > 1 else runs)]
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return spans


def scan(text: str, rate: float = RATE, limits: Limits | None = None) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of all spans, in order; base spans first found per kind, whatever the battery says. Without limits of a table a
    text is judged on its own, by a step-up over its runs."""
    spans = base_spans(text)
    tested = tested_runs(text, _merged((s, e) for s, _, e in spans), rate)
    if limits is None:
        kept = discoveries([t[:3] for t in tested], rate)
    else:
        kept = [(s, e) for s, e, p, kind in tested if limits.keeps(kind, e - s, p)]
    return sorted(spans + [(s, 3, e) for s, e in kept])


def fit_limits(docs: DataFrame, rate: float = RATE) -> Limits:
    """Limits over all runs of docs(text). What reaches the driver has a fixed size: a few numbers for each stratum and place of GRID."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in texts_of(batch):
                for s, e, p, kind in tested_runs(text, _merged((a, b) for a, _, b in base_spans(text)), rate):
                    found[kind, e - s, round(math.log10(max(p, 1e-300)) * 64)] += 1
            if len(found) > 100_000:
                yield rows(found)
                found.clear()
        yield rows(found)

    def rows(found: Counter) -> pa.RecordBatch:
        kinds, lengths, places, n = zip(*((*k, n) for k, n in found.items())) if found else ((),) * 4
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(lengths, pa.int64()), pa.array(places, pa.int64()), pa.array(n, pa.int64())], names=["kind", "length", "place", "n"])

    bound_batches(docs.sparkSession)
    counted = stored(docs.select("text").mapInArrow(count, "kind string, length long, place long, n long").groupBy("kind", "length", "place").agg(F.sum("n").alias("n")), "runs")
    lengths = {r["kind"]: r["n"] for r in counted.groupBy("kind").agg(F.transform(F.percentile("length", [0.1, 0.3, 0.5, 0.7, 0.9], F.col("n")), lambda x: F.round(x).cast("int")).alias("n")).collect()}
    mean = {r["kind"]: r["m"] for r in counted.groupBy("kind").agg((F.sum(F.col("length") * F.col("n")) / F.sum("n")).alias("m")).collect()}
    weighted = F.pow(F.lit(10.0), F.col("place") / 64) * F.col("m") / F.col("length")
    means = docs.sparkSession.createDataFrame(list(mean.items()), "kind string, m double")
    at = F.least(F.floor(-F.log10(weighted) * 8 + 1e-9), F.lit(129)).cast("int") - 14  # in GRID; before 0 those in BULK
    for i, p in reversed(list(enumerate(BULK))):
        at = F.when(weighted > p, i - len(BULK)).otherwise(at)
    sums = counted.join(F.broadcast(means), "kind").groupBy("kind", at.alias("at")).agg(F.sum("n").alias("n")).collect()
    discard(counted)
    by: dict[str, dict[int, int]] = {}
    for r in sums:
        by.setdefault(r["kind"], {})[r["at"]] = r["n"]
    found = {}
    for k, c in by.items():
        made = [places_of_random(k.partition(":")[0], n) for n in lengths[k]]
        random = tuple(sum(p) / len(made) for p in zip(*made))
        found[k] = largest_limit({i: n for i, n in c.items() if i >= 0}, [c.get(i - len(BULK), 0) for i in range(len(BULK))], rate, random)
    return Limits(found, mean)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, mark: str = "[secret]", rate: float = RATE, limits: Limits | None = None) -> str:
    """text with each stretch of overlapping spans replaced."""
    out, at = [], 0
    for s, _, e in scan(text, rate, limits):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


def scan_documents(docs: DataFrame, rate: float = RATE, limits: Limits | None = None) -> DataFrame:
    """Spans of each whole text, in code points, end exclusive. Null counts as empty: no spans, and the digest is that of the empty string. A
    null doc_id stays null. Limits come from all of docs, or are given; with them rows don't depend on each other, so repeated rows give equal rows
    (and count each in the limits), and an empty table gives none; columns besides doc_id and text are ignored, whatever their names. Time grows with
    a text's length, times the logarithm of its spans."""
    limits = limits or fit_limits(docs, rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in texts_of(batch):
                spans = scan(text, rate, limits)
                count = Counter(k for _, k, _ in spans)
                base = joined([x for x in spans if x[1] < 3])
                rows.append((count[0], count[1], count[2], hashlib.sha256(base.encode()).hexdigest(), joined(spans), count[3]))
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[x.split()[0] for x in RESULT.split(", ")])

    bound_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, RESULT)


def redact_documents(docs: DataFrame, mark: str = "[secret]", rate: float = RATE, limits: Limits | None = None) -> DataFrame:
    """docs with secrets replaced in text, and n_chars (if there) set to the new length; null texts stay null. Limits as in scan_documents()."""
    at, limits = docs.columns.index("text"), limits or fit_limits(docs, rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redact(t, mark, rate, limits) for t in batch.column(at).to_pylist()]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            if "n_chars" in names:
                i = names.index("n_chars")
                batch = batch.set_column(i, batch.schema.field(i), pa.array([n if t is None else len(t) for t, n in zip(texts, batch.column(i).to_pylist())], batch.schema.field(i).type))
            yield batch

    names = docs.columns
    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
