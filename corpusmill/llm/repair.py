"""Conversation repair: the cheapest edits that give a conversation roles in a lawful order, as a shortest path through composed automata.

Three machines are composed. The input acceptor is the chain of a conversation's rows in order. The edit transducer keeps, reroles or deletes a row
and inserts rows of empty text before it, each at a cost and with one letter of output. The grammar acceptor has the states below and takes the
initials `(s?(ua)+)?`. Arcs of the composition are made when a (grammar state, kind of row) first turns up and remembered; its states are (row,
grammar state) and are visited in topological order, row by row, while rows stream by.

A path's weight is (cost, letters), compared in this order. From a state every letter leads to one place at most, so two paths into a state are never
prefixes of each other and what follows can't change their order: of each state only the best path is kept, with its cost, its rank among the four
by letters, and a running hash of the rows it puts out. More than two insertions in a row come back to a state they passed, at a cost.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import bound_batches

#: Grammar: start, behind a system row, behind a user row, behind an answer; where an initial leads; where a conversation may end.
START, SYSTEM, USER, ANSWER = range(4)
STEP = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ANSWER}, ANSWER: {"u": USER}}
FINAL = (START, ANSWER)
#: The one role that rerole and insert can give in a state, and pairs of initials that may follow each other.
GIVEN = {START: "user", SYSTEM: "user", USER: "assistant", ANSWER: "user"}
LAWFUL = ("su", "ua", "au")
#: Letters and costs of the edits, and what a truncated row costs that stays.
KEEP, REROLE, DELETE, INSERT = "KRDI"
COST, CUT_SHORT, INSERTIONS = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}, 5, 2
#: White space that ends words, and what ends a sentence.
BLANK, ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")


def _insertions(state: int) -> list[tuple[tuple[str, ...], int]]:
    """Roles inserted one after another, and the state that each number of them leads to."""
    out, roles = [((), state)], ()
    for _ in range(INSERTIONS):
        roles += (GIVEN[state],)
        state = STEP[state][GIVEN[state][0]]
        out.append((roles, state))
    return out


@functools.cache
def arcs(state: int, initial: str, must_go: bool, cut_short: bool) -> list[tuple[int, int, str, tuple[str, ...], str | None]]:
    """Arcs of the composition over one row: (state, cost, letters, roles inserted before it, its role: "" its own, None deleted)."""
    out = []
    for roles, at in _insertions(state):
        cost, letters = COST[INSERT] * len(roles), INSERT * len(roles)
        out.append((at, cost + COST[DELETE], letters + DELETE, roles, None))
        if must_go:
            continue
        cost += CUT_SHORT * cut_short
        if initial in STEP[at]:
            out.append((STEP[at][initial], cost + COST[KEEP], letters + KEEP, roles, ""))
        out.append((STEP[at][GIVEN[at][0]], cost + COST[REROLE], letters + REROLE, roles, GIVEN[at]))
    return out


#: All letters of an arc, as one byte of a back pointer holds them besides the state it comes from.
LABELS = [INSERT * k + x for k in range(INSERTIONS + 1) for x in (KEEP, REROLE, DELETE)]
CODE = {x: i << 2 for i, x in enumerate(LABELS)}


@dataclass
class Path:
    """The best path into a grammar state: its cost, its place among those of the four states by letters, and what it puts out."""

    cost: int
    rank: int
    digest: hashlib._Hash
    rows: int = 0

    def extended(self, roles: tuple[str, ...], last: bytes | None) -> tuple[hashlib._Hash, int]:
        parts = [f"{r}:".encode() for r in roles] + ([] if last is None else [last])
        digest = self.digest.copy()
        for i, p in enumerate(parts):
            digest.update(b"\n" + p if i or self.rows else p)
        return digest, self.rows + len(parts)


@dataclass
class Conversation:
    """Rows of one conversation as they come: counts, and the composition up to the last of them. Four bytes a row are kept, and no text."""

    paths: dict[int, Path] = field(default_factory=lambda: {START: Path(0, 0, hashlib.sha256())})
    back: bytearray = field(default_factory=bytearray)
    turns: list[int] = field(default_factory=list)  # least, greatest, how many
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0))
    before: str | None = None

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        if turn is not None:
            least, last, n = self.turns or (turn, turn - 1, 0)
            self.turns = [least, turn, n + (turn != last)]
        words = text.strip(BLANK)
        fault = "blank" if not words else "duplicate" if seen else "truncated" if not words.endswith(ENDS) else ""
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in LAWFUL:
            self.counts["illegal"] += 1
        self.before = initial
        self._step(initial, fault in ("blank", "duplicate"), fault == "truncated", role, text)

    def _step(self, initial: str, must_go: bool, cut_short: bool, role: str, text: str) -> None:
        best: dict[int, tuple] = {}
        for state, path in self.paths.items():
            for to, cost, letters, roles, put in arcs(state, initial, must_go, cut_short):
                key = (path.cost + cost, path.rank, letters)
                if to not in best or key < best[to][0]:
                    best[to] = (key, state, roles, put)
        order, row, paths = sorted(best, key=lambda g: best[g][0][1:]), bytearray(4), {}
        for rank, g in enumerate(order):
            (cost, _, letters), state, roles, put = best[g]
            last = None if put is None else f"{put or role}:{text}".encode()
            paths[g] = Path(cost, rank, *self.paths[state].extended(roles, last))
            row[g] = CODE[letters] | state
        self.paths = paths
        self.back += row

    def result(self) -> tuple:
        """gaps, the counts, cost, audit, digest."""
        ends = [((p.cost + COST[INSERT] * len(roles), p.rank, INSERT * len(roles)), g, roles) for g, p in self.paths.items() for roles, at in _insertions(g) if at in FINAL]
        (cost, _, letters), g, roles = min(ends)
        digest, _ = self.paths[g].extended(roles, None)
        audit = [letters]
        for i in range(len(self.back) - 4, -1, -4):
            audit.append(LABELS[self.back[i + g] >> 2])
            g = self.back[i + g] & 3
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        return (gaps, *self.counts.values(), cost, "".join(reversed(audit)), digest.hexdigest())


def key_of(*columns: str) -> Column:
    """Columns as text joined by colons; a null is one space."""
    return F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in columns))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy and gone of rows(conv_id, turn, role, text): a null role or text is one space, and the hash of (conv_id, turn)
    says whether a row is dropped (it stays, marked gone), loses its text or its ends of sentences, comes twice, or becomes a user's."""
    kind = F.crc32(key_of("conv_id", "turn").cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        (kind == 0).alias("gone"),
    )


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of rows(conv_id, turn, role, text[, copy][, gone]), as damaged() gives them: counts, the cheapest edits' cost and
    letters, and the digest of the repaired rows. Rows marked gone count for nothing but keep their conversation; without a row left all is zero,
    no letter, and the digest of the empty string. Rows come by turn, nulls first; rows that share a turn by role, then text, then copy; a null
    role or text is one space, a null conv_id is a conversation. An empty table gives none; other columns are ignored, whatever their names.

    Rows are shuffled once, by conversation, and sorted, in a task's memory or on its disk, first to see which repeat earlier ones and then for the
    fold; they stream by, so a task keeps four bytes a row of one conversation, and no text. The digest of a conversation takes its rows one after
    another, so one conversation is one task's work, however long."""
    nothing = {"copy": F.lit(0), "gone": F.lit(False)}
    own = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")} | {"turn": F.col("turn").cast("long"), "conv_id": F.col("conv_id")}
    names = ("conv_id", "turn", "role", "text", "copy", "gone")
    rows = rows.select(*((own.get(c, F.col(c)) if c in rows.columns else nothing[c]).alias(c) for c in names))
    dealt = rows.repartition("conv_id")
    order = (F.col("turn").asc_nulls_first(), F.col("copy"))
    earlier = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy(*order)) > 1
    line = dealt.withColumn("seen", earlier).sortWithinPartitions("conv_id", order[0], "role", "text", "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, None
        for batch in batches:
            out = []
            for conv_id, *row, gone, seen in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5, 6))):
                if now is None or conv_id != key:
                    if now is not None:
                        out.append((key, *now.result()))
                    key, now = conv_id, Conversation()
                if not gone:
                    now.add(*row, seen)
            if out:
                yield made(out, batch.schema.field(0).type)
            kind = batch.schema.field(0).type
        if now is not None:
            yield made([(key, *now.result())], kind)

    def made(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = (kind, *[pa.int64()] * 6, pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["conv_id", *(x.split()[0] for x in RESULT.split(", "))])

    bound_batches(rows.sparkSession)
    return line.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {RESULT}")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _arcs_sql() -> str:
    """All arcs as SQL rows, by the initial's effect: the SQL joins them row by row, where the fold takes them from memory."""
    rows = []
    for state in STEP:
        for must_go, cut_short in ((True, False), (False, False), (False, True)):
            for initial in "sua-":
                for to, cost, letters, roles, put in arcs(state, initial, must_go, cut_short):
                    inserted = "".join(f"{r}:\n" for r in roles).replace("\n", "' || chr(10) || '")
                    rows.append(f"({state}, '{initial}', {must_go}, {cut_short}, {to}, {cost}, '{letters}', '{inserted}', {'NULL' if put is None else repr(put)})")
    return ",\n".join(rows)


def _ends_sql() -> str:
    rows = [(g, COST[INSERT] * len(roles), INSERT * len(roles), "".join(f"{r}:\n" for r in roles)) for g in STEP for roles, at in _insertions(g) if at in FINAL]
    return ", ".join("({}, {}, '{}', '{}')".format(g, c, x, t.replace("\n", "' || chr(10) || '")) for g, c, x, t in rows)


OP12_SQL = f"""
WITH RECURSIVE arc(state, initial, must_go, cut_short, goes, cost, letters, inserted, put) AS (VALUES
{_arcs_sql()}
), ends(state, cost, letters, inserted) AS (VALUES {_ends_sql()}), given AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
    FROM conversations
), hashed AS (
    SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, 8 * length(k)), lambda i: (ascii(substr(k, i // 8 + 1, 1)) >> (i % 8)) & 1)),
                              lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295) % 20 AS kind
    FROM given
), rows_after AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
    FROM hashed, (VALUES (0), (1)) AS c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
           trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS words, substr(role, 1, 1) AS initial
    FROM rows_after
), judged AS (
    SELECT *, CASE WHEN words = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN right(words, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
           lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
    FROM placed
), counted AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
           count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM judged GROUP BY conv_id
), walk AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS out FROM counted
    UNION ALL
    SELECT conv_id, i, state, best.cost, best.audit, best.out FROM (
        SELECT w.conv_id, j.i, a.goes AS state,
               arg_min({{'cost': w.cost + a.cost, 'audit': w.audit || a.letters, 'out': w.out || a.inserted || CASE WHEN a.put IS NULL THEN '' ELSE CASE a.put WHEN '' THEN j.role ELSE a.put END || ':' || j.text || chr(10) END}},
                       {{'cost': w.cost + a.cost, 'audit': w.audit || a.letters}}) AS best
        FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1
        JOIN arc a ON a.state = w.state AND a.initial = CASE WHEN j.initial IN ('s', 'u', 'a') THEN j.initial ELSE '-' END
             AND a.must_go = (j.fault IN ('blank', 'duplicate')) AND a.cut_short = (j.fault = 'truncated')
        GROUP BY w.conv_id, j.i, a.goes)
), ended AS (
    SELECT c.conv_id, arg_min({{'cost': w.cost + e.cost, 'audit': w.audit || e.letters, 'out': w.out || e.inserted}}, {{'cost': w.cost + e.cost, 'audit': w.audit || e.letters}}) AS best
    FROM counted c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n JOIN ends e ON e.state = w.state
    GROUP BY c.conv_id
)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit,
       sha256(coalesce(left(best.out, greatest(length(best.out) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM g.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM g.conv_id
"""
