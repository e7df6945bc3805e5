import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from corpusmill.llm import repair

SF = "/root/testdata/sf0.01"
LAWFUL = re.compile(r"(s?(ua)+)?")
#: What a lawful sequence of initials may begin with.
BEGINNING = re.compile(r"(s|s?(ua)*u?)?")


def faults(rows):
    """blank, duplicate, truncated or none of each (role, text), by the definition."""
    out = []
    for i, (role, text) in enumerate(rows):
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not words else "duplicate" if (role, text) in rows[:i] else "truncated" if words[-1] not in ".!?" else "")
    return out


def choices(role, text, fault):
    """(letter, cost, row put out) of every edit of one row."""
    out = [("D", 2, None)]
    if fault not in ("blank", "duplicate"):
        more = 5 * (fault == "truncated")
        out += [("K", more, (role, text))] + [("R", 1 + more, (r, text)) for r in ("user", "assistant")]
    return out


def all_edits(rows):
    """The best by trying every sequence of edits with up to two insertions in a row."""
    inserts = [x for k in range(3) for x in itertools.product(("user", "assistant"), repeat=k)]
    best = None
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        for edits in itertools.product(*(choices(*r, f) for r, f in zip(rows, faults(rows)))):
            audit, cost, out = "", 0, []
            for gap, edit in zip(gaps, (*edits, None)):
                audit, cost = audit + "I" * len(gap), cost + 5 * len(gap)
                out += [(r, "") for r in gap]
                if edit:
                    audit, cost = audit + edit[0], cost + edit[1]
                    out += [edit[2]] if edit[2] else []
            if LAWFUL.fullmatch("".join(r[:1] or "-" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
    return best


def cheapest_first(rows):
    """The best by a search that takes partial repairs in order of cost and letters, whatever states they are in."""
    kinds, heap, done = faults(rows), [(0, "", 0, ())], set()
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        initials = "".join(r[:1] or "-" for r, _ in out)
        state = (i, initials[-1:], "s" in initials)
        if i == len(rows) and LAWFUL.fullmatch(initials):
            return cost, audit, list(out)
        if (state, audit) in done:
            continue
        done.add((state, audit))
        steps = [("I", 5, (r, ""), 0) for r in ("user", "assistant")]
        if i < len(rows):
            steps += [(*c, 1) for c in choices(*rows[i], kinds[i])]
        for letter, price, row, ahead in steps:
            new = (*out, row) if row else out
            if BEGINNING.fullmatch("".join(r[:1] or "-" for r, _ in new)):
                heapq.heappush(heap, (cost + price, audit + letter, i + ahead, new))


def fold(rows, turns=None):
    c = repair.Conversation()
    for i, (role, text) in enumerate(rows):
        c.add(turns[i] if turns else i, role, text, (role, text) in rows[:i])
    return c.result()


def expected(rows, found):
    cost, audit, out = found
    kinds = faults(rows)
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
    counts = [kinds.count(k) for k in ("blank", "duplicate", "truncated")] + [sum(p not in ("su", "ua", "au") for p in pairs)]
    return (*counts, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


ROLES, TEXTS = ["user", "assistant", "system", "tool", "", "admin", "s"], ["a.", "b!", "c", " \n", "d? ", "é.\n"]


def test_all_edits_of_few_rows():
    rng = random.Random(1)
    cases = [[]] + [[(rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(n)] for n in (1,) * 20 + (2,) * 25]
    for rows in cases:
        assert fold(rows)[1:] == expected(rows, all_edits(rows)), rows
        assert cheapest_first(rows) == all_edits(rows)


def test_cheapest_first_of_more_rows():
    rng = random.Random(2)
    for n in range(150):
        roles = ROLES if n % 2 else ["user", "assistant", "system"]
        rows = [(rng.choice(roles), rng.choice(TEXTS) if n % 3 else f"{i}.") for i in range(rng.randrange(3, 9))]
        assert fold(rows)[1:] == expected(rows, cheapest_first(rows)), rows


def damage(table):
    """Rows after damage by conversation, by the definition."""
    out = {}
    for conv_id, turn, role, text in table:
        rows = out.setdefault(conv_id, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for rows in out.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))
    return out


def gaps(turns):
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def check(df, table):
    got, want = {r["conv_id"]: tuple(r)[1:] for r in df.collect()}, damage(table)
    assert set(got) == set(want) and df.count() == len(want)
    for conv_id, rows in want.items():
        plain = [r[1:] for r in rows]
        assert got[conv_id] == (gaps([r[0] for r in rows]), *expected(plain, cheapest_first(plain))), conv_id


def test_query(spark):
    table = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    check(repair.op12_repair(spark, SF), table)


def test_awkward_rows(spark):
    table = [(None, 0, "user", "a."), (None, None, None, None), (1, None, "user", "x."), (1, None, "user", "x."), (1, 3, "assistant", "y."), (1, 3, "assistant", "z."), (1, 9, None, "w."), (2, 5, "user", None), (3, -4, "system", ""), (3, 2**40, "user", "q\r\n")]
    table += [(10 + i, t, r, f"{t}.") for i in range(40) for t, r in enumerate(("user", "assistant"))]  # some lose all rows
    df = spark.createDataFrame([(*r, "x", True) for r in table], "conv_id long, turn long, role string, text string, seen string, gone boolean")
    check(repair.repair_conversations(repair.damaged(df)), table)
    assert repair.repair_conversations(repair.damaged(df.limit(0))).count() == 0
    lost = [c for c, rows in damage(table).items() if not rows]
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair_conversations(repair.damaged(df)).collect()}
    assert all(got[c] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in lost)


def test_undamaged_rows_and_one_exchange(spark):
    df = spark.createDataFrame([("c", 1, "user", "hi."), ("c", 2, "assistant", "yes."), ("d", 1, "user", "alone.")], "conv_id string, turn int, role string, text string")
    out = repair.repair_conversations(df)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in out.collect()} == {"c": (0, "KK"), "d": (2, "D")}


@pytest.mark.parametrize("n", [20_000])
def test_long_conversation(spark, n):
    """Time and memory grow with the rows, not with their square."""
    rng = random.Random(3)
    rows = [(7, i, ("user", "assistant")[i % 2] if rng.random() < 0.9 else "tool", f"{i}.") for i in range(n)]
    got = repair.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 1 and len(got[0]["audit"].replace("I", "")) == n
