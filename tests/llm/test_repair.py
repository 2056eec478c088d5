"""Conversation repair against plain Python over whole conversations, whatever the chunk."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from spanlens.llm import repair

CONV = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for i, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if i is None else i}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
            out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def cheapest(rows, faults):
    """(cost, audit, lines) by recursion over rows and the initials so far."""
    n = len(rows)

    @cache
    def go(i, state):
        ways = []
        if i == n and state in ("", "a"):
            ways.append((0, "", ()))
        after = "a" if state == "u" else "u"
        if i < n:
            role, text = rows[i][1:]
            c, a, t = go(i + 1, state)
            ways.append((c + 4, "D" + a, t))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                if (state, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    c, a, t = go(i + 1, role[:1])
                    ways.append((c + more, "K" + a, (f"{role}:{text}",) + t))
                c, a, t = go(i + 1, after)
                name = {"u": "user", "a": "assistant"}[after]
                ways.append((c + more + 3, "R" + a, (f"{name}:{text}",) + t))
        if i == n and state not in ("", "a"):
            c, a, t = go(i, after)
            ways.append((c + 3, "I" + a, (("user:" if after == "u" else "assistant:"),) + t))
        elif i < n:  # at most two inserts in a row can pay
            for first, second in ((after, None), (after, {"u": "a", "a": "u"}[after])):
                add = [first] + ([second] if second else [])
                c, a, t = rest(i, add[-1])
                ways.append((c + 3 * len(add), "I" * len(add) + a, tuple("user:" if x == "u" else "assistant:" for x in add) + t))
        return min(ways)

    @cache
    def rest(i, state):
        """As go, with the next edit not an insert."""
        ways = []
        role, text = rows[i][1:]
        after = "a" if state == "u" else "u"
        c, a, t = go(i + 1, state)
        ways.append((c + 4, "D" + a, t))
        if faults[i] not in ("blank", "duplicate"):
            more = 3 if faults[i] == "truncated" else 0
            if (state, role[:1]) in {("s", "u"), ("u", "a"), ("a", "u")}:
                c, a, t = go(i + 1, role[:1])
                ways.append((c + more, "K" + a, (f"{role}:{text}",) + t))
            c, a, t = go(i + 1, after)
            ways.append((c + more + 3, "R" + a, ((("user:" if after == "u" else "assistant:") + text),) + t))
        return min(ways)

    return go(0, "")


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = damaged([r for r in rows if r[0] == conv])
        faults, seen = [], set()
        for _, role, text in own:
            blank = not re.search(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if blank else "duplicate" if (role, text) in seen else
                          None if re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = cheapest(own, faults) if own else (0, "", ())
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    texts = ["Hello.", "Hello.", "Why?", "no end", "", " \n", None, "Ja!  \n", "Ende\x85", "é.", "a\nb."]
    out = []
    for c in range(160):
        n = draw.choice([1, 2, 3, 5, 8, 13])
        out += [(c, draw.randint(0, 12) if draw.random() < 0.3 else t, draw.choice(["user", "assistant", "system", "tool", "User", None, "s", ""]),
                 draw.choice(texts) if draw.random() < 0.5 else f"text {draw.random()}.") for t in range(n)]
    out += [(None, t, "user", "x.") for t in range(3)] + [(500, None, "user", "a."), (500, None, None, "b."), (501, None, None, None)]
    out += [(600, t, "user", f"{t}.") for t in range(70)] + [(601, t, "tool", "same.") for t in range(50)] + [(602, 3, "user", "same.")] * 20
    out += [(603, t, "system", f"{t}") for t in range(41)] + [(604, t, "assistant" if t % 2 else "user", f"{t}.") for t in range(60)]
    return out


@pytest.mark.parametrize("chunk", [128, 3, 1])
def test_report_equals_brute_force(spark, rows, chunk):
    df = spark.createDataFrame(rows, CONV).repartition(5)
    for c in ("conv", "at", "code", "chunk", "place", "edit", "kind", "copy", "first"):
        df = df.withColumn(c, F.lit("extra"))
    got = sorted(map(tuple, repair.repair_report(df, chunk).collect()), key=repr)
    assert got == brute(rows)


def test_few_shapes():
    seen, new = {repair.END}, [repair.END]
    while new:
        new = [s for v in new for s in {repair.step(v, code)[0] for code in range(16)} - seen]
        seen.update(new)
    assert len(seen) < 40


def test_rerun_equals_costs():
    draw = random.Random(9)
    shapes = {repair.END}
    for _ in range(3):
        shapes |= {repair.step(v, c)[0] for v in shapes for c in range(16)}
    shapes = sorted(map(repair.name_of, shapes))
    for _ in range(300):
        codes = [draw.choice([0, 1, 2, 3, 5, 9, 13, 14]) for _ in range(draw.randint(0, 12))]
        a, b = draw.choice(shapes), draw.choice(shapes)
        assert repair.rerun(codes, a, b, *repair.costs(codes, b)) == repair.costs(codes, a)


def test_chunks_that_do_not_converge(spark):
    """Turns of one role keep two vectors apart for ever; required deletes keep any two apart."""
    rows = [(1, t, "user", f"{t}.") for t in range(301)] + [(2, 0, "system", "s."), *((2, t, "tool", "same.") for t in range(1, 200)), (2, 300, "user", "u.")]
    assert sorted(map(tuple, repair.repair_report(spark.createDataFrame(rows, CONV), 4).collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    assert repair.repair_report(spark.createDataFrame([], CONV)).collect() == []
