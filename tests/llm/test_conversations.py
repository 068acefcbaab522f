"""Conversation repair against plain Python, and the persistent strings of edits."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cairnflow.llm import audit, conversations

SCHEMA = "conv_id long, turn long, role string, text string, role_extra string, conv string"


def plain_edits(rows):
    """The cheapest edits by whole strings."""

    def inserted(states):
        moved = True
        while moved:
            moved = False
            for s, (c, a) in list(states.items()):
                new = (c + 3, a + "I")
                if audit.DUE[s] not in states or new < states[audit.DUE[s]]:
                    states[audit.DUE[s]], moved = new, True
        return states

    states = inserted({0: (0, "")})
    for initial, gone, truncated in rows:
        new, extra = {}, 3 * truncated

        def offer(s, *way, new=new):
            new[s] = min(way, new.get(s, way))

        for s, (c, a) in states.items():
            offer(s, c + 4, a + "D")
            if gone:
                continue
            offer(audit.DUE[s], c + 3 + extra, a + "R")
            if initial == "s" and s == 0:
                offer(1, c + extra, a + "K")
            if initial == "ua"[s == 2]:
                offer(audit.DUE[s], c + extra, a + "K")
        states = inserted(new)
    return min(states[s] for s in (0, 3) if s in states)


@pytest.mark.parametrize("modulus", [(1 << 61) - 1, 5, 1])
def test_edits_equal_whole_strings_whatever_the_hash(modulus):
    """With the last modulus all strings collide."""
    r = random.Random(modulus)
    for _ in range(400):
        rows = [(r.choice(["u", "u", "a", "a", "s", "", "x"]), r.random() < 0.15, r.random() < 0.3) for _ in range(r.randrange(14))]
        assert audit.repaired(rows, audit.Trails(modulus)) == plain_edits(rows)


def test_collisions_of_long_strings_are_confirmed_once():
    rows = [(r, False, False) for r in "uau" * 400]
    assert audit.repaired(rows, audit.Trails(1)) == plain_edits(rows)


def plain(rows):
    """conv_id to all result columns, from rows (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fault == 4:
            role = "user"
        mine += [(turn, role, text)] * (fault != 0) * (1 + (fault == 3))
    out = {}
    for conv, mine in convs.items():
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, faults = set(), []
        for _, role, text in mine:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in mine if t is not None]
        cost, edits = plain_edits([(r[:1], f in ("blank", "duplicate"), f == "truncated") for (_, r, _), f in zip(mine, faults)])
        left, state, lines = list(mine), 0, []
        for e in edits:
            row = None if e == "I" else left.pop(0)
            if e == "D":
                continue
            role = row[1] if e == "K" else "assistant" if state == 2 else "user"
            lines.append(f"{role}:{'' if row is None else row[2]}")
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(rows, **limits):
    parts = conversations.repair(rows, **limits).cache()
    hashed = conversations.digests(parts).collect()
    assert len({r.conv for r in hashed}) == len(hashed)
    digests = {r.conv: r.repaired_sha256 for r in hashed}
    return {r.conv: (*(r[c] for c in conversations.COUNTS), r.audit, digests[r.conv]) for r in parts.where("part = 0").collect()}


def sample(seed, convs, most):
    r = random.Random(seed)
    said = ["Hello there.", "What is it?", "no end", "", "  \t", " cut off \n", "Fine!\n", "ends, here. ", "ünï. 漢字?", None]
    rows = []
    for c in [*range(convs), None]:
        for _ in range(r.randrange(1, most)):
            rows.append((c, r.choice([None, *range(12), 40]), r.choice(["user", "assistant", "system", "tool", None, "u", ""]), r.choice(said)))
        rows += r.choices(rows, k=2)
    return rows


@pytest.mark.parametrize("limits", [{}, {"long_rows": 5, "chunk_rows": 1}, {"long_rows": 3, "chunk_rows": 4}, {"long_chars": 20, "chunk_rows": 7}])
def test_conversations_equal_plain_python(spark, limits):
    rows = sample(3, 60, 14)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    assert found(conversations.damage(df), **limits) == plain(rows)


def test_one_conversation_of_a_third_of_all_rows(spark):
    r = random.Random(5)
    rows = [(7, t // 3, r.choice(["user", "assistant"]), r.choice(["One more.", f"Text {t % 500}.", "open"])) for t in range(3000)]
    rows += [(7, 1, "user", "the same again")] * 900 + sample(6, 200, 9)
    df = spark.createDataFrame([(*x, "x", "y") for x in rows], SCHEMA)
    assert found(conversations.damage(df), long_rows=200, chunk_rows=64) == plain(rows)


def test_no_rows_and_dropped_rows(spark):
    assert found(conversations.damage(spark.createDataFrame([], SCHEMA))) == {}
    dropped = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped, 0, "user", "Gone.", "", "")], SCHEMA)
    assert found(conversations.damage(df)) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_rows(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "user", "Cut"), (1, 2, "user", "Cut")], "conv_id long, turn long, role string, text string")
    row = conversations.repair(conversations.normal(df)).first()
    assert [r.role for r in row.rows] in (["user", "assistant"], [])
    assert (row.cost, row.audit) == plain_edits([("a", False, False), ("u", False, True), ("u", True, True)])


def test_texts_may_be_long(spark):
    text = "word " * 400_000 + "end."
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    row = conversations.repair(conversations.normal(df)).select("audit", F.length(F.col("rows")[1]["text"]).alias("n")).first()
    assert (row.audit, row.n) == ("KK", len(text))
