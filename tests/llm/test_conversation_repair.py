"""Conversation repair against a plain dynamic programme over (cost, audit) of each suffix."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest

from retenta.llm import conversation_repair as cr
from retenta.llm.queries import op11_conversation_repair

SF01 = "/root/testdata/sf0.01"
DUE = {"": "user", "s": "user", "u": "assistant", "a": "user"}
LEGAL = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        spaced = lambda x: " " if x is None else x
        h = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        role = "user" if h == 4 else role
        out[conv] += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))

    def ways(i, state):
        fault = faults[i]
        yield "D", 2, state
        if fault not in ("blank", "duplicate"):
            more = 5 * (fault == "truncated")
            if (state, initials[i]) in LEGAL:
                yield "K", more, initials[i]
            yield "R", 1 + more, DUE[state][0]

    table = {}
    for i in range(len(rows), -1, -1):
        for state in ("", "s", "u", "a"):

            def best(state, inserted=0, i=i):
                found = [(0, "")] if i == len(rows) and state in ("", "a") else []
                if i < len(rows):
                    for letter, cost, to in ways(i, state):
                        c, rest = table[i + 1, to]
                        found.append((c + cost, letter + rest))
                if inserted < 2:
                    c, rest = best(DUE[state][0], inserted + 1)
                    found.append((c + 5, "I" + rest))
                return min(found, default=(10**9, ""))

            table[i, state] = best(state)
    cost, audit = table[0, ""]
    repaired, state, i = [], "", 0
    for letter in audit:
        if letter == "I":
            repaired.append((DUE[state], ""))
            state = DUE[state][0]
            continue
        if letter != "D":
            role = DUE[state] if letter == "R" else rows[i][1]
            repaired.append((role, rows[i][2]))
            state = role[0]
        i += 1
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in repaired))
    turns = [r[0] for r in rows if r[0] is not None]
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": faults.count("blank"), "duplicate": faults.count("duplicate"),
        "truncated": faults.count("truncated"), "illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": digest,
    }, repaired


def messy(seed, convs=120):
    rng = random.Random(seed)
    texts = ["", " \t", "yes.", "no", "ok!", "é?", "x\n.", None, "long " * 50 + ".", "why? "]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "ua"]
    rows = []
    for conv in [*range(convs), None]:
        for _ in range(rng.randint(1, 14)):
            turn = rng.choice([None, *range(-2, 12)])
            rows.append((conv, turn, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}."))
    return rows + rows[:40]


def check(rows, frame, monkeypatch=None):
    repaired = cr.repair(cr.damaged(frame)).cache()
    got = {r["conv_id"]: r.asDict() for r in cr.totals(repaired).collect()}
    chunks = defaultdict(list)
    for r in repaired.orderBy("conv_id", "chunk").collect():
        chunks[r["conv_id"]] += [(t["role"], t["text"]) for t in r["turns"]]
    want = damage(rows)
    assert got.keys() == {r[0] for r in rows}
    for conv in got:
        totals, turns = expected(want[conv])
        assert {k: got[conv][k] for k in totals} == totals, conv
        assert chunks[conv] == turns
    repaired.unpersist()


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("rows_at_once", [4096, 3, 1])
def test_repair_equals_plain_programme(spark, monkeypatch, rows_at_once):
    monkeypatch.setattr(cr, "SEGMENT_ROWS", rows_at_once)
    rows = messy(rows_at_once)
    frame = spark.createDataFrame([(*r, "extra", 1) for r in rows], SCHEMA + ", conv string, copies int").repartition(5)
    check(rows, frame)


def test_repair_of_a_hot_conversation_with_long_runs(spark, monkeypatch):
    monkeypatch.setattr(cr, "SEGMENT_ROWS", 64)
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"t{t}.") for t in range(900)]
    rows += [(7, 2000 + t, "user", f"u{t}.") for t in range(700)] + [(7, 5000, "user", "same.")] * 300
    rows += [(c, t, ["user", "assistant"][t % 2], f"{c} {t}.") for c in range(100, 140) for t in range(6)]
    check(rows, spark.createDataFrame(rows, SCHEMA).repartition(4))


def test_repair_of_long_texts_and_text_ids(spark):
    rows = [("a", 0, "user", "x" * 2_000_000 + "."), ("a", 1, "assistant", "y " * 700_000 + "!"), ("b'", 0, "assistant", "z.")]
    check(rows, spark.createDataFrame(rows, "conv_id string, turn long, role string, text string"))


def test_repair_of_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cr.totals(cr.repair(cr.damaged(empty))).count() == 0


def test_query_at_small_scale(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF01}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: r.asDict() for r in op11_conversation_repair(spark, SF01).collect()}
    want = damage(rows)
    assert got.keys() == {r[0] for r in rows}
    for conv in got:
        totals, _ = expected(want[conv])
        assert {k: got[conv][k] for k in totals} == totals


def test_runs_equal_single_steps():
    """Powers and unrolled choices of runs against one row at a time."""
    rng = random.Random(1)
    for _ in range(300):
        runs = [(rng.randrange(12) if (x := rng.random()) < 0.9 else 8, rng.randint(1, 9)) for _ in range(rng.randint(1, 6))]
        rows = [s for s, n in runs for _ in range(n)]

        @lru_cache(None)
        def plain(i, state, inserted=0):
            found = [(0, "")] if i == len(rows) and state in (cr.START, cr.ASSISTANT) else []
            if i < len(rows):
                found += [(plain(i + 1, to)[0] + c, x + plain(i + 1, to)[1]) for x, c, to in cr.edits(rows[i], state)]
            if inserted < 2:
                c, rest = plain(i, cr.DUE[state], inserted + 1)
                found.append((c + 5, "I" + rest))
            return min(found, default=(10**9, ""))

        cost = cr.product(cr.matrix_of(runs), cr.ENDING)
        assert cost.tolist() == [plain(0, s)[0] for s in range(4)]
        after = cr.ENDING
        for s, n in reversed(runs):
            after = cr.advance(s, n, after)
        assert after.tolist() == cost.tolist()
        letters, state = cr.choose(runs, cr.START, cr.ENDING)
        assert letters + cr.closing(state)[0] == plain(0, cr.START)[1]
    assert np.array_equal(cr.power(1, 5), cr.matrix_of([(1, 32)]))
