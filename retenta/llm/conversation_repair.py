"""Conversation structure repair by a run-length dynamic programme.

A repaired conversation's role initials read ``(s?(ua)+)?``. Rows may be kept (cost 0), given
the role that is due (1), or deleted (2; a blank row and a repeated one always are); an
empty-text row of the role that is due may be inserted anywhere (5); a truncated row that
is not deleted adds 5. What one row does to the cost of each of four states (nothing yet,
after system, after user, after assistant) is a 4 x 4 min-plus matrix that depends on its
role initial and fault only. Equal consecutive symbols are one run; a run of n rows is the
n-th power of its matrix, made of cached binary powers. The choices are unrolled from the
same powers by halves: of all cheapest edits those whose initials are ASCII-least.

A conversation may hold a third of all rows, so nothing gathers one whole. Rows are merged
where they are equal, sorted over range partitions by conversation and turn, and cut into
segments of at most SEGMENT_ROWS rows and about SEGMENT_BYTES. Each segment's matrix is
made on its own; a pass over the matrices alone, last segment first, gives what follows
each segment costs; a pass over the segments in order carries the state, unrolls the
choices and hashes the repaired rows. Both hold one segment at a time.

Cases: a null role or text counts as one space; a null turn comes first and has no part in
``gaps``; rows of one turn are ordered by role, then text; rows equal in all four columns
are copies, of which all but the first are duplicates; null conversation ids are one
conversation; roles other than system, user and assistant go by their first letter; one
without rows left has zeros and an empty audit; an empty table gives an empty table;
``gaps`` beyond the range of a long is its end; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retenta.llm.staging import attach, staged

# The costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
INITIALS = "sua"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"

SEGMENT_ROWS = 4096
SEGMENT_BYTES = 4 << 20
#: rows and bytes that go to Spark at once
OUT_ROWS = 2000

START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60
#: state after a kept row: by state, then by place of its initial in INITIALS or 3 for others
KEPT = [[SYSTEM, USER, None, None], [None, USER, None, None], [None, None, ASSISTANT, None], [None, USER, None, None]]
#: state after the role that is due
DUE = [USER, USER, ASSISTANT, USER]
ROLE = {USER: "user", ASSISTANT: "assistant"}

# A symbol is 4 * fault + place of the initial; faults: none, truncated, to be deleted.
SOUND, CUT, GONE = 0, 4, 8


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product of a matrix with a matrix or a vector."""
    if b.ndim == 1:
        return np.minimum((a + b[None, :]).min(axis=1), FAR)
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


def _inserting() -> np.ndarray:
    """Costs of reaching a state from another by inserted rows alone."""
    step = np.full((4, 4), FAR)
    for s in range(4):
        step[s, s], step[s, DUE[s]] = 0, INSERT
    return product(step, step)


INSERTING = _inserting()
#: cost from each state at the end of a conversation
ENDING = product(INSERTING, np.array([0, FAR, FAR, 0]))


def edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what may be done to a row, in letter order."""
    if symbol >= GONE:
        return [("D", DELETE, state)]
    more, kept = TRUNCATED * (symbol // 4), KEPT[state][symbol % 4]
    return [("D", DELETE, state), *([("K", more, kept)] if kept is not None else []), ("R", REROLE + more, DUE[state])]


@lru_cache(maxsize=None)
def power(symbol: int, k: int) -> np.ndarray:
    """The matrix of 2^k equal rows, inserted rows before each of them included."""
    if k:
        return product(power(symbol, k - 1), power(symbol, k - 1))
    step = np.full((4, 4), FAR)
    for s in range(4):
        for _, cost, to in edits(symbol, s):
            step[s, to] = min(step[s, to], cost)
    return product(INSERTING, step)


def powers_of(n: int) -> list[int]:
    return [k for k in range(n.bit_length()) if n >> k & 1]


def advance(symbol: int, n: int, after: np.ndarray) -> np.ndarray:
    """Costs before a run of ``n`` equal rows, from those after it."""
    for k in powers_of(n):
        after = product(power(symbol, k), after)
    return after


def matrix_of(runs: list[tuple[int, int]]) -> np.ndarray:
    out = np.where(np.eye(4, dtype=bool), 0, FAR)
    for symbol, n in runs:
        for k in powers_of(n):
            out = product(out, power(symbol, k))
    return out


@lru_cache(maxsize=4096)
def _unrolled(symbol: int, k: int, state: int, after: tuple[int, ...]) -> tuple[str, int]:
    """ASCII-least cheapest edits of 2^k equal rows, and the state after them."""
    costs = np.array(after)
    if k:
        half = product(power(symbol, k - 1), costs)
        first, state = _unrolled(symbol, k - 1, state, _level(half))
        second, state = _unrolled(symbol, k - 1, state, after)
        return first + second, state
    best, letters = product(power(symbol, 0), costs), ""
    while True:
        ways = [(x, cost + costs[to], to) for x, cost, to in edits(symbol, state)] + [("I", INSERT + best[DUE[state]], DUE[state])]
        letter, to = min((x, to) for x, cost, to in ways if cost == best[state])
        letters, state = letters + letter, to
        if letter != "I":
            return letters, state


def _level(costs: np.ndarray) -> tuple[int, ...]:
    """Costs less the least of them: choices depend on differences only."""
    return tuple((costs - costs.min()).tolist())


def choose(runs: list[tuple[int, int]], state: int, after: np.ndarray) -> tuple[str, int]:
    """The edits of a segment's runs from ``state``, with ``after`` the costs behind it."""
    behind = []
    for symbol, n in reversed(runs):
        for k in powers_of(n):
            behind.append((symbol, k, _level(after)))
            after = product(power(symbol, k), after)
    parts = []
    for symbol, k, costs in reversed(behind):
        letters, state = _unrolled(symbol, k, state, costs)
        parts.append(letters)
    return "".join(parts), state


def closing(state: int) -> tuple[str, int]:
    """Rows inserted at the end of a conversation."""
    out = ""
    while ENDING[state]:
        out, state = out + "I", DUE[state]
    return out, state


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): rows damaged by crc32(``conv:turn``) % 20. Of a
    dropped row only its conversation is left, with 0 copies."""
    spaced = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    how = F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn))) % 20
    kept = how != 0
    body = F.when(how == 1, "").when(how == 2, F.regexp_replace(spaced(text), "[.!?]", "")).otherwise(spaced(text))
    return rows.select(
        F.col(f"`{conv}`").alias("conv"),
        F.when(kept, F.col(f"`{turn}`").cast("long")).alias("turn"),
        F.when(kept, F.when(how == 4, "user").otherwise(spaced(role))).otherwise("").alias("role"),
        F.when(kept, body).otherwise("").alias("text"),
        F.when(~kept, 0).when(how == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def undamaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The same columns of rows that are to be repaired as they are."""
    spaced = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), F.lit(1).cast("long").alias("copies"))


def _faults(rows: DataFrame) -> DataFrame:
    """Equal rows merged, each with ``blank``, ``truncated`` and ``fresh`` (its role and text
    come first in this turn of the conversation)."""
    merged = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    bare = F.rtrim("text", F.lit(BLANKS))
    # lengths first, so that no two triples are written alike
    key = F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.length(F.col("conv").cast("string")), F.lit(-1)), F.length("role"), F.coalesce(F.col("conv").cast("string"), F.lit("")), "role", "text"), 256))
    merged = merged.withColumns({"key": key, "blank": bare == "", "truncated": ~F.substring(bare, -1, 1).isin(".", "!", "?")})
    first = merged.filter("copies > 0 AND NOT blank").groupBy("key").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "first")
    out = attach(merged, first, "key", F.struct("turn"))
    return out.withColumn("fresh", F.col("first").isNull() | F.struct("turn").eqNullSafe(F.col("first"))).drop("key", "first")


class _Segment:
    """What is gathered of one segment."""

    def __init__(self, conv: object, number: int):
        self.conv, self.number, self.rows, self.bytes = conv, number, 0, 0
        self.runs: list[int] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.counts = [0, 0, 0, 0]  # blank, duplicate, truncated, illegal
        self.initials: list[int] = []  # of the first and the last row
        self.turns = [None, None, 0]  # first and last that are not null, distinct ones

    def add(self, symbol: int, n: int) -> None:
        if n and self.runs and self.runs[-2] == symbol:
            self.runs[-1] += n
        elif n:
            self.runs += [symbol, n]

    def row(self, turn: int | None, role: str, text: str, n: int, blank: bool, truncated: bool, fresh: bool) -> None:
        place = INITIALS.find(role[:1]) if role else 3
        place = 3 if place < 0 else place
        if self.initials:
            self.counts[3] += not legal(self.initials[1], place)
        self.counts[3] += (n - 1) * (not legal(place, place))
        self.initials = [self.initials[0] if self.initials else place, place]
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]
        once = 1 if fresh and not blank else 0
        self.counts[0] += n * blank
        self.counts[1] += 0 if blank else n - once
        if once:
            self.counts[2] += truncated
            self.add((CUT if truncated else SOUND) + place, 1)
            self.roles.append(role)
            self.texts.append(text)
            self.bytes += len(role) + len(text)
        self.add(GONE, n - once)
        self.rows += n

    def record(self) -> dict:
        pairs = list(zip(self.runs[::2], self.runs[1::2]))
        return {
            "conv": self.conv, "seg": self.number, "runs": self.runs, "roles": self.roles, "texts": self.texts,
            "counts": self.counts, "initials": self.initials, "turns": self.turns, "matrix": matrix_of(pairs).ravel().tolist(),
        }


def legal(a: int, b: int) -> bool:
    """Whether a row of the second initial may follow one of the first: su, ua, au."""
    return (a, b) in ((0, 1), (1, 2), (2, 1))


def _table(records: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in records], f.type) for f in schema], schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        names = batch.schema.names
        for values in zip(*columns):
            yield dict(zip(names, values))


def segments(faulty: DataFrame) -> DataFrame:
    """One row a segment, numbered in the order of conversation and turn."""
    order = ["conv", "turn", "role", F.substring("text", 1, 64)]
    rows = faulty.repartitionByRange(*[F.col(x) if isinstance(x, str) else x for x in order]).sortWithinPartitions("conv", "turn", "role", "text")
    longs = T.ArrayType(T.LongType())
    strings = T.ArrayType(T.StringType())
    schema = T.StructType([T.StructField("conv", faulty.schema["conv"].dataType), T.StructField("seg", T.LongType()), T.StructField("runs", longs), T.StructField("roles", strings), T.StructField("texts", strings), T.StructField("counts", longs), T.StructField("initials", longs), T.StructField("turns", longs), T.StructField("matrix", longs)])
    arrow = _arrow(schema)
    names = ["conv", "turn", "role", "text", "copies", "blank", "truncated", "fresh"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        at: _Segment | None = None
        done: list[dict] = []
        size = 0
        for batch in batches:
            for conv, turn, role, text, n, blank, truncated, fresh in zip(*[batch.column(c).to_pylist() for c in names]):
                if at is None or conv != at.conv:
                    if at is not None:
                        done.append(at.record())
                        size += at.bytes
                    number += 1
                    at = _Segment(conv, number)
                while n > 0:  # copies may fill several segments
                    if at.rows >= SEGMENT_ROWS or at.bytes >= SEGMENT_BYTES:
                        done.append(at.record())
                        size += at.bytes
                        number += 1
                        at = _Segment(conv, number)
                    some = min(n, SEGMENT_ROWS - at.rows)
                    at.row(turn, role, text, some, blank, truncated, fresh)
                    n, fresh = n - some, False
                if len(done) >= OUT_ROWS or size >= SEGMENT_BYTES:
                    yield _table(done, arrow)
                    done, size = [], 0
        if at is not None:
            done.append(at.record())
        if done:
            yield _table(done, arrow)

    return rows.select(*names).mapInArrow(run, schema)


def _behind(cut: DataFrame) -> DataFrame:
    """(conv, seg, after): the costs behind each segment, from a pass over the matrices."""
    schema = T.StructType([cut.schema["conv"], cut.schema["seg"], T.StructField("after", T.ArrayType(T.LongType()))])
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, costs = object(), ENDING
        for batch in batches:
            done = []
            for row in _rows_of([batch]):
                if row["conv"] != at:
                    at, costs = row["conv"], ENDING
                done.append({"conv": at, "seg": row["seg"], "after": list(_level(costs))})
                costs = product(np.array(row["matrix"]).reshape(4, 4), costs)
            yield _table(done, arrow)

    return cut.select("conv", "seg", "matrix").repartition("conv").sortWithinPartitions("conv", F.desc("seg")).mapInArrow(run, schema)


class _Conversation:
    """What is carried from segment to segment of one conversation."""

    def __init__(self, conv: object):
        self.conv, self.state, self.cost, self.chunk = conv, START, 0, 0
        self.hash, self.bare, self.audit = hashlib.sha256(), True, []
        self.counts, self.last = [0, 0, 0, 0], None
        self.turns = [None, None, 0]

    def turn(self, letter: str, role: str, text: str, out: list[dict]) -> None:
        self.hash.update(f"{'' if self.bare else chr(10)}{role}:{text}".encode())
        self.bare = False
        out.append({"edit": letter, "role": role, "text": text})

    def apply(self, letters: str, state: int, symbols: list[int], rows: Iterator[tuple[str, str]]) -> list[dict]:
        """Carry out the edits from ``state``; symbols are a row's each."""
        out: list[dict] = []
        at = iter(symbols)
        for letter in letters:
            if letter == "I":
                state = DUE[state]
                self.turn("I", ROLE[state], "", out)
                self.cost += INSERT
                continue
            symbol = next(at)
            if symbol >= GONE:
                self.cost += DELETE
                continue
            role, text = next(rows)
            cost, state = next((cost, to) for x, cost, to in edits(symbol, state) if x == letter)
            self.cost += cost
            if letter != "D":
                self.turn(letter, ROLE[state] if letter == "R" else role, text, out)
        self.state = state
        return out

    def segment(self, row: dict, after: list[int]) -> dict:
        runs = list(zip(row["runs"][::2], row["runs"][1::2]))
        letters, _ = choose(runs, self.state, np.array(after))
        symbols = [s for s, n in runs for _ in range(n)]
        turns = self.apply(letters, self.state, symbols, zip(row["roles"], row["texts"]))
        self.audit.append(letters)
        self.counts = [a + b for a, b in zip(self.counts, row["counts"])]
        if row["initials"]:
            self.counts[3] += self.last is not None and not legal(self.last, row["initials"][0])
            self.last = row["initials"][1]
        first, last, distinct = row["turns"]
        if distinct:
            self.turns = [first if self.turns[0] is None else self.turns[0], last, self.turns[2] + distinct - (self.turns[1] == first)]
        self.chunk += 1
        return {"conv": self.conv, "chunk": self.chunk, "turns": turns, "last": False}

    def end(self, chunk: dict) -> dict:
        letters, _ = closing(self.state)
        chunk["turns"] = chunk["turns"] + self.apply(letters, self.state, [], iter(()))
        self.audit.append(letters)
        first, last, distinct = self.turns
        totals = dict(zip(("blank", "duplicate", "truncated", "illegal"), self.counts))
        gaps = min(last - first + 1 - distinct, (1 << 63) - 1) if distinct else 0
        return chunk | totals | {"last": True, "gaps": gaps, "cost": self.cost, "audit": "".join(self.audit), "sha256": self.hash.hexdigest()}


def repair(rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Repaired conversations of ``damaged`` or ``undamaged`` rows, a row for each segment in
    order of ``chunk``: ``turns``, the repaired rows as (edit, role, text). The row where
    ``last`` holds has the conversation's gaps, blank, duplicate, truncated, illegal, cost,
    audit and sha256 of ``role:text`` of all repaired rows, joined by newlines."""
    cut = staged(segments(_faults(rows)), "conversation-segments")
    light = [c for c in cut.columns if c not in ("conv", "seg", "matrix")]
    facts = _behind(cut).select("conv", "seg", *[F.lit(None).cast(cut.schema[c].dataType).alias(c) for c in light], "after")
    both = facts.unionByName(cut.select("conv", "seg", *light, F.lit(None).cast("array<long>").alias("after")))
    turn = T.StructType([T.StructField(c, T.StringType()) for c in ("edit", "role", "text")])
    long = lambda c: T.StructField(c, T.LongType())
    schema = T.StructType([cut.schema["conv"], long("chunk"), T.StructField("turns", T.ArrayType(turn)), T.StructField("last", T.BooleanType()), *map(long, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), T.StructField("audit", T.StringType()), T.StructField("sha256", T.StringType())])
    arrow, names = _arrow(schema), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: _Conversation | None = None
        held: dict | None = None  # the last chunk made, which may be its conversation's end
        after: list[int] = []
        done: list[dict] = []
        size = 0
        for row in _rows_of(batches):
            if row["after"] is not None:  # comes before its segment
                after = row["after"]
                continue
            if at is not None and row["conv"] != at.conv:
                done.append(at.end(held))
                at = None
            elif held is not None:
                done.append(held)
            at = at or _Conversation(row["conv"])
            held = at.segment(row, after)
            size += sum(map(len, row["texts"]))
            if len(done) >= OUT_ROWS or size >= SEGMENT_BYTES:
                yield _table([{c: r.get(c) for c in names} for r in done], arrow)
                done, size = [], 0
        if at is not None:
            done.append(at.end(held))
        if done:
            yield _table([{c: r.get(c) for c in names} for r in done], arrow)

    ordered = both.repartition("conv").sortWithinPartitions("conv", "seg", F.col("after").isNull())
    return ordered.mapInArrow(run, schema).withColumnRenamed("conv", conv_col)


def totals(repaired: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row a conversation, of what ``repair`` returns."""
    columns: list[Column] = [F.col(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")]
    return repaired.filter("last").select(F.col(f"`{conv_col}`"), *columns, F.col("sha256").alias("repaired_sha256"))
