"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be joined by a merge, so
between its two bytes every encoding has a token boundary: a certain cut. Besides, the
vocabulary's pre-tokenizer starts a new piece at fixed places of the text, which no token
crosses either. A text is first cut before the spaces, where both hold, into
stretches; a stretch's pieces are cut at all their other forced boundaries; the fragments
are encoded independently, and their ids are concatenated in order. Other cuts are looked
for within pieces only, since how a text falls into pieces may depend on what stands
before. Stretches and pieces are remembered, so that one is merged once for many places.

Cases: a null text counts as empty and has no ids; a special token's string in a text is
one id; a fragment of any length is merged with a queue in n log n steps; repeated rows
are encoded row by row; an empty table gives an empty table; other columns are dropped
unless named in ``keep``.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retenta.llm.staging import text_of

# Fixed value: the byte-level pre-tokenizer's pattern.
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")

STRETCHES = re.compile(" *[^ ]+| +")

#: bytes of stretches and pieces that a worker remembers in one generation
REMEMBERED = 96 << 20
#: what an entry takes besides its letters and ids
ENTRY = 250
#: letters from which a stretch or piece is not remembered
UNCOMMON = 200
ROWS_AT_ONCE = 256

#: bytes from which a piece is merged alone, with a queue
LONG = 400
NO_MERGE = np.int64(1) << 62


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes
    stand for themselves, the others follow from code point 256 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Remembered:
    """Ids by text in two generations. What is asked for moves to the young one; when that
    is full it becomes the old one, and what the old one held unasked is forgotten."""

    def __init__(self, size: int = REMEMBERED):
        self.size, self.young, self.old, self.held = size, {}, {}, 0
        self.passing: list[str] = []

    def lacking(self, asked: set[str]) -> set[str]:
        """Which of ``asked`` aren't known; the others are in ``young`` from now on."""
        lacking = asked.difference(self.young)
        if lacking and self.old and (again := lacking.intersection(self.old)):
            self.add({x: self.old[x] for x in again})
            lacking -= again
        return lacking

    def add(self, found: dict[str, bytes]) -> None:
        self.young.update(found)
        self.held += sum(map(len, found)) + sum(map(len, found.values())) + ENTRY * len(found)
        self.passing += [x for x in found if len(x) >= UNCOMMON]

    def settle(self) -> None:
        """Once a batch is done: long texts go, and a full generation becomes the old one."""
        for x in self.passing:
            if (ids := self.young.pop(x, None)) is not None:
                self.held -= len(x) + len(ids) + ENTRY
        self.passing = []
        if self.held > self.size:
            self.young, self.old, self.held = {}, self.young, 0


class Vocabulary:
    """Token ids, merge ranks and forced boundaries of a byte-level BPE file."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        letters = byte_letters()
        spell = lambda token: bytes(letters[x] for x in token)
        ids = {spell(token): i for token, i in spec["model"]["vocab"].items()}
        self.byte_ids = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (spell(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges[ids[left], ids[right]] = (rank, ids[left + right])
        found = sorted(((a << 32) | b, rank, new) for (a, b), (rank, new) in self.merges.items())
        self.pair_keys, self.pair_ranks, self.pair_new = (np.array(x, np.int64) for x in zip(*found))
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.special_ids = {x: np.array([i], "<u4").tobytes() for x, i in self.special.items()}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

        spelled = {i: token for token, i in ids.items()} | {i: token.encode() for token, i in self.special.items()}
        ordered = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.spelling = np.frombuffer(b"".join(ordered), np.uint8)
        self.lengths = np.array([len(x) for x in ordered], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

        inside = np.zeros((256, 256), bool)
        for token in ids:
            codes = np.frombuffer(token, np.uint8)
            inside[codes[:-1], codes[1:]] = True
        self.forced = ~inside
        #: a space after one of these bytes may lie within a token
        self.before_space = [bytes([b]) for b in range(256) if b != 32 and not self.forced[b, 32]]
        self.known = Remembered()

    def stretches_of(self, text: str) -> list[str]:
        """The text cut before each space that follows another character.

        Those cuts are forced boundaries (others are closed again), and the pre-tokenizer
        always starts a piece there, whatever stands around them: the stretches are
        encoded independently.
        """
        parts = STRETCHES.findall(text)
        spelled = text.encode() if self.before_space else b""
        if any(b + b" " in spelled for b in self.before_space):
            open_ends = {c for c in {x[-1] for x in parts} if c.encode()[-1:] in self.before_space}
            closed, still = [], False
            for x in parts:
                if still:
                    closed[-1] += x
                else:
                    closed.append(x)
                still = x[-1] in open_ends
            return closed
        return parts

    def split_special(self, text: str) -> list[str]:
        return self.special_pattern.split(text) if any(x in text for x in self.special) else [text]

    def merged(self, fragment: bytes) -> list[int]:
        """A fragment's ids: again and again the pair of lowest rank, the leftmost of
        several, becomes one token."""
        ids = self.byte_ids[np.frombuffer(fragment, np.uint8)].tolist()
        n, merges = len(ids), self.merges
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        queue = [(found[0], i, found[1]) for i in range(n - 1) if (found := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            rank, i, new = heapq.heappop(queue)
            j = after[i] if alive[i] else -1
            if j < 0 or merges.get((ids[i], ids[j])) != (rank, new):
                continue  # one of the two has changed meanwhile
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else -1
                if b >= 0 and (found := merges.get((ids[a], ids[b]))):
                    heapq.heappush(queue, (found[0], a, found[1]))
        return [x for x, still in zip(ids, alive) if still]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where each pair stands among the merges by key, and its rank or NO_MERGE."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NO_MERGE)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece: cut at the forced boundaries, all fragments merged side by
        side, one merge a fragment and step."""
        sizes = np.array([len(x) for x in pieces])
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        out = self.byte_ids[flat]
        starts = np.cumsum(sizes) - sizes
        joined = ~self.forced[flat[:-1], flat[1:]]
        joined[starts[1:] - 1] = False  # forced boundaries and the ends of pieces
        at = np.arange(len(flat))
        fragment = np.zeros(len(flat), np.int64)
        np.cumsum(~joined, out=fragment[1:])
        ids, rank = out.copy(), np.full(len(flat), NO_MERGE)
        rank[:-1][joined] = self._ranks(ids[:-1][joined], ids[1:][joined])
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], fragment[1:] != fragment[:-1]]))
            best = np.minimum.reduceat(np.where(rank < NO_MERGE, (rank << 32) | np.arange(len(ids)), NO_MERGE), first)
            goes_on = best < NO_MERGE
            here = best[goes_on] & 0xFFFFFFFF
            new = self.pair_new[np.searchsorted(self.pair_keys, (ids[here] << 32) | ids[here + 1])]
            out[at[here]], out[at[here + 1]], ids[here] = new, -1, new
            keep = np.repeat(goes_on, np.diff(np.append(first, len(ids))))
            keep[here + 1] = False
            moved = np.cumsum(keep) - 1
            ids, at, fragment, rank, here = ids[keep], at[keep], fragment[keep], rank[keep], moved[here]
            for i in (here, here[here > 0] - 1):
                i = i[(i + 1 < len(ids))]
                same = fragment[i] == fragment[i + 1]
                rank[i[~same]] = NO_MERGE
                rank[i[same]] = self._ranks(ids[i[same]], ids[i[same] + 1])
            if len(ids):
                rank[-1] = NO_MERGE
        kept = out >= 0
        counts = np.add.reduceat(kept, starts, dtype=np.int64)
        blob, ends = out[kept].astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
        return [blob[a:b] for a, b in zip([0, *ends], ends)]

    def pieces_of(self, stretches: list[str]) -> tuple[list[str], list[int]]:
        """The pieces of all stretches in order, and where each stretch's end among them.

        Stretches that start with a space and end otherwise are split in one string: a piece
        starts at each of those spaces, as it does in a text.
        """
        pieces = PIECES.findall("".join(stretches))
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        return pieces, (np.searchsorted(ends, np.cumsum(np.fromiter(map(len, stretches), np.int64, len(stretches)))) + 1).tolist()

    def remember(self, stretches: set[str]) -> None:
        """Encode stretches of which the ids aren't known yet, and their pieces: a piece that
        stands alone is split and encoded as it is within a stretch."""
        together = [x for x in stretches if x[0] == " " and not x[-1].isspace()]
        pieces, ends = self.pieces_of(together)
        others = {x: PIECES.findall(x) for x in stretches.difference(together)}
        lacking = list(self.known.lacking(set(pieces).union(*others.values())))
        spelled = [x.encode() for x in lacking]
        short = [(x, y) for x, y in zip(lacking, spelled) if len(y) < LONG]
        found = dict(zip((x for x, _ in short), self.encode_pieces([y for _, y in short]))) if short else {}
        for x, y in zip(lacking, spelled):
            if len(y) >= LONG:
                codes = np.frombuffer(y, np.uint8)
                cuts = [0, *(np.flatnonzero(self.forced[codes[:-1], codes[1:]]) + 1).tolist(), len(y)]
                found[x] = np.array([i for a, b in zip(cuts, cuts[1:]) for i in self.merged(y[a:b])], "<u4").tobytes()
        self.known.add(found)
        of = self.known.young
        ids = [of[p] for p in pieces]
        several = {x: b"".join(ids[a:b]) for x, a, b in zip(together, [0, *ends], ends) if b - a > 1}
        several |= {x: b"".join([of[p] for p in parts]) for x, parts in others.items() if len(parts) > 1}
        self.known.add(several)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Of each text the ids as little-endian unsigned 32-bit integers."""
        cut = [[y for part in self.split_special(x) for y in ([part] if part in self.special else self.stretches_of(part))] for x in texts]
        lacking = self.known.lacking(set().union(*cut).difference(self.special))
        if lacking:
            self.remember(lacking)
        known = self.known.young
        known.update(self.special_ids)
        out = [b"".join(map(known.__getitem__, parts)) for parts in cut]
        self.known.settle()
        return out

    def decode(self, ids: bytes) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD."""
        tokens = np.frombuffer(ids, "<u4")
        sizes = self.lengths[tokens]
        ends = np.cumsum(sizes)
        place = np.repeat(self.starts[tokens] - (ends - sizes), sizes)
        place += np.arange(len(place))
        return self.spelling[place].tobytes().decode("utf-8", "replace")


_loaded: dict[int, Vocabulary] = {}


def vocabulary_of(source: bytes) -> Vocabulary:
    """The parsed vocabulary; a worker parses a file once."""
    key = hash(source)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(source)
    return _loaded[key]


def _with_columns(df: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, T.StructType]:
    chosen = df.select(*[F.col(c) for c in keep], text_of(text).alias("__text"))
    return chosen, T.StructType([f for f in chosen.schema.fields if f.name != "__text"])


def encode(docs: DataFrame, vocabulary_file: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``ids`` binary: little-endian unsigned 32-bit token ids.

    The driver reads the vocabulary file (a fixed file of some MB) and broadcasts it.
    """
    with open(vocabulary_file, "rb") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    chosen, kept = _with_columns(docs, keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(source.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                ids = pa.array(vocabulary.encode_batch(part.column("__text").to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], ids], [*keep, "ids"])

    return chosen.mapInArrow(run, T.StructType([*kept.fields, T.StructField("ids", T.BinaryType())]))


def decode(encoded: DataFrame, vocabulary_file: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """``keep`` columns, which may include the ids, and ``decoded`` string."""
    with open(vocabulary_file, "rb") as f:
        source = encoded.sparkSession.sparkContext.broadcast(f.read())
    chosen = encoded.select(*[F.col(c) for c in keep], F.coalesce(F.col(ids), F.lit(b"")).alias("__ids"))
    kept = [f for f in chosen.schema.fields if f.name != "__ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(source.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                texts = pa.array([vocabulary.decode(x) for x in part.column("__ids").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], texts], [*keep, "decoded"])

    return chosen.mapInArrow(run, T.StructType([*kept, T.StructField("decoded", T.StringType())]))


def round_trip(docs: DataFrame, vocabulary_file: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, ``ids`` as of :func:`encode` and ``decoded``, the text that these ids
    give: both in one pass of a worker, which holds one vocabulary for the two."""
    with open(vocabulary_file, "rb") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    chosen, kept = _with_columns(docs, keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(source.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                ids = vocabulary.encode_batch(part.column("__text").to_pylist())
                out = [pa.array(ids, pa.binary()), pa.array([vocabulary.decode(x) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *out], [*keep, "ids", "decoded"])

    added = [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    return chosen.mapInArrow(run, T.StructType([*kept.fields, *added]))
