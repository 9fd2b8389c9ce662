"""Slices: documents dealt by hash into groups that a task holds at once, packed.

Language models are looked up by slice: each slice asks for the n-grams that its texts
hold, each once, and gets back what the model has of them. The slices' texts are moved once
as compressed blocks, and so are sorted lists of n-gram keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retenta.llm.staging import total_bytes

SLICE_BYTES = 12 << 20
FLUSH_BYTES = 16 << 20


def number_of(docs: DataFrame, text: str = "text", slice_bytes: int = SLICE_BYTES) -> int:
    """How many slices keep a slice's texts near ``slice_bytes``."""
    return max(1, -(-total_bytes(docs, text) // slice_bytes))


def dealt(n_slices: int, *by: str) -> Column:
    """The slice of a row, by the hash of some columns."""
    return F.pmod(F.xxhash64(*by), F.lit(n_slices)).cast("int")


def packed(rows: DataFrame, n_slices: int) -> DataFrame:
    """(slice, block): the rows of each ``slice`` with their other columns, as compressed
    Arrow streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).sort_by("slice")
            of = table.column("slice").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            for a, b in zip(starts, np.append(starts[1:], len(of))):
                part = table.slice(a, b - a).drop_columns(["slice"]).combine_chunks()
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_table(pa.table([pa.concat_arrays([*c.chunks]) if c.num_chunks else c for c in part.columns], part.schema))
                yield pa.RecordBatch.from_arrays([pa.array([of[a]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["slice", "block"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.nbytes for x in held) >= FLUSH_BYTES:
                yield from flush()
                held = []
        if held:
            yield from flush()

    return rows.mapInArrow(run, "slice int, block binary").repartition(n_slices, "slice")


def unpacked(blocks: pa.ChunkedArray) -> pa.Table | None:
    """The rows of a slice's blocks; None without any."""
    tables = [pa.ipc.open_stream(pa.py_buffer(x.as_py())).read_all() for x in blocks]
    return pa.concat_tables(tables) if tables else None


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct unsigned 64-bit keys: their differences' bytes, low bytes first, by
    place, without the places where all are zero."""
    return pack_numbers(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(blob), dtype=np.uint64)


def pack_numbers(values: np.ndarray) -> bytes:
    values = np.ascontiguousarray(values, "<u8")
    # the first difference may be long: it stands apart
    places = max(1, -(-int(values[1:].max()).bit_length() // 8)) if len(values) > 1 else 1
    planes = values[1:].view(np.uint8).reshape(-1, 8).T[:places] if len(values) else np.zeros((0, 0), np.uint8)
    return np.array([len(values), values[0] if len(values) else 0], "<u8").tobytes() + np.ascontiguousarray(planes).tobytes()


def unpack_numbers(blob: bytes) -> np.ndarray:
    n, first = np.frombuffer(blob, "<u8", 2)
    out = np.zeros(int(n), "<u8")
    if n:
        out[0] = first
    if n > 1:
        planes = np.frombuffer(blob, np.uint8, offset=16).reshape(-1, int(n) - 1)
        rest = np.zeros((int(n) - 1, 8), np.uint8)
        rest[:, : len(planes)] = planes.T
        out[1:] = rest.view("<u8")[:, 0]
    return out


def by_shard(keys: np.ndarray, shards: int) -> list[slice]:
    """Where each shard's keys stand in a sorted list: equal ranges of the mixed keys."""
    bounds = np.array([((1 << 64) * k) // shards for k in range(1, shards)], np.uint64)
    cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


def documents_of(table: pa.Table, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column without nulls, and each text's offsets in them."""
    texts = table.column(column).combine_chunks()
    texts = (pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]] if len(texts) else flat[:0], offsets - offsets[0]


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32  # A to Z count as a to z
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SEED = 0x9E3779B97F4A7C15
_CHUNK = 1 << 18
#: bytes from which a word is hashed by itself
_LONG = 64
#: of the last eight bytes of a word, those that are its own
_OWN = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def _hashed(lower: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of the words of at most _LONG bytes, eight bytes of all of them at a time. Each
    step mixes what came before with the next eight bytes, after the word's length."""
    out = mixed(sizes.astype(np.uint64) + np.uint64(_SEED))
    rest, at = np.arange(len(starts)), 0
    while len(rest):
        eight = lower[(starts[rest] + at)[:, None] + np.arange(8)].view("<u8")[:, 0]
        eight &= _OWN[np.minimum(sizes[rest] - at, 8)]
        out[rest] = mixed((out[rest] ^ eight) * _MIX2 + np.uint64(_SEED))
        at += 8
        rest = rest[sizes[rest] > at]
    return out


def word_hashes(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A to Z lower-cased, and in which text each stands."""
    inside = ~_IS_SPACE[flat]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(flat))]  # a word ends with its text
    begin[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    sizes = ends - starts
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + _CHUNK)))
        a, b = int(starts[at]), int(ends[to - 1])
        lower = np.concatenate([_LOWER[flat[a:b]], np.zeros(8, np.uint8)])
        short = at + np.flatnonzero(sizes[at:to] <= _LONG)
        out[short] = _hashed(lower, starts[short] - a, sizes[short])
        for i in (at + np.flatnonzero(sizes[at:to] > _LONG)).tolist():
            out[i] = xxhash.xxh3_64_intdigest(lower[starts[i] - a : ends[i] - a].tobytes(), _SEED)
        at = to
    return out, np.searchsorted(offsets[1:], starts, side="right")
