"""Vectorised views of batches of texts as UTF-8 bytes: blocks, word spans, hashes of words and rolling hashes.

A block is a run of whole documents whose bytes lie in one array. Documents are never cut, so a block is
as long as ``block_bytes`` or as its one document.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.operators.spread import spread

BLOCK_BYTES = 1 << 20

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words of ASCII digits and lower-case letters and of all other characters from U+0080 on.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes that aren't ASCII white space.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[9:14] = NONSPACE[32] = False


@dataclass
class Block:
    """``n`` documents: bytes ``buf[offs[i]:offs[i + 1]]`` are document i's; ``columns`` are Arrow arrays."""

    buf: np.ndarray
    offs: np.ndarray
    valid: np.ndarray
    columns: dict[str, pa.Array]

    @property
    def n(self) -> int:
        return len(self.offs) - 1


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets from 0, validity) of a string or binary array without copying; null has no bytes."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        wide = np.int64
    else:
        wide = np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64), np.zeros(len(column), bool)
    offs = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return buf, offs - offs[0], column.is_valid().to_numpy(zero_copy_only=False)


def blocks(batch: pa.RecordBatch, text: str, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    column = batch.column(batch.schema.get_field_index(text))
    buf, offs, valid = bytes_of(column)
    at, n = 0, len(column)
    names = batch.schema.names
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + block_bytes, "right")) - 1)
        end = min(end, n)
        yield Block(
            buf[offs[at] : offs[end]],
            offs[at : end + 1] - offs[at],
            valid[at:end],
            {k: batch.column(i).slice(at, end - at) for i, k in enumerate(names)},
        )
        at = end


def map_blocks(
    df: DataFrame,
    columns: dict[str, str],
    work: Callable[[Block], dict[str, object] | None],
    schema: str,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Apply ``work`` to blocks of ``df``, which is dealt to all cores first if it is a small table in a few files. ``columns`` maps a block's column names to those of ``df``; the
    one called ``text`` makes up the blocks. ``work`` gives a list or array for each column of ``schema``."""
    picked = df.select(*[F.col(f"`{c}`").alias(k) for k, c in columns.items()])
    fields = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches):
        for batch in batches:
            yield from one(batch)
        release()

    def one(batch):
        for block in blocks(batch, "text", block_bytes):
            out = work(block)
            if out is not None:
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) and x.type == f.type else pa.array(x, f.type) for f, x in ((f, out[f.name]) for f in arrow)],
                    schema=arrow,
                )

    return spread(picked).mapInArrow(run, fields)


def release() -> None:
    """Give memory that is free back to the system: a Python worker outlives its tasks, and the next stage
    needs the room."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def kept(keep: tuple[str, ...]):
    """The columns to carry along, as one struct called ``kept``: their names can't clash with others."""
    return F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(None).cast("int").alias("none")]).alias("kept")


_powers: list[np.ndarray] = [np.ones(1, _U64), np.ones(1, _U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(size, b, _U64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U64(32))
    x = x * _U64(0xD6E8FEB86659FD93)
    x ^= x >> _U64(32)
    x *= _U64(0xD6E8FEB86659FD93)
    x ^= x >> _U64(32)
    return x


class Rolling:
    """Hashes of any runs of a sequence of 64-bit values in constant time each, from one running sum. Who relies on
    equality compares what lies behind the values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self._down = powers(n)
        self._sum = np.zeros(n + 1, _U64)
        np.cumsum(values * up[:n], out=self._sum[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self._sum[ends] - self._sum[starts]
        h *= self._down[starts]
        h += (ends - starts).astype(_U64) * _U64(0xC2B2AE3D27D4EB4F)
        return mix(h)


def word_spans(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds): words are maximal runs of the bytes in ``table`` within a document; document
    i's words are those from ``bounds[i]`` to ``bounds[i + 1]``."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    inside = table[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[offs[:-1][offs[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offs[1:][offs[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_array(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
    """The words at these places, in order."""
    sizes = ends - starts
    data = buf[ragged(starts, sizes)]
    offs = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offs[1:])
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offs), pa.py_buffer(data)])


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of BLAKE2b for each word; distinct words, told apart by their bytes, are hashed once."""
    found = word_array(buf, starts, ends).dictionary_encode()
    make = hashlib.blake2b
    digests = b"".join([make(w, digest_size=8).digest() for w in found.dictionary.to_numpy(zero_copy_only=False)])
    return np.frombuffer(digests, "<u8")[found.indices.to_numpy()]


def code_points(buf: np.ndarray) -> np.ndarray:
    """Whether each byte begins a character."""
    return (buf & 0xC0) != 0x80


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] times, then the same for the next."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


def ragged_lists(values: np.ndarray | pa.Array, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list array whose lists have the given lengths."""
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))
