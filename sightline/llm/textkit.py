"""Numpy helpers over the UTF-8 bytes of Arrow text columns.

All functions work on one bounded slice of rows at a time; whole texts are
always processed, a slice holds at least one row however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
_tables: dict[str, np.ndarray] = {}


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    return [v or b"" for v in column.to_pylist()]


def slices(column: pa.Array, target: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) pieces of about ``target`` bytes."""
    n = len(column)
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i in range(n):
        if i > start and total + lengths[i] > target:
            yield start, text_bytes(column.slice(start, i - start))
            start, total = i, 0
        total += int(lengths[i])
    if n > start:
        yield start, text_bytes(column.slice(start, n - start))


def join_rows(texts: list[bytes], separator: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """All rows in one byte array, one separator byte after each; and the
    offset at which each row starts (with one final entry)."""
    buf = np.frombuffer(separator.join(texts) + separator, np.uint8)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return buf, offsets


def byte_class(word: bytes | set[int]) -> np.ndarray:
    """Lookup table: 1 for the byte values that belong to words."""
    table = np.zeros(256, np.uint8)
    table[list(word)] = 1
    return table


NON_SPACE = byte_class(set(range(256)) - {0x20, *range(0x09, 0x0E)})


def tokens(buf: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the maximal runs of word bytes."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = table[buf]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n (kept per worker)."""
    have = _tables.get("power")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        _tables["power"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, BASE)]))
        _tables["inverse"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse)]))
    return _tables["power"][:n], _tables["inverse"][:n]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of byte * BASE**i: any span's hash in constant time."""
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(len(buf))[0], out=sums[1:])
    return sums


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of buf[start:end] for each pair; equal bytes, equal hash."""
    inverse = powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def row_of(offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Row index of each span start."""
    return np.searchsorted(offsets, starts, side="right") - 1
