"""Vectorised text helpers that run inside Python tasks.

All work on the UTF-8 bytes of a whole Arrow batch at once: separators are ASCII, so a byte table finds words, and a
polynomial hash modulo 2**64 gives the hash of any byte or word range from two prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one vectorised step takes (a longer document is a step of its own).
STEP_BYTES = 1 << 20

#: Two independent hashes: their bases, and the value of each byte.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BYTES = np.random.default_rng(20260101).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def byte_table(separators: str | bytes) -> np.ndarray:
    """256 flags: whether a byte belongs to a word."""
    table = np.ones(256, bool)
    table[np.frombuffer(separators if isinstance(separators, bytes) else separators.encode("latin-1"), np.uint8)] = False
    return table


#: Words between white space: [^\x20\x09-\x0D]+
SPACED = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Words of ASCII letters and digits and any other character: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing)
ALNUM = byte_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows, in slices of at most `limit` bytes of `column` (or one row)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, first, n = np.cumsum(lengths), 0, len(lengths)
        while first < n:
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(first, last - first)
            first = last


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows in one array, and where each row begins (n + 1 offsets). Null: no bytes."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of the first word of each row (n + 1 of them)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of a base, and of its inverse modulo 2**64."""
    if kind not in _powers or len(_powers[kind][0]) < n:
        size, out = (1 << max(18, (n - 2).bit_length())) + 1, []
        for base in (_BASES[kind], pow(_BASES[kind], -1, 1 << 64)):
            row = np.full(size, np.uint64(base))
            row[0] = 1
            np.multiply.accumulate(row, out=row)
            out.append(row)
        _powers[kind] = (out[0], out[1])
    return _powers[kind][0][:n], _powers[kind][1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Ranges:
    """Hashes of ranges of a sequence of bytes or of 64-bit values: equal content, equal hash. `kind` 0 or 1."""

    def __init__(self, values: np.ndarray, kind: int = 0):
        v = _BYTES[kind][values] if values.dtype == np.uint8 else values
        power, self._inverse = _power(len(v) + 1, kind)
        self._sum = np.zeros(len(v) + 1, np.uint64)
        np.cumsum(v * power[:-1], out=self._sum[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        h = (self._sum[end] - self._sum[start]) * self._inverse[start]
        return mix(h + (np.asarray(end - start).astype(np.uint64) + np.uint64(seed)) * np.uint64(0xD6E8FEB86659FD93))


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values (len - width + 1 of them), in time that doesn't depend on `width`."""
    n = len(values)
    if width <= 1 or n < width:
        return values if width <= 1 else values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ranges_of(counts: np.ndarray) -> np.ndarray:
    """0 .. count-1 for each count, one after the other."""
    counts = np.asarray(counts, np.int64)
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def joined_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Each row's words joined by one space, one row after the other; where each row begins; words of each row."""
    start, end, first = words(data, offsets, table)
    n = np.diff(first)
    keep, out = table[data], data.copy()
    # the byte after each word of a row but its last becomes that space
    inner = np.ones(len(end), bool)
    inner[first[1:][n > 0] - 1] = False
    out[end[inner]] = 32
    keep[end[inner]] = True
    return out[keep].tobytes(), np.concatenate(([0], np.cumsum(keep)))[offsets], n
