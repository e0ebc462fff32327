"""Vectorised text primitives shared by the operators of this subpackage.

Texts are handled as one UTF-8 byte buffer per slice of rows, with numpy
arrays of word boundaries and 64-bit span fingerprints beside it, so that the
cost of a word is a few array operations and not a Python call.  A slice holds
about SLICE_BYTES of text whatever the number of rows; one longer text makes a
slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply); a bijection."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: A value of 64 bits for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    known = _powers.get(name)
    if known is None or len(known) < n:
        size = max(n, SLICE_BYTES + 1)
        known = np.empty(size, U64)
        known[0] = 1
        have, step = 1, base
        while have < size:  # base**(have+i) = base**have * base**i
            more = min(have, size - have)
            known[have : have + more] = known[:more] * U64(step)
            step = step * step % (1 << 64)
            have += more
        if size <= 2 * SLICE_BYTES:
            _powers[name] = known
    return known


class Fingerprints:
    """Fingerprints of any spans of a buffer, from one prefix sum."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.inverse = _power("inverse", _BASE_INVERSE, n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(BYTE_VALUES[data] * _power("base", _BASE, n + 1)[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix(raw + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))

    def grams(self, size: int) -> np.ndarray:
        """Of every span of `size` bytes, by its start."""
        n = max(0, len(self.sums) - size)
        return mix((self.sums[size:] - self.sums[:n]) * self.inverse[:n])


def table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(members, np.uint8)] = True
    return out


SPACES = table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Bytes of the words of a licence scan: digits, letters and all beyond ASCII.
NAME_BYTES = table(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A string column as bytes and int64 offsets; null is the empty text."""
    array = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_null(array.type):
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    array = array.cast(pa.large_binary() if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else pa.binary())
    if array.null_count:
        array = array.fill_null(b"")
    wide = pa.types.is_large_binary(array.type)
    _, places, values = array.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(values, np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
    return data, offsets - first


def slices(batches: Iterator[pa.RecordBatch], name: str, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The rows in slices of about `size` bytes of text: batch, bytes, offsets."""
    for batch in batches:
        data, offsets = column(batch, name)
        first, rows = 0, len(offsets) - 1
        while first < rows:
            last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
            last = min(rows, max(first + 1, last))
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes; none crosses a row."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edge = offsets[(offsets > 0) & (offsets < n)]
    start[edge] = inside[edge]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    end[edge - 1] = inside[edge - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def row_bounds(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """bounds[i]:bounds[i+1] are the spans that start in row i."""
    return np.searchsorted(starts, offsets)


def row_of(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def sum_by_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def word_fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of words given by their spans, over pieces of bounded size."""
    out, first = np.empty(len(starts), U64), 0
    while first < len(starts):
        base = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        out[first:last] = Fingerprints(data[base : int(ends[last - 1])]).of(starts[first:last] - base, ends[first:last] - base)
        first = last
    return out


def chain(words: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of `size` consecutive words, by the first one's index."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = words[:n].copy()
    for k in range(1, size):
        out = mix(out * U64(0xA0761D6478BD642F) + words[k : k + n])
    return out
