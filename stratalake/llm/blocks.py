"""Arrays on the move: rows that carry packed numpy arrays between tasks.

A task packs what it has for each receiving partition into one compressed row,
so a shuffle of millions of small entries is a shuffle of few rows, which the
receiver unpacks into arrays.  Fixed-size counters over all rows are summed the
same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import arrow, partitions


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of any simple dtypes as one compressed value."""
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    body = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + body)


def unpack(value: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    size = int.from_bytes(raw[:4], "little")
    out, at = [], 4 + size
    for part in raw[4 : 4 + size].decode().split(";"):
        kind, n = part.split(",")
        out.append(np.frombuffer(raw, kind, int(n), at))
        at += out[-1].nbytes
    return out


def split_by(target: np.ndarray, count: int, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(target, the arrays' entries with that target) for the targets 0..count-1 that occur."""
    order = np.argsort(target, kind="stable")
    edges = np.searchsorted(target[order], np.arange(count + 1))
    held = [a[order] for a in arrays]
    for k in range(count):
        if edges[k] < edges[k + 1]:
            yield k, [a[edges[k] : edges[k + 1]] for a in held]


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names], strict=True)


def deal(df: DataFrame, target: str = "target", count: int | None = None) -> DataFrame:
    """Rows to the partition that `target` names."""
    return df.repartitionById(count or partitions(df.sparkSession), F.col(target))


def sum_counters(df: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int, pieces: int = 16) -> np.ndarray:
    """The sum over all tasks of `count`'s array of `size` int64 counters.

    The size is fixed by the caller, whatever the number of rows: every task
    sends size counters at most, and the driver gets that many.
    """
    return _combined(df, count, size, pieces, np.int64, np.add)


def join_bits(df: DataFrame, mark: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int, pieces: int = 16) -> np.ndarray:
    """The bits that are set in any task's array of `size` bytes, which `mark` makes."""
    return _combined(df, mark, size, pieces, np.uint8, np.bitwise_or)


def _combined(df: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int, pieces: int, kind: type, both: np.ufunc) -> np.ndarray:
    step = -(-size // pieces)

    def partial(batches):
        total = count(batches)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(range(pieces)), pa.int32()), pa.array([pack(total[k * step : (k + 1) * step]) for k in range(pieces)], pa.binary())], names=["target", "packed"]
        )

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for k, packed in rows_of(batches, "target", "packed"):
            (part,) = unpack(packed)
            sums[k] = both(part, sums[k]) if k in sums else part.astype(kind)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([pack(s) for s in sums.values()], pa.binary())], names=["target", "packed"])

    parts = deal(df.transform(arrow, partial, "target int, packed binary"), count=pieces).transform(arrow, add, "target int, packed binary").collect()
    out = np.zeros(size, kind)
    for k, packed in parts:
        (part,) = unpack(bytes(packed))
        out[k * step : k * step + len(part)] = part
    return out


def grouped(batches: Iterator[pa.RecordBatch], keys: Sequence[str], names: Sequence[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) for the runs of equal keys of rows sorted by them; holds one group at a time."""
    key, held = None, []
    for row in rows_of(batches, *keys, *names):
        own = row[: len(keys)]
        if own != key and held:
            yield key, held
            held = []
        key = own
        held.append(row[len(keys) :])
    if held:
        yield key, held
