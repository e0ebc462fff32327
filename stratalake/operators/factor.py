"""Principal and independent components of series.

The covariance of dates is summed by Spark; the eigenvectors of that matrix,
dates by dates, are the driver's only work.  Maps are projections of the rows.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint


def _complete(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(which rows of an array column have all values, these as a matrix); the longest rows set the width."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    size = int(lengths.max(initial=0))
    whole = np.flatnonzero((lengths == size) & (size > 0))
    flat = column.take(pa.array(whole)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    x = flat.reshape(len(whole), size)
    finite = np.isfinite(x).all(axis=1)
    return whole[finite], x[finite]


def _summed(parts: DataFrame) -> np.ndarray:
    """The sum of a column of arrays, entry by entry; as many numbers as an array has come to the driver."""
    rows = parts.select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    return np.array([r["v"] for r in rows])


def moments(wide: DataFrame, value: str = "disp") -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, covariance and number of the complete rows of an array column."""

    def run(batches):
        total = None
        for batch in batches:
            _, x = _complete(batch.column(0))
            if len(x):
                part = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["sums"])

    flat = _summed(wide.select(F.col(value)).mapInArrow(run, "sums array<double>"))
    if not len(flat):
        return np.zeros(0), np.zeros((0, 0)), 0
    n, size = int(flat[0]), int(round((-1 + np.sqrt(1 + 4 * (len(flat) - 1))) / 2))
    mean = flat[1 : 1 + size] / n
    return mean, flat[1 + size :].reshape(size, size) / n - np.outer(mean, mean), n


def components(covariance: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors as rows, explained shares); the largest entry of each vector is positive."""
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:count]
    found = vectors[:, order].T
    signs = np.sign(found[np.arange(len(found)), np.abs(found).argmax(axis=1)])
    return found * signs[:, None], values[order] / max(float(values.sum()), 1e-300)


def project(wide: DataFrame, mean: np.ndarray, vectors: np.ndarray, key: str = "pixel", value: str = "disp") -> DataFrame:
    """(key, component, value) of the complete rows."""
    size = len(vectors)

    def run(batches):
        for batch in batches:
            whole, x = _complete(batch.column(1))
            if len(whole):
                scores = (x - mean) @ vectors.T
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.repeat(whole, size))), pa.array(np.tile(np.arange(size, dtype=np.int32), len(whole))), pa.array(scores.ravel())],
                    names=[key, "component", "value"],
                )

    return wide.select(key, value).mapInArrow(run, f"`{key}` {wide.schema[key].dataType.simpleString()}, component int, value double")


def pca(wide: DataFrame, count: int = 10, key: str = "pixel", value: str = "disp") -> tuple[DataFrame, DataFrame]:
    """(maps, vectors): projections of the complete rows, and (component, idx, value, explained)."""
    mean, covariance, _ = moments(wide, value)
    vectors, shares = components(covariance, count)
    rows = [(c, i, float(v), float(shares[c])) for c, row in enumerate(vectors) for i, v in enumerate(row)]
    return project(wide, mean, vectors, key, value), wide.sparkSession.createDataFrame(rows, "component int, idx int, value double, explained double")


def _decorrelated(w: np.ndarray) -> np.ndarray:
    u, _, v = np.linalg.svd(w)
    return u @ v


def fast_ica(white: DataFrame, size: int, iterations: int = 200, tolerance: float = 1e-4, seed: int = 0) -> np.ndarray:
    """Symmetric FastICA with the log-cosh contrast -> the unmixing rotation.

    white: rows array<double> of `size` whitened values.  Each iteration is one
    job that sums size by size numbers.  Warns where the last iteration still
    moved more than the tolerance.
    """
    w = _decorrelated(np.random.default_rng(seed).normal(size=(size, size)))
    for _ in range(iterations):

        def sums(batches, w=w):
            total = np.zeros(size * size + size + 1)
            for batch in batches:
                x = np.asarray(batch.column(0).flatten()).reshape(-1, size)
                g = np.tanh(x @ w.T)
                total += np.concatenate([(g.T @ x).ravel(), (1 - g**2).sum(axis=0), [len(x)]])
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["sums"])

        total = _summed(white.mapInArrow(sums, "sums array<double>"))
        n = max(total[-1], 1.0)
        new = _decorrelated(total[: size * size].reshape(size, size) / n - (total[size * size : -1] / n)[:, None] * w)
        moved = np.abs(np.abs(np.einsum("ij,ij->i", new, w)) - 1).max()
        w = new
        if moved < tolerance:
            break
    else:
        warnings.warn(f"independent components still moved by {moved:.2g} after {iterations} iterations", stacklevel=2)
    return w


def ica(wide: DataFrame, count: int, key: str = "pixel", value: str = "disp", seed: int = 0, iterations: int = 200) -> tuple[DataFrame, DataFrame]:
    """(maps, mixing): independent components in space, from all complete rows.

    Signs make the largest mixing entry positive, and components go by explained variance.
    """
    mean, covariance, _ = moments(wide, value)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:count]
    whiten = vectors[:, order].T / np.sqrt(np.maximum(values[order], 1e-300))[:, None]

    def whitened(batches):
        for batch in batches:
            x = (_complete(batch.column(0))[1].reshape(-1, len(mean)) - mean) @ whiten.T
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64()))], names=["x"])

    white = checkpoint(wide.select(value).mapInArrow(whitened, "x array<double>"))
    unmix = fast_ica(white, len(order), iterations, seed=seed) @ whiten
    mixing = np.linalg.pinv(unmix)
    rank = np.argsort(-(mixing**2).sum(axis=0))
    signs = np.sign(mixing[np.abs(mixing).argmax(axis=0), np.arange(len(order))])
    unmix, mixing = (unmix * signs[:, None])[rank], (mixing * signs)[:, rank]
    rows = [(c, i, float(mixing[i, c])) for c in range(len(order)) for i in range(len(mean))]
    return project(wide, mean, unmix, key, value), wide.sparkSession.createDataFrame(rows, "component int, idx int, value double")


def reconstruct(maps: DataFrame, vectors: DataFrame, chosen: list[int], key: str = "pixel") -> DataFrame:
    """Series from some of the components: sums of map times vector. A pixel's components meet as one row, and its dates are spread after that."""
    held = vectors.where(F.col("component").isin(chosen)).groupBy("component", "idx").agg(F.sum("value").alias("v")).collect()  # components by dates
    names, dates = sorted({r["component"] for r in held}), sorted({r["idx"] for r in held})
    table = np.full((len(names), len(dates)), np.nan)
    for r in held:
        table[names.index(r["component"]), dates.index(r["idx"])] = r["v"]
    known = np.isfinite(table)
    scores = maps.where(F.col("component").isin(names)).groupBy(key).agg(F.array(*[F.sum(F.when(F.col("component") == c, F.col("value"))) for c in names] or [F.lit(None).cast("double")]).alias("scores"))

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows if names else 0, 2_000):
                part = batch.slice(first, 2_000)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(names))
                told = np.isfinite(x)
                row, at = np.nonzero(told.astype(int) @ known > 0)
                model = (np.where(told, x, 0.0) @ np.where(known, table, 0.0))[row, at]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(np.array(dates, np.int32)[at]), pa.array(model)], names=[key, "idx", "model"])

    return scores.mapInArrow(run, f"`{key}` {maps.schema[key].dataType.simpleString()}, idx int, model double")
