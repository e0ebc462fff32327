"""Design-matrix least squares as aggregations.

The normal equations of every group are sums over its rows, so one aggregation
with partial sums on the map side takes the rows down to a small array a group;
the solves then run over Arrow batches of groups, all groups of a batch at once.
Columns are scaled to unit diagonal and small eigenvalues are cut, so a
rank-deficient group gets its minimum-norm solution.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basis import Term


def gram(df: DataFrame, y: Column, terms: Sequence[Term], by: Sequence[str], sigma: Column | None = None) -> DataFrame:
    """Sums of products of the terms and y, weighted by 1 / sigma**2 and plain: one row a group, rows with a null anywhere left out."""
    used = df.select(*by, y.cast("double").alias("_y"), *[t.value.cast("double").alias(f"_t{i}") for i, t in enumerate(terms)], *([sigma.cast("double").alias("_s")] if sigma is not None else []))
    used = used.dropna(subset=[c for c in used.columns if c.startswith("_")])
    columns = [F.col(f"_t{i}") for i in range(len(terms))] + [F.col("_y")]
    w = F.try_divide(F.lit(1.0), F.col("_s") * F.col("_s")) if sigma is not None else F.lit(1.0)
    products = [columns[i] * columns[j] for i in range(len(columns)) for j in range(i, len(columns))]
    weighted = F.array(*[F.sum(w * p) for p in products])
    plain = F.array(*[F.sum(p) for p in products]) if sigma is not None else weighted
    return used.groupBy(*by).agg(F.count("*").alias("n"), weighted.alias("weighted"), plain.alias("plain"))


def _square(flat: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(flat), size, size))
    upper = np.triu_indices(size)
    out[:, upper[0], upper[1]] = flat
    out[:, upper[1], upper[0]] = flat
    return out


def solve_batch(weighted: np.ndarray, plain: np.ndarray, n: np.ndarray, m: int, cond: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, their sigmas, residual sums of squares) of many groups; the sigmas come from the unweighted residuals and matrix, NaN without spare rows."""

    def inverse(a: np.ndarray) -> np.ndarray:
        scale = np.sqrt(np.maximum(np.einsum("gii->gi", a), 1e-300))
        values, vectors = np.linalg.eigh(a / scale[:, :, None] / scale[:, None, :])
        keep = values > np.maximum(cond**2, 1e-14) * values[:, -1:]
        inverted = np.where(keep, 1 / np.where(keep, values, 1), 0)
        return np.einsum("gik,gk,gjk->gij", vectors, inverted, vectors) / scale[:, :, None] / scale[:, None, :]

    w, p = _square(weighted, m + 1), _square(plain, m + 1)
    normal, right = w[:, :m, :m], w[:, :m, m]
    inverted = inverse(normal)
    x = np.einsum("gij,gj->gi", inverted, right)
    for _ in range(2):  # refined: what is left of the equations is solved again
        x = x + np.einsum("gij,gj->gi", inverted, right - np.einsum("gij,gj->gi", normal, x))
    a, b, yy = p[:, :m, :m], p[:, :m, m], p[:, m, m]
    rss = np.maximum(yy - 2 * np.einsum("gi,gi->g", x, b) + np.einsum("gi,gij,gj->g", x, a, x), 0)
    spare = n - m
    with np.errstate(divide="ignore", invalid="ignore"):
        variance = np.where(spare > 0, rss / np.maximum(spare, 1), np.nan)
        sigma = np.sqrt(variance[:, None] * np.einsum("gii->gi", inverse(a)))
    return x, sigma, rss


def _list(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def fit(df: DataFrame, y: Column, terms: Sequence[Term], by: Sequence[str], sigma: Column | None = None, cond: float = 1e-5, min_rows: Column | None = None) -> DataFrame:
    """Per group: n, m_<term>, s_<term> (null without spare rows) and rss.

    `min_rows`, a test on n, leaves groups out: their coefficients are null.
    """
    sums = gram(df, y, terms, by, sigma)
    sums = sums.withColumn("_ok", min_rows if min_rows is not None else F.lit(True))
    m, names = len(terms), [t.name for t in terms]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            if not batch.num_rows:
                continue
            width = (m + 1) * (m + 2) // 2
            n = np.asarray(batch.column(at["n"]))
            x, s, rss = solve_batch(_list(batch.column(at["weighted"]), width), _list(batch.column(at["plain"]), width), n, m, cond)
            bad = ~np.asarray(batch.column(at["_ok"]).to_numpy(zero_copy_only=False), bool)
            null = lambda v, more=False: pa.array(v, mask=bad | more | ~np.isfinite(v))
            yield pa.RecordBatch.from_arrays(
                [batch.column(at[k]) for k in by] + [pa.array(n)] + [null(x[:, i].copy()) for i in range(m)] + [null(s[:, i].copy()) for i in range(m)] + [null(rss)],
                names=[*by, "n", *[f"m_{k}" for k in names], *[f"s_{k}" for k in names], "rss"],
            )

    keys = ", ".join(f"`{k}` {sums.schema[k].dataType.simpleString()}" for k in by)
    doubles = ", ".join(f"`{p}_{k}` double" for p in "ms" for k in names)
    return sums.mapInArrow(run, f"{keys + ', ' if by else ''}n long, {doubles}, rss double")


def fit_truncated(df: DataFrame, y: Column, terms: Sequence[Term], by: Sequence[str], cond: float, sigma: Column | None = None) -> DataFrame:
    """Per group: n and m_<term>, the least-squares solution without the singular values of the design that are below `cond`, an absolute limit.

    Singular values come as roots of the normal matrix' eigenvalues, so a limit
    below 1e-7 of the largest one can't be told from rounding.
    """
    m, names = len(terms), [t.name for t in terms]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            if not batch.num_rows:
                continue
            w = _square(_list(batch.column(at["weighted"]), (m + 1) * (m + 2) // 2), m + 1)
            values, vectors = np.linalg.eigh(w[:, :m, :m])
            keep = (values >= cond**2) & (values > 1e-14 * values[:, -1:])
            inverted = np.where(keep, 1 / np.where(keep, values, 1), 0)
            x = np.einsum("gik,gk,gjk,gj->gi", vectors, inverted, vectors, w[:, :m, m])
            yield pa.RecordBatch.from_arrays([batch.column(at[k]) for k in by] + [batch.column(at["n"])] + [pa.array(x[:, i].copy()) for i in range(m)], names=[*by, "n", *[f"m_{k}" for k in names]])

    sums = gram(df, y, terms, by, sigma)
    keys = ", ".join(f"`{k}` {sums.schema[k].dataType.simpleString()}" for k in by)
    return sums.mapInArrow(run, f"{keys + ', ' if by else ''}n long, " + ", ".join(f"`m_{k}` double" for k in names))


def evaluate(terms: Sequence[Term], prefix: str = "m_") -> Column:
    """The fitted model at a row that has the coefficients beside it."""
    total = F.lit(0.0)
    for t in terms:
        total = total + F.col(f"{prefix}{t.name}") * t.value
    return total


def fit_pixels(obs: DataFrame, y: Column, terms: Sequence[Term], dates: int, key: str = "pixel", sigma: Column | None = None, cond: float = 1e-5) -> DataFrame:
    """Temporal decomposition of each pixel; one with no more than a sixth of the dates gets nulls."""
    return fit(obs, y, terms, [key], sigma, cond, F.col("n") > F.lit(dates / 6))


def fit_all(df: DataFrame, y: Column, terms: Sequence[Term], sigma: Column | None = None, cond: float = 1e-5) -> dict[str, float | int | None]:
    """One fit over all rows, as a dict of a row: a few numbers for the driver."""
    row = fit(df, y, terms, [], sigma, cond).first()
    return row.asDict() if row else {"n": 0} | {f"m_{t.name}": None for t in terms}
