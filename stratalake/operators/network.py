"""Inversion over the pair graph: values of pairs to values of dates.

Pairs are summed to one row a pair of dates, which makes the graph's normal
equations.  What the driver holds are vectors with a number a date.  Small
networks, whose matrix has at most DENSE_DATES rows, are solved there at once;
of larger ones each iteration of a conjugate gradient multiplies the matrix with
a vector where its entries are, and tasks send sums by date.  A network's
unconnected parts are pinned each at its first date.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

#: Dates that the driver solves for at once: 1.1 million pairs of dates at most, a matrix of 18 MB.
DENSE_DATES = 1500
#: Tasks that send a vector of dates each in an iteration.
SUM_TASKS = 32


def pair_weights(*, bt_years: Column | None = None, length: Column | None = None, lines: int = 1, rms: Column | None = None, rms_p80: float = 1.0) -> Column:
    """sigma of a pair: the sum of the inverses of exp(-bt / 2), length / lines and exp(-rms / p80) + 0.01, those that are given."""
    parts = []
    if bt_years is not None:
        parts.append(1 / F.exp(-bt_years / 2))
    if length is not None:
        parts.append(1 / (length / F.lit(float(lines))))
    if rms is not None:
        parts.append(1 / (F.exp(-rms / F.lit(rms_p80)) + 0.01))
    total = F.lit(0.0) if parts else F.lit(1.0)
    for p in parts:
        total = total + p
    return total


class _Graph:
    """Pairs (date1, date2, v, w) as entries (i, j, w, wv) over the dates in order."""

    def __init__(self, used: DataFrame):
        summed = checkpoint(used.groupBy("date1", "date2").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("v")).alias("wv")))
        rows = summed.select("date1").union(summed.select(F.col("date2"))).distinct().orderBy("date1").collect()  # one row a date
        self.dates = np.array([r["date1"] for r in rows], np.int64)
        dates = self.dates

        def place(batches):
            for batch in batches:
                i, j = (np.searchsorted(dates, np.asarray(batch.column(k)).astype(np.int64)) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), batch.column(2), batch.column(3)], names=["i", "j", "w", "wv"])

        self.entries = checkpoint(summed.select("date1", "date2", F.col("w").cast("double"), F.col("wv").cast("double")).mapInArrow(place, "i long, j long, w double, wv double").coalesce(SUM_TASKS))

    def sums(self, of: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
        """What `of` adds to a vector of the dates, over all entries (i, j, w, wv)."""
        n = len(self.dates)

        def run(batches):
            total = np.zeros(n)
            for batch in batches:
                of(total, *[np.asarray(c) for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        return sum((np.frombuffer(r["sums"]) for r in self.entries.mapInArrow(run, "sums binary").collect()), np.zeros(n))

    def parts(self) -> np.ndarray:
        """For each date the first date of its connected part; tasks send forests of their entries."""
        n = len(self.dates)

        def forest(batches):
            root = np.arange(n)
            for batch in batches:
                _unite(root, np.asarray(batch.column(0)), np.asarray(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array([root.tobytes()], pa.binary())], names=["root"])

        root = np.arange(n)
        for r in self.entries.select("i", "j").mapInArrow(forest, "root binary").collect():
            _unite(root, np.arange(n), np.frombuffer(r["root"], np.int64))
        return root


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Makes root name the smallest member of each part, with the links a-b added."""
    while True:
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, before[a], least)
        np.minimum.at(root, before[b], least)
        while (root[root] != root).any():
            root[:] = root[root]
        if (root == before).all():
            return


def invert(pairs: DataFrame, value: str, sigma: Column | None = None, sign: tuple[int, int] = (-1, 1), pin: bool = True, non_negative: bool = False) -> DataFrame:
    """(date, value, part): least squares of sign[0] x[date1] + sign[1] x[date2] = value.

    pin: the first date of each connected part is 0 (for differences); without
    it the solution of minimum norm.  non_negative: no value below 0.  Pairs
    without a value don't count; no pairs give no rows.
    """
    w = 1 / (sigma * sigma) if sigma is not None else F.lit(1.0)
    graph = _Graph(pairs.where(F.col(value).isNotNull()).select("date1", "date2", F.col(value).cast("double").alias("v"), w.cast("double").alias("w")))
    n, (s1, s2) = len(graph.dates), sign
    part = graph.parts()

    def right_side(total, i, j, w, wv):
        np.add.at(total, i, s1 * wv)
        np.add.at(total, j, s2 * wv)

    def weights(total, i, j, w, wv):
        np.add.at(total, i, s1 * s1 * w)
        np.add.at(total, j, s2 * s2 * w)

    right, diagonal = graph.sums(right_side), graph.sums(weights)
    pinned = np.zeros(n)
    if pin and s1 * s2 < 0 and n:
        pinned[np.unique(part)] = max(1.0, float(diagonal.max()))

    def product(x: np.ndarray) -> np.ndarray:
        def add(total, i, j, w, wv):
            both = w * (s1 * x[i] + s2 * x[j])
            np.add.at(total, i, s1 * both)
            np.add.at(total, j, s2 * both)

        return graph.sums(add) + pinned * x

    if n <= DENSE_DATES:
        normal = np.diag(pinned)
        for r in graph.entries.select("i", "j", "w").toPandas().to_numpy() if n else []:
            i, j, w = int(r[0]), int(r[1]), r[2]
            normal[[i, j, i, j], [i, j, j, i]] += np.array([s1 * s1, s2 * s2, s1 * s2, s1 * s2]) * w
        x = (non_negative_solve if non_negative else _symmetric_solve)(normal, right) if n else np.zeros(0)
    else:
        x = projected_gradient(product, right, diagonal) if non_negative else conjugate_gradient(product, right, diagonal + pinned if pin else np.ones(n))
    rows = [(int(d), float(v), int(p)) for d, v, p in zip(graph.dates, x, graph.dates[part], strict=True)]
    return pairs.sparkSession.createDataFrame(rows, "date int, value double, part int")


def _symmetric_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(a)
    keep = values > 1e-12 * max(float(values[-1]), 1e-300)
    return vectors[:, keep] @ ((vectors[:, keep].T @ b) / values[keep])


def conjugate_gradient(product: Callable[[np.ndarray], np.ndarray], b: np.ndarray, diagonal: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    """The solution of a x = b for a positive semidefinite matrix, given by its products and its diagonal; with a diagonal of ones, that of minimum norm."""
    scale = np.where(diagonal > 0, diagonal, 1.0)
    x, rest = np.zeros(len(b)), b.copy()
    z = rest / scale
    p, gain = z.copy(), float(rest @ z)
    first = gain
    for _ in range(4 * len(b) + 100):
        if gain <= tolerance**2 * first:
            return x
        q = product(p)
        step = gain / float(p @ q)
        x, rest = x + step * p, rest - step * q
        z = rest / scale
        gain, before = float(rest @ z), gain
        p = z + gain / before * p
    raise RuntimeError("the network's conjugate gradient did not settle")


def projected_gradient(product: Callable[[np.ndarray], np.ndarray], b: np.ndarray, diagonal: np.ndarray, tolerance: float = 1e-10, iterations: int = 20_000) -> np.ndarray:
    """min x'ax / 2 - b'x with x >= 0, by accelerated steps: with unit diagonal a graph's matrix has no eigenvalue above 2."""
    scale = 1 / np.sqrt(np.where(diagonal > 0, diagonal, 1.0))
    x, ahead, t = np.zeros(len(b)), np.zeros(len(b)), 1.0
    for _ in range(iterations):
        new = np.maximum(ahead - (scale * product(scale * ahead) - scale * b) / 2, 0)
        moved = float(np.abs(new - x).max(initial=0))
        if float((ahead - new) @ (new - x)) > 0:
            t = 1.0  # started anew where the last step went uphill
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, x, t = new + (t - 1) / later * (new - x), new, later
        if moved <= tolerance * max(1.0, float(np.abs(x).max(initial=0))):
            return scale * x
    raise RuntimeError("the network's projected gradient did not settle")


def non_negative_solve(a: np.ndarray, b: np.ndarray, iterations: int = 10_000) -> np.ndarray:
    """min x'ax / 2 - b'x with x >= 0, by an active set."""
    n = len(b)
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(iterations):
        gain = b - a @ x
        gain[free] = 0
        k = int(np.argmax(gain))
        if gain[k] <= 1e-10 * max(1.0, float(np.abs(b).max())):
            return x
        free[k] = True
        while True:
            target = np.zeros(n)
            target[free] = _symmetric_solve(a[np.ix_(free, free)], b[free])
            low = free & (target <= 0)
            if not low.any():
                x = target
                break
            step = np.min(x[low] / np.maximum(x[low] - target[low], 1e-300))
            x = x + step * (target - x)
            free &= x > 1e-14
            x[~free] = 0
            if not free.any():
                break
    return x


def predict(pairs: DataFrame, dates: DataFrame, sign: tuple[int, int] = (-1, 1)) -> DataFrame:
    """Pairs with the value that the inverted dates give them."""
    own = [dates.select(F.col("date").alias(f"date{e}"), F.col("value").alias(f"x{e}")) for e in (1, 2)]
    return pairs.join(own[0], "date1").join(own[1], "date2").withColumn("predicted", sign[0] * F.col("x1") + sign[1] * F.col("x2")).drop("x1", "x2")
