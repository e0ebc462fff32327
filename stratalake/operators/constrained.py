"""Bounded and constrained decompositions of series: Arrow kernels over groups of whole pixels.

A pixel's series is one array row, so a batch holds many pixels and nothing
else of the table, and these are solved together.  Bounds are solved by an active-set method, whose result is
the optimum; the phase constraint by Gauss-Newton over the remaining variables.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basis import Term


def bounded_lsq(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, iterations: int = 200) -> np.ndarray:
    """min |a x - b| with low <= x <= high."""
    n = a.shape[1]
    x = np.clip(np.linalg.lstsq(a, b, rcond=None)[0], low, high)
    free = (x > low) & (x < high)
    for _ in range(iterations):
        while free.any():
            target = x.copy()
            target[free] = np.linalg.lstsq(a[:, free], b - a[:, ~free] @ x[~free], rcond=None)[0]
            over = free & ((target < low) | (target > high))
            if not over.any():
                x = target
                break
            with np.errstate(divide="ignore", invalid="ignore"):
                reach = np.where(target > high, (high - x) / (target - x), np.where(target < low, (low - x) / (target - x), np.inf))
            reach[~over] = np.inf
            k = int(np.argmin(reach))
            x = x + min(max(float(reach[k]), 0.0), 1.0) * (target - x)
            x[k] = high[k] if target[k] > high[k] else low[k]
            free[k] = False
        gain = a.T @ (b - a @ x)
        pull = np.where(low >= high, 0.0, np.where(x <= low, gain, np.where(x >= high, -gain, 0.0)))
        pull[free] = 0.0
        k = int(np.argmax(pull)) if n else 0
        if not n or pull[k] <= 1e-10 * max(1.0, float(np.abs(gain).max())):
            return x
        free[k] = True
    return x


def same_phase(a: np.ndarray, b: np.ndarray, x: np.ndarray, seasonal: tuple[int, int], increase: tuple[int, int], iterations: int = 100) -> np.ndarray:
    """Least squares with the seasonal increase in phase with the season: its components are the season's times one factor."""
    others = [i for i in range(a.shape[1]) if i not in increase]
    s, c = seasonal
    norm = x[s] ** 2 + x[c] ** 2
    ratio = (x[increase[0]] * x[s] + x[increase[1]] * x[c]) / norm if norm > 0 else 0.0
    z = np.append(x[others], ratio)

    def full(z):
        out = np.zeros(a.shape[1])
        out[others] = z[:-1]
        out[list(increase)] = z[-1] * out[list(seasonal)]
        return out

    cost = float(((a @ full(z) - b) ** 2).sum())
    damp = 1e-6
    for _ in range(iterations):
        now = full(z)
        jac = np.column_stack([a[:, others], a[:, increase[0]] * now[s] + a[:, increase[1]] * now[c]])
        jac[:, others.index(s)] += a[:, increase[0]] * z[-1]
        jac[:, others.index(c)] += a[:, increase[1]] * z[-1]
        normal = jac.T @ jac
        step = np.linalg.lstsq(normal + damp * np.diag(np.diag(normal) + 1e-12), jac.T @ (b - a @ now), rcond=None)[0]
        trial = float(((a @ full(z + step) - b) ** 2).sum())
        if trial <= cost:
            done = cost - trial <= 1e-12 * max(cost, 1e-30)
            z, cost, damp = z + step, trial, max(damp / 10, 1e-12)
            if done:
                break
        else:
            damp *= 10
            if damp > 1e8:
                break
    return full(z)


def constrained_series(a: np.ndarray, b: np.ndarray, sigma: np.ndarray, kinds: Sequence[str]) -> np.ndarray:
    """Weighted fit with steps between 0 and their free estimate, each postseismic term of its step's sign, and seasonal increase in phase with the season."""
    aw, bw = a / sigma[:, None], b / sigma
    free = np.linalg.lstsq(aw, bw, rcond=None)[0]
    low, high = np.full(len(free), -np.inf), np.full(len(free), np.inf)
    steps = [i for i, k in enumerate(kinds) if k == "step"]
    posts = [i for i, k in enumerate(kinds) if k == "post"]
    if posts:
        without = [i for i in range(len(free)) if i not in posts]
        plain = np.zeros(len(free))
        plain[without] = np.linalg.lstsq(aw[:, without], bw, rcond=None)[0]
        for i in steps:
            low[i], high[i] = min(0.0, plain[i]), max(0.0, plain[i])
        for k, i in enumerate(posts):
            sign = plain[steps[k]] if k < len(steps) else 0.0
            if sign > 0:
                low[i] = 0.0
            elif sign < 0:
                high[i] = 0.0
    x = bounded_lsq(aw, bw, low, high)
    season, increase = ([i for i, k in enumerate(kinds) if k == name] for name in ("seasonal", "increase"))
    if len(season) == 2 and len(increase) == 2:
        x = same_phase(aw, bw, x, tuple(season), tuple(increase))
    return x


def _solve(a: np.ndarray, b: np.ndarray, rcond: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
    """Least-norm solutions of many small systems; columns that `keep` leaves out get 0. rcond counts from the largest singular value."""
    used = a if keep is None else a * keep[:, None, :]
    x = np.einsum("gij,gj->gi", np.linalg.pinv(used, rcond=rcond), b)
    return x if keep is None else np.where(keep, x, 0.0)


def same_phase_many(a: np.ndarray, b: np.ndarray, x: np.ndarray, seasonal: tuple[int, int], increase: tuple[int, int], iterations: int = 100) -> np.ndarray:
    """same_phase of many small systems at once, each with a damping and an end of its own."""
    m = a.shape[2]
    others = [i for i in range(m) if i not in increase]
    (s, c), (p, q) = seasonal, increase
    at_s, at_c = others.index(s), others.index(c)
    norm = x[:, s] ** 2 + x[:, c] ** 2
    ratio = np.where(norm > 0, (x[:, p] * x[:, s] + x[:, q] * x[:, c]) / np.where(norm > 0, norm, 1.0), 0.0)
    z = np.column_stack([x[:, others], ratio])

    def full(z):
        out = np.zeros((len(z), m))
        out[:, others] = z[:, :-1]
        out[:, p], out[:, q] = z[:, -1] * z[:, at_s], z[:, -1] * z[:, at_c]
        return out

    rest = lambda z, at: b[at] - np.einsum("gij,gj->gi", a[at], full(z))
    at = np.arange(len(a))
    cost = (rest(z, at) ** 2).sum(axis=1)
    damp = np.full(len(a), 1e-6)
    for _ in range(iterations):
        if not len(at):
            break
        zz, aa = z[at], a[at]
        jac = np.concatenate([aa[:, :, others], (aa[:, :, p] * zz[:, None, at_s] + aa[:, :, q] * zz[:, None, at_c])[:, :, None]], axis=2)
        jac[:, :, at_s] += aa[:, :, p] * zz[:, None, -1]
        jac[:, :, at_c] += aa[:, :, q] * zz[:, None, -1]
        normal = np.einsum("gri,grj->gij", jac, jac)
        diagonal = np.einsum("gii->gi", normal)
        damped = normal + (damp[at, None] * (diagonal + 1e-12))[:, :, None] * np.eye(m - 1)
        pull = np.einsum("gri,gr->gi", jac, rest(zz, at))
        try:
            step = np.linalg.solve(damped, pull[:, :, None])[:, :, 0]
        except np.linalg.LinAlgError:  # one of them is singular in spite of its damping
            step = np.einsum("gij,gj->gi", np.linalg.pinv(damped, rcond=np.finfo(float).eps * (m - 1), hermitian=True), pull)
        trial = (rest(zz + step, at) ** 2).sum(axis=1)
        better = trial <= cost[at]
        done = better & (cost[at] - trial <= 1e-12 * np.maximum(cost[at], 1e-30))
        z[at[better]] += step[better]
        cost[at[better]] = trial[better]
        damp[at] = np.where(better, np.maximum(damp[at] / 10, 1e-12), damp[at] * 10)
        at = at[~done & (damp[at] <= 1e8)]
    return full(z)


def constrained_many(a: np.ndarray, b: np.ndarray, sigma: np.ndarray, counts: np.ndarray, kinds: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """constrained_series of many series at once, and the coefficients' sigmas (NaN without spare rows); rows beyond a series' count are 0, their sigma 1.

    A series' rows go as the triangle of their decomposition, which has the same
    sums of squares in no more rows than columns.
    """
    m = len(kinds)
    triangle = np.linalg.qr(np.concatenate([a / sigma[:, :, None], (b / sigma)[:, :, None]], axis=2), mode="r")
    aw, bw = triangle[:, :, :m], triangle[:, :, m]
    rcond = np.finfo(float).eps * np.maximum(counts, m)
    free = _solve(aw, bw, rcond)
    low, high = np.full(free.shape, -np.inf), np.full(free.shape, np.inf)
    steps, posts, season, increase = ([i for i, k in enumerate(kinds) if k == name] for name in ("step", "post", "seasonal", "increase"))
    x = free.copy()
    if posts:
        keep = np.ones(free.shape, bool)
        keep[:, posts] = False
        plain = _solve(aw, bw, rcond, keep)
        for i in steps:
            low[:, i], high[:, i] = np.minimum(0.0, plain[:, i]), np.maximum(0.0, plain[:, i])
        for k, i in enumerate(posts):
            sign = plain[:, steps[k]] if k < len(steps) else np.zeros(len(free))
            low[:, i] = np.where(sign > 0, 0.0, low[:, i])
            high[:, i] = np.where(sign < 0, 0.0, high[:, i])
        for k in np.flatnonzero(((free < low) | (free > high)).any(axis=1)):  # the others are inside their bounds, which is the optimum
            own = slice(0, counts[k])
            x[k] = bounded_lsq(a[k, own] / sigma[k, own, None], b[k, own] / sigma[k, own], low[k], high[k])
    if len(season) == 2 and len(increase) == 2:
        x = same_phase_many(aw, bw, x, tuple(season), tuple(increase))
    inverse = np.linalg.pinv(np.einsum("gri,grj->gij", a, a))
    rest = ((np.einsum("gri,gi->gr", a, x) - b) ** 2).sum(axis=1)
    spare = counts - m
    with np.errstate(invalid="ignore", divide="ignore"):
        variance = np.where(spare > 0, rest / np.maximum(spare, 1), np.nan)
        return x, np.sqrt(np.maximum(variance[:, None] * np.einsum("gii->gi", inverse), 0))


#: Numbers of padded rows that are solved at a time.
CHUNK_NUMBERS = 2_000_000


def fit_constrained(obs: DataFrame, y: Column, terms: Sequence[Term], dates: int, key: str = "pixel", sigma: Column | None = None) -> DataFrame:
    """Per pixel n, m_<term> and s_<term>; pixels with no more than a sixth of the dates get nulls. One pixel's rows are one array, dates long at most."""
    row = F.array(y.cast("double"), (sigma if sigma is not None else F.lit(1.0)).cast("double"), *[t.value.cast("double") for t in terms])
    rows = obs.select(key, row.alias("row")).where(~F.exists("row", lambda v: v.isNull() | F.isnan(v)))
    series = rows.groupBy(key).agg(F.flatten(F.sort_array(F.collect_list("row"))).alias("flat"))
    width, names, kinds = len(terms) + 2, [t.name for t in terms], [t.kind for t in terms]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(pc.list_value_length(batch.column(1))) // width
            ends, flat = np.cumsum(lengths), np.asarray(batch.column(1).flatten()).reshape(-1, width)
            m = np.full((2, len(lengths), len(names)), np.nan)
            fitted = np.flatnonzero(lengths > dates / 6)
            fitted = fitted[np.argsort(lengths[fitted], kind="stable")]  # those of one length together
            while len(fitted):
                size = int(np.searchsorted(lengths[fitted], lengths[fitted[0]] + 8))
                size = max(1, min(size, CHUNK_NUMBERS // (width * int(lengths[fitted[size - 1]]))))
                own, fitted = fitted[:size], fitted[size:]
                counts = lengths[own]
                rows_ = np.zeros((len(own), int(counts.max()), width))
                rows_[:, :, 1] = 1.0
                held = np.arange(rows_.shape[1]) < counts[:, None]
                rows_[held] = flat[np.repeat(ends[own] - counts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
                m[0, own], m[1, own] = constrained_many(rows_[:, :, 2:], rows_[:, :, 0], rows_[:, :, 1], counts, kinds)
            columns = [pa.array(v.copy(), mask=np.isnan(v)) for part in m for v in part.T]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *columns], names=[key, "n", *[f"m_{n}" for n in names], *[f"s_{n}" for n in names]])

    doubles = ", ".join(f"`{p}_{n}` double" for p in "ms" for n in names)
    return series.mapInArrow(run, f"`{key}` {series.schema[key].dataType.simpleString()}, n long, {doubles}")
