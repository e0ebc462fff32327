"""Statistics of maps, bins, profiles and stacks."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import phase as P
from ..functions.basis import Term
from ..session import checkpoint
from . import solve
from .masks import beside, group_quantiles, quantiles, valid, with_bounds


def summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation, median and the 2 and 98 percentiles of the valid values."""
    v = valid(value)
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.percentile(v, 0.5).alias("median"), F.percentile(v, 0.02).alias("p2"), F.percentile(v, 0.98).alias("p98"))


def describe(grid: DataFrame, value: str = "value", zoom: Column | None = None) -> DataFrame:
    """min, max, mean, variance (n - 1), median, skewness and excess kurtosis (population forms), share of valid cells; of the map and of the zoom."""
    v = valid(value)

    def of(df: DataFrame, name: str) -> DataFrame:
        median = F.lit(quantiles(df, value, (0.5,))[0]).cast("double")
        return df.agg(
            F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"), median.alias("median"),
            F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurt"), (100.0 * F.count(v) / F.count("*")).alias("valid_percent"),
        ).select(F.lit(name).alias("part"), "*")

    main = of(grid, "main")
    return main if zoom is None else main.unionByName(of(grid.where(zoom), "zoom"))


def bin_index(x: Column, low: float, high: float, bins: int) -> Column:
    """Which of `bins` equal bins holds x, from 0; null outside [low, high)."""
    width = (high - low) / bins
    return F.when((x >= low) & (x < high), F.floor((x - F.lit(low)) / F.lit(width)).cast("int"))


def extent(df: DataFrame, x: str) -> tuple[float, float]:
    low, high = df.agg(F.min(valid(x)), F.max(valid(x))).first()
    return (low, high) if low is not None else (0.0, 0.0)


def binned_trimmed(
    df: DataFrame, x: str, y: str, bins: int = 500, min_n: int = 200, low: float = 5, high: float = 95, clean: bool = False,
    by: Sequence[str] = (), medians: Sequence[str] = (), sigma: str | None = None, stored: bool = False,
) -> DataFrame:
    """Median and deviation of y in equal bins of x with more than min_n values, of what lies strictly inside each bin's percentiles.

    One row a bin and group: bin, x, median, std, kept and, for the columns in
    `medians`, median_<column>.  Bins are numbered from 0; the last two are left
    out and a bin's x is the centre of the bin above it, as both come from
    counting the bins by their upper edges.  With `clean`, the trimmed rows
    themselves, and their `sigma` times the deviation of their bin.  `stored`: as
    in masks.quantiles.
    """
    rows = df.where(valid(y).isNotNull() & valid(x).isNotNull())
    if by:
        ends = rows.groupBy(*by).agg(F.min(x).alias("_low"), F.max(x).alias("_high"))
        placed = rows.join(beside(ends), list(by)).where("_high > _low")
    else:
        first, last = extent(rows, x)
        placed = rows.withColumns({"_low": F.lit(first).cast("double"), "_high": F.lit(last).cast("double")}).where("_high > _low")
    width = (F.col("_high") - F.col("_low")) / F.lit(bins)
    placed = placed.withColumns({"bin": F.floor((F.col(x) - F.col("_low")) / width).cast("int"), "_width": width}).where(F.col("bin") < bins - 2)
    keys = [*by, "bin"]
    bounds = group_quantiles(placed, y, (low / 100, high / 100), keys, min_n, stored).withColumnsRenamed({"n": "_n", "b": "_b"})
    trimmed = placed.join(beside(bounds), keys).where((F.col(y) > F.col("_b")[0]) & (F.col(y) < F.col("_b")[1]))
    centre = F.first(F.col("_low") + (F.col("bin") + 1.5) * F.col("_width")).alias("x")
    centred = group_quantiles(trimmed, y, (0.5,), keys, stored=stored).select(*keys, F.col("b")[0].alias("median"))
    out = trimmed.groupBy(*keys).agg(centre, F.stddev_pop(y).alias("std"), F.count("*").alias("kept"), *[F.percentile(F.col(c), 0.5).alias(f"median_{c}") for c in medians])
    out = out.join(centred, keys).select(*keys, "x", "median", "std", "kept", *[f"median_{c}" for c in medians])
    if not clean:
        return out
    told = trimmed.drop("_n", "_b", "_low", "_high", "_width").join(out.select(*keys, "median", "std"), keys)
    return told.withColumn(sigma, F.col(sigma) * F.col("std")) if sigma else told


def sliding_median(df: DataFrame, x: str, y: str, bins: int = 200, min_n: int = 2000, by: Sequence[str] = (), stored: bool = False) -> DataFrame:
    """The curve of medians of y over x: binned_trimmed between the 10 and 90 percentiles."""
    return binned_trimmed(df, x, y, bins, min_n, 10, 90, by=by, stored=stored)


def rms_by(df: DataFrame, residual: str, by: Sequence[str]) -> DataFrame:
    """Root mean square and mean square."""
    square = F.avg(valid(residual) * valid(residual))
    return df.groupBy(*by).agg(F.sqrt(square).alias("rms"), square.alias("mean_square"))


def rms_per_pixel(df: DataFrame, residual: str, dates: int, key: str = "pixel") -> DataFrame:
    """Over all dates, missing ones counting 0."""
    return df.groupBy(key).agg(F.sqrt(F.sum(F.col(residual) * F.col(residual)) / F.lit(dates)).alias("rms"))


def explained_variance(df: DataFrame, value: str, model: str, by: Sequence[str] = ()) -> DataFrame:
    """Percent of the variance that a model explains."""
    return df.groupBy(*by).agg((100 * (1 - F.try_divide(F.var_pop(F.col(value) - F.col(model)), F.var_pop(value)))).alias("explained"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlations of all pairs of columns, in whole percent, one row a pair."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"c{i}") * 100).cast("int").alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


def phase_gradient(df: DataFrame, model: str, value: str, by: Sequence[str], bins: int = 200, min_n: int = 2000) -> DataFrame:
    """Per group the line of the model over the phase, their correlation, and by how many percent the correction lowers the deviation.

    Rows count that are strictly inside the 0.5 to 99.5 percentiles of both and
    not 0 in either.  The line (gradient, offset) goes through the sliding
    median but for its first point, each point weighted by its bin's deviation;
    where fewer than two points are left, it is the plain regression of the
    rows (by_medians false).
    """
    v, m = F.col(value), F.col(model)
    rows = checkpoint(df.select(*by, value, model))
    bounded = with_bounds(with_bounds(rows, value, 0.5, 99.5, by, True).withColumnsRenamed({"lo": "_v1", "hi": "_v2"}), model, 0.5, 99.5, by, True)
    kept = bounded.where((v != 0) & (m != 0) & (v > F.col("_v1")) & (v < F.col("_v2")) & (m > F.col("lo")) & (m < F.col("hi")))
    curve = sliding_median(kept.select(*by, value, model), value, model, bins, min_n, by, True)
    later = curve.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("bin"))).where("_i > 1")
    line = solve.fit(later, F.col("median"), [Term("slope", F.col("x")), Term("offset", F.lit(1.0))], list(by), F.col("std"), 1e-7, F.col("n") > 1)
    std, rest = F.stddev_pop(value), F.stddev_pop(v - m)
    plain = kept.groupBy(*by).agg(F.regr_slope(model, value).alias("_slope"), F.regr_intercept(model, value).alias("_offset"), F.corr(value, model).alias("corr"), std.alias("std"), (100 * F.try_divide(std - rest, std)).alias("std_reduction"))
    both = plain.join(line.select(*by, "m_slope", "m_offset"), list(by), "left")
    fitted = F.col("m_slope").isNotNull()
    return both.select(*by, fitted.alias("by_medians"), F.when(fitted, F.col("m_slope")).otherwise(F.col("_slope")).alias("gradient"), F.when(fitted, F.col("m_offset")).otherwise(F.col("_offset")).alias("offset"), "corr", "std", "std_reduction")


def zonal_mean(grid: DataFrame, box: Column, value: str, by: Sequence[str] = ()) -> DataFrame:
    return grid.where(box).groupBy(*by).agg(F.avg(valid(value)).alias("mean"))


def stack_pairs(pixels: DataFrame, keys: Sequence[str] = ("line", "col"), value: str = "phase") -> DataFrame:
    """Mean over pairs of the values that aren't 0."""
    return pixels.groupBy(*keys).agg(F.avg(P.null_where(F.col(value), 0.0)).alias("stack"), F.count(P.null_where(F.col(value), 0.0)).alias("n"))


def stack_amplitude(df: DataFrame, keys: Sequence[str], amp: str) -> DataFrame:
    """Mean amplitude over dates of non-zero weight, and the mean over the deviation."""
    a = P.null_where(F.col(amp), 0.0)
    return df.groupBy(*keys).agg(F.avg(a).alias("mean"), F.try_divide(F.lit(1.0), F.stddev_pop(a)).alias("inverse_std"))


def multilook(grid: DataFrame, lines: int, cols: int, *values: str, by: Sequence[str] = ()) -> DataFrame:
    """Means of blocks of cells, missing ones left out; a block without valid cells is null."""
    block = [F.floor(F.col("line") / lines).alias("line"), F.floor(F.col("col") / cols).alias("col")]
    return grid.groupBy(*by, *block).agg(*[F.avg(valid(v)).alias(v) for v in values or ("value",)])


def fold_by_phase(df: DataFrame, dec: str, value: str, side: Column, bins: int = 12) -> DataFrame:
    """Values folded into the part of the year: median and deviation per part and side of a threshold."""
    part = F.floor(F.pmod(F.col(dec), F.lit(1.0)) * bins).cast("int")
    return df.groupBy(part.alias("part"), side.alias("above")).agg(F.percentile(valid(value), 0.5).alias("median"), F.stddev_pop(valid(value)).alias("std"), F.count(valid(value)).alias("n"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int = 50, by: Sequence[Column] = ()) -> DataFrame:
    """Counts and densities over equal bins, the last closed; by groups."""
    width = (high - low) / bins
    v = F.col(value)
    placed = df.where((v >= low) & (v <= high)).withColumn("bin", F.least(F.floor((v - low) / width), F.lit(bins - 1)).cast("int"))
    counts = placed.groupBy("bin", *by).agg(F.count("*").alias("n"))
    names = [c for c in counts.columns if c not in ("bin", "n")]
    return counts.withColumn("density", F.col("n") / (F.sum("n").over(Window.partitionBy(*names)) * F.lit(width)))


def moving_mean(df: DataFrame, value: str, half: int, by: Sequence[str], order: str) -> DataFrame:
    """Mean over the `half` rows before and half - 1 after."""
    return df.withColumn("smooth", F.avg(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-half, half - 1)))


def table_summary(stats: DataFrame, *columns: str) -> DataFrame:
    return stats.agg(*[x for c in columns for x in (F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}"))])


def highest_density(trace: DataFrame, value: str, mass: float, by: Sequence[str]) -> DataFrame:
    """The shortest interval that holds a share of the sorted values, per group."""
    ordered = Window.partitionBy(*by).orderBy(value)
    sizes = trace.groupBy(*by).agg(F.floor(F.count("*") * mass).cast("int").alias("k"))
    ranked = trace.withColumn("i", F.row_number().over(ordered)).join(sizes, list(by))
    ends = ranked.select(*by, (F.col("i") - F.col("k")).alias("i"), F.col(value).alias("high"))
    pairs = ranked.select(*by, "i", F.col(value).alias("low")).join(ends, [*by, "i"])
    best = F.min(F.struct((F.col("high") - F.col("low")).alias("width"), "low", "high"))
    return pairs.groupBy(*by).agg(best.alias("b")).select(*by, "b.low", "b.high")


def profile_bins(df: DataFrame, x: str, y: str, width: float, low: float = 2, high: float = 98) -> DataFrame:
    """Mean and deviation in bins along a profile, each bin trimmed to its percentiles."""
    placed = df.withColumn("bin", F.floor(F.col(x) / width).cast("int"))
    kept = with_bounds(placed, y, low, high, ("bin",)).where(F.col(y).between(F.col("lo"), F.col("hi")))
    return kept.groupBy("bin").agg(F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"), F.count("*").alias("n"))


def circular_median(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Median of phases taken into [0, 2 pi)."""
    return df.groupBy(*by).agg(F.percentile(F.pmod(F.col(value), F.lit(2 * math.pi)), 0.5).alias("median"))


def variogram(points: DataFrame, value: str, max_lag: float, lags: int) -> DataFrame:
    """Mean of half the squared differences by lag of pairs closer than max_lag.

    Points meet only those of their own and the neighbouring cells of a grid
    with cells of max_lag, so the pairs are those wanted and a few around.
    """
    placed = points.select(F.col("line").cast("double").alias("x"), F.col("col").cast("double").alias("y"), valid(value).alias("v")).where("v is not null")
    cell = lambda c: F.floor(F.col(c) / F.lit(float(max_lag)))
    left = placed.withColumns({"cx": cell("x"), "cy": cell("y")})
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    right = left.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("v").alias("v2"), "cx", "cy", near.alias("d")).select("x2", "y2", "v2", (F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy"))
    distance = F.sqrt((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2)
    after = (F.col("x") < F.col("x2")) | ((F.col("x") == F.col("x2")) & (F.col("y") < F.col("y2")))
    pairs = left.join(right, ["cx", "cy"]).where(after).withColumn("h", distance).where(F.col("h") < max_lag)
    half = (F.col("v") - F.col("v2")) ** 2 / 2
    return pairs.groupBy(F.floor(F.col("h") / F.lit(max_lag / lags)).cast("int").alias("lag")).agg(F.avg("h").alias("h"), F.avg(half).alias("gamma"), F.count("*").alias("n"))


def spherical(h, nugget: float, sill: float, reach: float):
    """Spherical variogram model."""
    s = np.minimum(np.asarray(h, float) / reach, 1.0)
    return nugget + sill * (1.5 * s - 0.5 * s**3)


def fit_spherical(lags: DataFrame, steps: int = 200) -> tuple[float, float, float]:
    """(nugget, sill, range) of the spherical model nearest to a variogram: for each candidate range a small linear solve. The table has a row a lag."""
    rows = np.array([(r["h"], r["gamma"], r["n"]) for r in lags.select("h", "gamma", "n").collect()], float).reshape(-1, 3)
    best = (np.inf, 0.0, 0.0, 1.0)
    for reach in np.linspace(rows[:, 0].min(), 1.5 * rows[:, 0].max(), steps):
        shape = spherical(rows[:, 0], 0.0, 1.0, reach)
        w = np.sqrt(rows[:, 2])
        for a in (np.column_stack([np.ones_like(shape), shape]), np.column_stack([np.zeros_like(shape), shape])):
            m = np.linalg.lstsq(a * w[:, None], rows[:, 1] * w, rcond=None)[0]
            if m.min() >= 0:
                best = min(best, (float((((a @ m - rows[:, 1]) * w) ** 2).sum()), float(m[0]), float(m[1]), float(reach)))
    return best[1:]
