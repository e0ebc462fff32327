"""Neighbourhood operators on grids: separable kernels, gradients, windows.

A kernel pass explodes every cell to the cells that it reaches along one axis
and sums; the reach is fixed, so the rows grow by that factor only and the sums
combine before the shuffle.  Two passes make a two-dimensional kernel.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .masks import valid


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def reflect(index: Column, size: int) -> Column:
    """An index beyond an edge, mirrored with the edge cell repeated."""
    k = F.pmod(index, F.lit(2 * size))
    return F.when(k < size, k).otherwise(2 * size - 1 - k)


def _pass(df: DataFrame, axis: str, other: Sequence[str], values: Sequence[str], weights: list[float], size: int) -> DataFrame:
    """One axis of a separable kernel with mirrored edges: each cell adds to all outputs that see it, directly or in a mirror."""
    radius = len(weights) // 2
    # Output o reads o + k for k in -radius..radius; the image of o + k under reflection is the source. From source s the readers
    # are found on the extended axis: images of s there are s + 2 size m and -1 - s + 2 size m.
    images = sorted({m for m in range(-(radius // (2 * size)) - 1, radius // (2 * size) + 2)})
    held = F.array(*[F.lit(w) for w in weights])
    at = F.explode(F.array(*[e for m in images for e in (F.col(axis) + 2 * size * m, -1 - F.col(axis) + 2 * size * m)]))
    spread = df.select(*other, at.alias("e"), *values).where((F.col("e") >= -radius) & (F.col("e") < size + radius))
    first, last = F.greatest(F.lit(0).cast("long"), F.col("e") - radius), F.least(F.lit(size - 1).cast("long"), F.col("e") + radius)
    spread = spread.select(*other, F.explode(F.sequence(first, last)).alias(axis), "e", *values)
    w = F.element_at(held, (F.col("e") - F.col(axis) + radius + 1).cast("int"))
    return spread.groupBy(*other, axis).agg(*[F.sum(F.col(v) * w).alias(v) for v in values])


def convolve(grid: DataFrame, values: Sequence[str], weights: list[float], lines: int, cols: int, by: Sequence[str] = ()) -> DataFrame:
    grid = grid.select(*by, F.col("line").cast("long").alias("line"), F.col("col").cast("long").alias("col"), *values)
    across = _pass(grid, "col", [*by, "line"], values, weights, cols)
    return _pass(across, "line", [*by, "col"], values, weights, lines)


def lowpass(grid: DataFrame, sigma: float, lines: int, cols: int, *, normalise: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Gaussian mean of the valid cells, G(x) / G(valid); without `normalise` the plain G(x) with missing cells as 0. Null where the kernel sees no valid cell."""
    v = valid("value")
    full = grid.select(*by, "line", "col", F.coalesce(v, F.lit(0.0)).alias("x"), v.isNotNull().cast("double").alias("w"))
    both = convolve(full, ["x", "w"], gaussian_weights(sigma), lines, cols, by)
    out = F.when(F.col("w") > 0, F.col("x") / F.col("w")) if normalise else F.col("x")
    return both.select(*by, "line", "col", out.alias("smooth"))


def highpass(grid: DataFrame, sigma: float, lines: int, cols: int, *, normalise: bool = True, by: Sequence[str] = ()) -> DataFrame:
    smooth = lowpass(grid, sigma, lines, cols, normalise=normalise, by=by)
    return grid.join(smooth, [*by, "line", "col"]).withColumn("value", F.col("value") - F.col("smooth")).drop("smooth")


def gradient(grid: DataFrame, value: str, axis: str, other: Sequence[str], spacing: float) -> DataFrame:
    """Central differences along an axis, one-sided at its ends; the cells of a row or column follow each other."""
    order = Window.partitionBy(*other).orderBy(axis)
    before, after = F.lag(value).over(order), F.lead(value).over(order)
    v = F.col(value)
    slope = F.when(before.isNull(), (after - v) / spacing).when(after.isNull(), (v - before) / spacing).otherwise((after - before) / (2 * spacing))
    return grid.withColumn(f"d_{axis}", slope)


def slope_aspect(dem: DataFrame, value: str, dx: float, dy: float, by: Sequence[str] = ()) -> DataFrame:
    """Slope (gradient, as a fraction) and aspect (degrees) of a smoothed elevation map; spacings in metres."""
    found = gradient(gradient(dem, value, "col", [*by, "line"], dx), value, "line", [*by, "col"], dy)
    return found.withColumn("slope", F.sqrt(F.col("d_col") ** 2 + F.col("d_line") ** 2)).withColumn("aspect", F.degrees(F.atan2("d_line", -F.col("d_col"))))


def spacing_metres(step_lon: float, step_lat: float, latitude: float) -> tuple[float, float]:
    """Cell sizes of a geographic grid."""
    metre = 40075e3 / 360
    return abs(step_lon) * metre * math.cos(math.radians(latitude)), abs(step_lat) * metre


def radar_slope(dem: DataFrame, value: str, range_m: float, azimuth_m: float, look: Column) -> DataFrame:
    """In radar geometry: slope, aspect and the slope seen along the line of sight."""
    found = slope_aspect(dem, value, range_m, azimuth_m)
    return found.withColumn("los_slope", F.col("d_col") * F.sin(F.radians(look)))


def neighbourhood(grid: DataFrame, half: int, *, mean_of: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """Of each cell's (2 half + 1) square: mean, deviation and number of valid cells."""
    near = F.sequence(F.lit(-half), F.lit(half))
    reach = grid.select(*by, "line", F.col("col"), valid(mean_of).alias("v"))
    reach = reach.select(*by, F.explode(F.transform(near, lambda d: F.col("line") + d)).alias("line"), "col", "v")
    reach = reach.select(*by, "line", F.explode(F.transform(near, lambda d: F.col("col") + d)).alias("col"), "v")
    sums = reach.groupBy(*by, "line", "col").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count("v").alias("n"))
    return grid.select(*by, "line", "col").join(sums, [*by, "line", "col"])


def block_windows(grid: DataFrame, size: int, value: str = "value") -> DataFrame:
    """Non-overlapping windows: cells of a block as an array in order."""
    cells = grid.select(F.floor(F.col("line") / size).alias("block_line"), F.floor(F.col("col") / size).alias("block_col"), F.struct("line", "col", value).alias("c"))
    return cells.groupBy("block_line", "block_col").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c[value]).alias("cells"))


def moving_average(df: DataFrame, value: str, width: int, by: Sequence[str], order: str) -> DataFrame:
    """Box mean of a fixed width; beyond the ends counts 0."""
    before, after = width // 2, width - 1 - width // 2
    total = F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-before, after))
    return df.withColumn("smooth", total / F.lit(float(width)))


def savitzky_golay_weights(width: int, degree: int, at: int = 0) -> list[float]:
    """Weights of a local polynomial's value at an offset from the centre."""
    import numpy as np

    half = width // 2
    a = np.vander(np.arange(-half, half + 1), degree + 1, increasing=True).astype(float)
    return (np.vander([at], degree + 1, increasing=True).astype(float) @ np.linalg.pinv(a))[0].tolist()


def savitzky_golay(df: DataFrame, value: str, width: int, degree: int, by: Sequence[str], order: str) -> DataFrame:
    """Local polynomial smoothing of series (at least `width` rows a group); near the ends the first and last window's polynomial is evaluated."""
    half, whole = width // 2, Window.partitionBy(*by)
    ordered = whole.orderBy(order)
    window = F.collect_list(value).over(ordered.rowsBetween(-half, half))
    ranked = df.withColumn("_i", F.row_number().over(ordered)).withColumn("_n", F.count("*").over(whole))
    first = F.collect_list(value).over(ordered.rowsBetween(Window.currentRow, width - 1))
    last = F.collect_list(value).over(ordered.rowsBetween(-(width - 1), Window.currentRow))
    dot = lambda values, weights: F.aggregate(F.zip_with(values, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    held = ranked.withColumn("_w", window).withColumn("_first", first).withColumn("_last", last)
    held = held.withColumn("_head", F.first("_first").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    held = held.withColumn("_tail", F.last("_last").over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    smooth = F.when((F.col("_i") > half) & (F.col("_i") <= F.col("_n") - half), dot(F.col("_w"), savitzky_golay_weights(width, degree)))
    for k in range(half):
        smooth = smooth.when(F.col("_i") == k + 1, dot(F.col("_head"), savitzky_golay_weights(width, degree, k - half)))
        smooth = smooth.when(F.col("_i") == F.col("_n") - k, dot(F.col("_tail"), savitzky_golay_weights(width, degree, half - k)))
    return held.withColumn("smooth", smooth).drop("_i", "_n", "_w", "_first", "_last", "_head", "_tail")
