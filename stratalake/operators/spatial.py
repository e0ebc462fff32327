"""Lookups between points, stations, profiles and grids.

Range conditions become equality on integer cells, so a lookup is a hash join.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .masks import valid


def window_lookup(points: DataFrame, grid: DataFrame, half: int, *, key: str = "station", value: str = "value", weight: str | None = None) -> DataFrame:
    """Mean and deviation of the valid cells in a square around each point (key, line, col); with `weight`, the mean weighted by it."""
    near = F.sequence(F.lit(-half), F.lit(half))
    reach = points.select(key, F.explode(F.transform(near, lambda d: F.col("line") + d)).alias("line"), F.col("col"))
    reach = reach.select(key, "line", F.explode(F.transform(near, lambda d: F.col("col") + d)).alias("col"))
    found = reach.join(grid.where(valid(value).isNotNull()), ["line", "col"])
    w = F.col(weight) if weight else F.lit(1.0)
    return found.groupBy(key).agg(F.try_divide(F.sum(F.col(value) * w), F.sum(w)).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").alias("n"))


#: Windows are tried in steps in which the widest grows by this factor.
GROWTH = 4


def growing_lookup(points: DataFrame, grid: DataFrame, sizes: Sequence[int], *, key: str = "station", value: str = "value") -> DataFrame:
    """The mean in the smallest of the square windows that holds a valid cell.

    Points meet the cells of the few tiles around them, and only points whose
    windows were empty so far look further, over larger tiles; a window is all
    distances up to its size.
    """
    sizes, cells = sorted(sizes), grid.where(valid(value).isNotNull()).select("line", "col", value)
    pending, found, tried = points.select(key, F.col("line").alias("l0"), F.col("col").alias("c0")), None, 0
    while tried < len(sizes):
        upto = max(tried + 1, bisect.bisect_right(sizes, GROWTH * sizes[tried]))
        step, tried = sizes[tried:upto], upto
        tile = lambda c, w=step[-1] + 1: F.floor(F.col(c) / w)
        near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("d")
        reach = pending.select(key, "l0", "c0", near).select(key, "l0", "c0", (tile("l0") + F.col("d.i")).alias("tl"), (tile("c0") + F.col("d.j")).alias("tc"))
        met = reach.join(cells.withColumns({"tl": tile("line"), "tc": tile("col")}), ["tl", "tc"])
        distance = F.greatest(F.abs(F.col("line") - F.col("l0")), F.abs(F.col("col") - F.col("c0")))
        size = F.lit(None).cast("int")
        for w in reversed(step):
            size = F.when(distance <= w, w).otherwise(size)
        sums = met.withColumn("size", size).where("size is not null").groupBy(key, "size").agg(F.sum(value).alias("total"), F.count("*").alias("n"))
        # The smallest window that holds a cell; an earlier step found none, so what is inside it is all it has.
        first = F.min(F.struct("size", (F.col("total") / F.col("n")).alias("mean"), "n"))
        done = checkpoint(sums.groupBy(key).agg(first.alias("f")).select(key, "f.size", "f.mean", "f.n"))
        found = done if found is None else found.unionByName(done)
        if tried < len(sizes):
            pending = checkpoint(pending.join(done.select(key), key, "left_anti"))
            if not pending.limit(1).count():
                break
    return found


def geo_to_cell(points: DataFrame, lookup: DataFrame, epsilon: float, steps: int = 10, key: str = "station") -> DataFrame:
    """Radar cells of points (key, lon, lat) by a lookup table (line, col, lon, lat): median line and column within the smallest of `steps` growing boxes that holds any; `far` where these spread over more than 5 cells."""
    widest = epsilon * steps
    cell = lambda c: F.floor(F.col(c) / F.lit(widest))
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("d")
    left = points.select(key, F.col("lon").alias("x"), F.col("lat").alias("y"), cell("lon").alias("cx"), cell("lat").alias("cy"), near)
    left = left.select(key, "x", "y", (F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy"))
    right = lookup.select("line", "col", "lon", "lat", cell("lon").alias("cx"), cell("lat").alias("cy"))
    distance = F.greatest(F.abs(F.col("lon") - F.col("x")), F.abs(F.col("lat") - F.col("y")))
    found = left.join(right, ["cx", "cy"]).withColumn("step", F.greatest(F.lit(1), F.ceil(distance / F.lit(epsilon)))).where(F.col("step") <= steps)
    first = found.groupBy(key).agg(F.min("step").alias("first"))
    kept = found.join(first, key).where("step = first")
    spread = F.greatest(F.max("line") - F.min("line"), F.max("col") - F.min("col"))
    return kept.groupBy(key).agg(F.percentile("line", 0.5).alias("line"), F.percentile("col", 0.5).alias("col"), F.first("first").alias("step"), (spread > 5).alias("far"))


def cell_to_geo(cells: DataFrame, lookup: DataFrame) -> DataFrame:
    return cells.join(lookup.select("line", "col", "lon", "lat"), ["line", "col"])


def rasterise(points: DataFrame, x0: float, dx: float, y0: float, dy: float, value: str = "value", coherence: str = "coh") -> DataFrame:
    """Coherence-weighted mean of the points strictly inside each cell."""
    fx, fy = (F.col("lon") - x0) / dx, (F.col("lat") - y0) / dy
    inside = (fx != F.floor(fx)) & (fy != F.floor(fy))
    placed = points.where(inside).select(F.floor(fy).alias("line"), F.floor(fx).alias("col"), value, coherence)
    return placed.groupBy("line", "col").agg(F.try_divide(F.sum(F.col(value) * F.col(coherence)), F.sum(coherence)).alias("value"), F.count("*").alias("n"))


def profile(grid: DataFrame, x0: float, y0: float, strike: float, length: float, width: float) -> DataFrame:
    """Cells of a strip centred on (x0, y0) with its along axis at `strike` degrees: x along, y across, both measured from the centre."""
    s, c = math.sin(math.radians(strike)), math.cos(math.radians(strike))
    dx, dy = F.col("col") - F.lit(x0), F.col("line") - F.lit(y0)
    along, across = dx * s + dy * c, dx * c - dy * s
    return grid.withColumns({"along": along, "across": across}).where((F.abs("across") <= width / 2) & (F.abs("along") <= length / 2))


def profile_ramp(strip: DataFrame, side: str = "all", value: str = "value", axis: str = "along") -> DataFrame:
    """The strip less a line fitted on the positive side, the negative one or all of it."""
    test = {"pos": F.col(axis) > 0, "neg": F.col(axis) < 0, "all": F.lit(True)}[side]
    fit = strip.where(test).agg(F.regr_slope(value, axis), F.regr_intercept(value, axis)).first()
    slope, offset = (0.0 if v is None else v for v in fit)
    return strip.withColumn(value, F.col(value) - (F.lit(offset) + F.lit(slope) * F.col(axis)))


def average_resample(grid: DataFrame, src: tuple[float, float, float, float], dst: tuple[float, float, float, float]) -> DataFrame:
    """Means of the source cells whose centres fall into each target cell; georeferences as (x0, dx, y0, dy)."""
    x, y = src[0] + src[1] * (F.col("col") + 0.5), src[2] + src[3] * (F.col("line") + 0.5)
    return grid.groupBy(F.floor((y - dst[2]) / dst[3]).alias("line"), F.floor((x - dst[0]) / dst[1]).alias("col")).agg(F.avg(valid("value")).alias("value"))


def bilinear_zoom(grid: DataFrame, lines: int, cols: int, factor: int) -> DataFrame:
    """The grid on `factor` times as many cells, ends matching ends, from the four neighbours of each."""
    out = grid.sparkSession.range(lines * factor * cols * factor).select((F.col("id") / (cols * factor)).cast("long").alias("line"), (F.col("id") % (cols * factor)).alias("col"))
    y, x = (F.col(c) * F.lit((n - 1) / (n * factor - 1)) for c, n in (("line", lines), ("col", cols)))
    out = out.withColumns({"y": y, "x": x}).withColumns({"l0": F.least(F.floor(y), F.lit(lines - 2)), "c0": F.least(F.floor(x), F.lit(cols - 2))})
    corners = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])).alias("d")
    spread = out.select("line", "col", "x", "y", "l0", "c0", corners)
    wy = 1 - F.abs(F.col("y") - F.col("l0") - F.col("d.i"))
    wx = 1 - F.abs(F.col("x") - F.col("c0") - F.col("d.j"))
    source = grid.select(F.col("line").alias("sl"), F.col("col").alias("sc"), "value")
    joined = spread.withColumns({"sl": F.col("l0") + F.col("d.i"), "sc": F.col("c0") + F.col("d.j"), "w": wy * wx}).join(source, ["sl", "sc"])
    return joined.groupBy("line", "col").agg(F.try_divide(F.sum(F.col("w") * F.col("value")), F.sum("w")).alias("value"))


def window_median_difference(cube: DataFrame, points: DataFrame, half: int, reference: tuple[int, int], key: str = "station") -> DataFrame:
    """Per point and date, the median in a window around it less that around a reference cell."""

    def medians(cells: DataFrame, keys: list[str]) -> DataFrame:
        near = F.sequence(F.lit(-half), F.lit(half))
        reach = cells.select(*keys, F.explode(F.transform(near, lambda d: F.col("line") + d)).alias("line"), "col")
        reach = reach.select(*keys, "line", F.explode(F.transform(near, lambda d: F.col("col") + d)).alias("col"))
        return reach.join(cube, ["line", "col"]).groupBy(*keys, "date").agg(F.percentile(valid("disp"), 0.5).alias("median"))

    at = medians(cube.sparkSession.range(1).select(F.lit(reference[0]).cast("long").alias("line"), F.lit(reference[1]).cast("long").alias("col")), []).select("date", F.col("median").alias("ref"))
    return medians(points.select(key, "line", "col"), [key]).join(at, "date").select(key, "date", (F.col("median") - F.col("ref")).alias("disp"))


def interpolate_onto(axis: DataFrame, samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Linear interpolation of samples (t, value) at the times of `axis` (t): the neighbours on both sides by a sorted window; held constant beyond the ends.

    Without keys the times are sorted in ranges, each in a task of its own; what
    lies beside a range comes from a table of one row a range.
    """
    both = samples.select(*by, "t", F.col("value").alias("v"), F.lit(0).alias("wanted")).unionByName(axis.select(*by, "t", F.lit(None).cast("double").alias("v"), F.lit(1).alias("wanted")))
    keys = list(by)
    if not by:
        both = checkpoint(both.repartitionByRange("t").withColumn("range", F.spark_partition_id()))
        known = F.when(F.col("wanted") == 0, F.struct("t", "v"))
        ends = both.groupBy("range").agg(F.min(known).alias("least"), F.max(known).alias("most"))
        order = Window.orderBy("range")  # a row a range
        before = F.last("most", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        after = F.first("least", True).over(order.rowsBetween(1, Window.unboundedFollowing))
        both = both.join(F.broadcast(ends.select("range", before.alias("before"), after.alias("after"))), "range")
        keys = ["range"]
    known = F.when(F.col("wanted") == 0, F.struct("t", "v"))
    back = Window.partitionBy(*keys).orderBy("t", "wanted").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*keys).orderBy("t", F.desc("wanted")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    a, b = F.last(known, True).over(back), F.first(known, True).over(ahead)
    if not by:
        a, b = F.coalesce(a, F.col("before")), F.coalesce(b, F.col("after"))
    held = both.withColumn("a", a).withColumn("b", b).where("wanted = 1")
    a, b = F.col("a"), F.col("b")
    value = F.when(a.isNull(), b["v"]).when(b.isNull() | (b["t"] == a["t"]), a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * (F.col("t") - a["t"]) / (b["t"] - a["t"]))
    return held.select(*by, "t", value.alias("value"))
