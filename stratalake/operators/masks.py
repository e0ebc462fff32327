"""Masks, crops, referencing and cleaning.

Percentile bounds of groups are one aggregation and come back as a table of one
row a group; those of a whole map are found by histograms (`quantiles`), so that
no task holds the map's values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint


def valid(column: str | Column) -> Column:
    """Null instead of NaN."""
    return F.nanvl(F.col(column) if isinstance(column, str) else column, F.lit(None).cast("double"))


def within(low: float | None, high: float | None, column: Column) -> Column:
    """Strictly between the given limits."""
    tests = ([column > low] if low is not None else []) + ([column < high] if high is not None else [])
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def box(line_begin: int, line_end: int, col_begin: int, col_end: int) -> Column:
    """Inside a crop, its begins included and its ends not."""
    return (F.col("line") >= line_begin) & (F.col("line") < line_end) & (F.col("col") >= col_begin) & (F.col("col") < col_end)


def open_box(line_begin: int, line_end: int, col_begin: int, col_end: int) -> Column:
    return within(line_begin, line_end, F.col("line")) & within(col_begin, col_end, F.col("col"))


def estimation_rows(
    grid: DataFrame, *, elevation: tuple[float, float] | None = None, mask_above: float | None = None, rms_below: float | None = None, crop: tuple[int, int, int, int] | None = None,
    aspect: bool = False, smoothed: str | None = None,
) -> DataFrame:
    """Rows that a spatial fit of one date may see; elevation, rms and crop are open intervals."""
    test = valid("value").isNotNull()
    if elevation:
        test &= within(*elevation, F.col("elev"))
    if mask_above is not None:
        test &= F.col("mask") > mask_above
    if smoothed:
        test &= valid(smoothed).isNotNull()
    if rms_below is not None:
        test &= within(1e-6, rms_below, F.col("rms"))
    if crop:
        test &= open_box(*crop)
    if aspect:
        test &= F.col("aspect") > 0
    return grid.where(test)


#: Values that one task may sort for a percentile; more are narrowed down by histograms first.
SORTED_VALUES = 1_000_000
HISTOGRAM_BINS = 4096


def _order_statistics(rows: DataFrame, ranks: list[int], low: float, high: float, before: int, held: int) -> dict[int, float]:
    """Values at `ranks` (from 0) of the column v, which lies between low and high with `held` values, `before` of them all lower ones."""
    if low == high:
        return dict.fromkeys(ranks, low)
    if held <= SORTED_VALUES:
        shares = [(r - before) / max(held - 1, 1) for r in ranks]
        found = rows.agg(F.percentile("v", F.array(*[F.lit(s) for s in shares]))).first()[0]
        return dict(zip(ranks, found, strict=True))
    width = (high - low) / HISTOGRAM_BINS
    cell = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(HISTOGRAM_BINS - 1)) if width > 0 else F.when(F.col("v") > low, 1).otherwise(0)
    out: dict[int, float] = {}
    for r in rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("cell").collect():
        if inside := [k for k in ranks if before <= k < before + r["n"]]:
            own = rows.where((F.col("v") >= F.lit(r["low"])) & (F.col("v") <= F.lit(r["high"])))
            out |= _order_statistics(own, inside, r["low"], r["high"], before, r["n"])
        before += r["n"]
    return out


def quantiles(df: DataFrame, value: str | Column, shares: Sequence[float], stored: bool = False) -> list[float | None]:
    """Percentiles of all valid values, interpolated linearly; None for each where there are none.

    Histograms narrow the values down to those around each percentile, by equal
    bins between the least and greatest value of what is left.  The values are
    written first, since they are read several times and sums come in another
    order each time; `stored` tells that df is already a table that stays as it is.
    """
    rows = df.select(valid(value).cast("double").alias("v")).where("v is not null")
    rows = rows if stored else checkpoint(rows)
    n, low, high = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(shares)
    at = [s * (n - 1) for s in shares]
    ranks = sorted({int(k) for a in at for k in (math.floor(a), math.ceil(a))})
    found = _order_statistics(rows, ranks, low, high, 0, n)
    return [_between(found, a) for a in at]


def _between(found: dict[int, float], at: float) -> float:
    low, high = found[math.floor(at)], found[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


#: Groups whose numbers go to every task beside the rows; a table of more is joined as Spark sees fit.
FEW_GROUPS = 10_000


def beside(table: DataFrame) -> DataFrame:
    """A table of one row a group, evaluated once and, if it is small, sent to every task, so that large groups needn't meet in one."""
    table = checkpoint(table)
    return F.broadcast(table) if table.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS else table


def group_quantiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str], min_n: int = 0, stored: bool = False) -> DataFrame:
    """by, n and b, the percentiles of the valid values as `quantiles` has them, of each group with more than min_n of them.

    Groups of more than SORTED_VALUES are narrowed down by histograms, all of
    them in the same passes, so that no task holds a large group.
    """
    rows = df.select(*by, valid(value).cast("double").alias("v")).where("v is not null")
    rows = rows if stored else checkpoint(rows)
    sizes = checkpoint(rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
    same = lambda other: reduce(lambda a, b: a & b, [rows[k].eqNullSafe(other[k]) for k in by])
    large = sizes.where((F.col("n") > SORTED_VALUES) & (F.col("n") > min_n)).collect()  # one row for more than SORTED_VALUES each
    small = rows
    if large or min_n:
        wanted = sizes.where((F.col("n") > min_n) & (F.col("n") <= SORTED_VALUES)).select(*by)
        wanted = F.broadcast(wanted) if wanted.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS else wanted
        small = rows.join(wanted, same(wanted), "left_semi")
    found = small.groupBy(*by).agg(F.count("*").alias("n"), F.percentile("v", F.array(*[F.lit(s) for s in shares])).alias("b"))
    if not large:
        return found
    known = _group_order_statistics(rows, by, large, shares)
    out = [(*[r[k] for k in by], r["n"], [_between(known[i], s * (r["n"] - 1)) for s in shares]) for i, r in enumerate(large)]
    return found.unionByName(rows.sparkSession.createDataFrame(out, found.schema))


def _group_order_statistics(rows: DataFrame, by: Sequence[str], groups: list, shares: Sequence[float]) -> list[dict[int, float]]:
    """For each of the groups (by, n, low, high) the values at the ranks that its percentiles need."""
    spark, found = rows.sparkSession, [{} for _ in groups]
    keys = [rows.schema[k] for k in by]
    # What is left to search: group, ranks, least and greatest value, values before and within.
    left = [(i, sorted({int(k) for s in shares for k in (math.floor(s * (r["n"] - 1)), math.ceil(s * (r["n"] - 1)))}), r["low"], r["high"], 0, r["n"]) for i, r in enumerate(groups)]

    def placed(parts: list) -> DataFrame:
        """The rows of the parts, which are numbered."""
        schema = T.StructType([T.StructField("part", T.IntegerType()), *[T.StructField(f"_{f.name}", f.dataType) for f in keys], T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])
        table = spark.createDataFrame([(j, *[groups[p[0]][k] for k in by], p[2], p[3]) for j, p in enumerate(parts)], schema)
        test = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(table[f"_{k}"]) for k in by])
        return rows.join(F.broadcast(table), test & (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))).select("part", "low", "high", "v")

    def wanted(parts: list) -> DataFrame:
        return F.broadcast(spark.createDataFrame([(j, r - p[4]) for j, p in enumerate(parts) for r in p[1]], "part int, rank long"))

    while left:
        for i, ranks, low, high, _, _ in left:
            if low == high:
                found[i] |= dict.fromkeys(ranks, low)
        left = [p for p in left if p[2] != p[3]]
        few, many = [p for p in left if p[5] <= SORTED_VALUES], [p for p in left if p[5] > SORTED_VALUES]
        if few:
            held = placed(few).groupBy("part").agg(F.sort_array(F.collect_list("v")).alias("all"))
            for r in held.join(wanted(few), "part").select("part", "rank", F.col("all")[F.col("rank").cast("int")].alias("v")).collect():
                found[few[r["part"]][0]][r["rank"] + few[r["part"]][4]] = r["v"]
        left = []
        if many:
            width = (F.col("high") - F.col("low")) / HISTOGRAM_BINS
            cell = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("low")) / width), F.lit(HISTOGRAM_BINS - 1))).otherwise((F.col("v") > F.col("low")).cast("long"))
            cells = placed(many).groupBy("part", cell.alias("cell")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
            before = Window.partitionBy("part").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
            cells = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
            hit = cells.join(wanted(many), "part").where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
            for r in hit.groupBy("part", "cell", "low", "high", "before", "n").agg(F.sort_array(F.collect_list("rank")).alias("ranks")).collect():
                own = many[r["part"]]
                left.append((own[0], [k + own[4] for k in r["ranks"]], r["low"], r["high"], own[4] + r["before"], r["n"]))
    return found


def percentile_bounds(df: DataFrame, value: str, low: float, high: float, by: Sequence[str] = (), stored: bool = False) -> DataFrame:
    """lo and hi of the valid values, interpolated linearly, per group or over all."""
    if not by:
        return df.sparkSession.createDataFrame([tuple(quantiles(df, value, (low / 100, high / 100), stored))], "lo double, hi double")
    found = group_quantiles(df, value, (low / 100, high / 100), by, stored=stored)
    return found.select(*by, F.col("b")[0].alias("lo"), F.col("b")[1].alias("hi"))


def with_bounds(df: DataFrame, value: str, low: float, high: float, by: Sequence[str] = (), stored: bool = False) -> DataFrame:
    if by:
        return df.join(beside(percentile_bounds(df, value, low, high, by, stored)), list(by))
    df = df if stored else checkpoint(df)  # the bounds and what they are held against are of one evaluation
    lo, hi = quantiles(df, value, (low / 100, high / 100), True)
    return df.withColumn("lo", F.lit(lo).cast("double")).withColumn("hi", F.lit(hi).cast("double"))


def pair_estimation_rows(
    pixels: DataFrame, *, elevation: tuple[float, float], min_slope: float, percent: float, min_coherence: float, min_mask: float | None = None,
    crop: tuple[int, int, int, int] | None = None, excluded_lines: tuple[float, float] = (float("inf"), float("-inf")),
) -> DataFrame:
    """Rows that a pair's fit may see: also a slope and a coherence above their limits, a phase that isn't 0 and lies inside the pair's percentiles, and a line outside the excluded band."""
    found = with_bounds(pixels, "phase", 100 - percent, percent, ("date1", "date2"))
    test = within(*elevation, F.col("elev")) & (F.col("slope") > min_slope) & (valid("phase") != 0) & (F.col("phase") > F.col("lo")) & (F.col("phase") < F.col("hi")) & (F.col("coh") > min_coherence)
    if min_mask is not None:
        test &= F.col("mask") > min_mask
    if crop:
        test &= open_box(*crop)
    if excluded_lines[0] <= excluded_lines[1]:
        test &= (F.col("line") < excluded_lines[0]) | (F.col("line") > excluded_lines[1])
    return found.where(test).drop("lo", "hi")


def reference_rows(grid: DataFrame, zone: tuple[int, int, int, int], mask_above: float | None = None) -> DataFrame:
    test = open_box(*zone) & valid("value").isNotNull()
    if mask_above is not None:
        test &= F.col("mask") > mask_above
    return grid.where(test)


def clip_percentile(df: DataFrame, value: str, percent: float, by: Sequence[str] = (), outside: float | None = None) -> DataFrame:
    """Values outside the percentiles [100 - percent, percent] become null, or `outside`."""
    found = with_bounds(df, value, 100 - percent, percent, by)
    keep = (F.col(value) >= F.col("lo")) & (F.col(value) <= F.col("hi"))
    return found.withColumn(value, F.when(keep, F.col(value)).when(valid(value).isNotNull(), F.lit(outside).cast("double"))).drop("lo", "hi")


def mask_by(grid: DataFrame, mask: DataFrame, threshold: float, *, reverse: bool = False, absolute: bool = False, scale: float = 1.0, shift: float = 0.0, scale_mask: float = 1.0) -> DataFrame:
    """Null where the mask is 0 or beyond the threshold (reverse: below it); then the value less `shift`, scaled."""
    m = F.col("m") * scale_mask
    m = F.abs(m) if absolute else m
    bad = (F.col("m") == 0) | ((m < threshold) if reverse else (m > threshold))
    joined = grid.join(mask.select("line", "col", F.col("value").alias("m")), ["line", "col"], "left")
    return joined.withColumn("value", F.when(~F.coalesce(bad, F.lit(False)), scale * (F.col("value") - shift))).drop("m")


def mask_pair(pixels: DataFrame, mask: DataFrame, threshold: float) -> DataFrame:
    """Both bands 0 where the mask is above the threshold."""
    joined = pixels.join(mask.select("line", "col", F.col("value").alias("m")), ["line", "col"], "left")
    bad = F.coalesce(F.col("m") > threshold, F.lit(False))
    return joined.withColumns({band: F.when(bad, 0.0).otherwise(F.col(band)) for band in ("amp", "phase")}).drop("m")


def reference_in_time(cube: DataFrame, reference_date: int, value: str = "disp", keys: Sequence[str] = ("pixel",), date: str = "date") -> DataFrame:
    """Less the value at the reference date (none there: 0); an exact 0 at another date is missing."""
    at = cube.where(F.col(date) == reference_date).groupBy(*keys).agg(F.max(valid(value)).alias("at_reference"))
    moved = cube.join(at, list(keys), "left").withColumn(value, valid(value) - F.coalesce("at_reference", F.lit(0.0)))
    return moved.withColumn(value, F.when((F.col(date) == reference_date) | (F.col(value) != 0), F.col(value))).drop("at_reference")


def reference_in_space(cube: DataFrame, zone: Column, value: str, by: Sequence[str], weight: Column | None = None, trim: tuple[float, float] | None = None) -> DataFrame:
    """Less the (weighted) mean inside a zone, per group; with `trim`, of the values strictly inside those percentiles of the zone."""
    inside = cube.where(zone & valid(value).isNotNull())
    if trim:
        inside = with_bounds(inside, value, *trim, by=by).where(F.col(value).between(F.col("lo"), F.col("hi")))
    w = weight if weight is not None else F.lit(1.0)
    mean = inside.groupBy(*by).agg(F.try_divide(F.sum(F.col(value) * w), F.sum(w)).alias("zone_mean"))
    joined = cube.join(mean, list(by), "left")
    return joined.withColumn(value, F.col(value) - F.coalesce("zone_mean", F.lit(0.0))).drop("zone_mean")


def clean_cube(cube: DataFrame, *, percent: float, mask_below: float, crop: Column | None = None, zone: Column, demerr: bool = False, bperp_reference: float = 0.0, by: Sequence[str] = ("date",)) -> DataFrame:
    """Per date, or another key: values outside the percentiles, on masked cells or outside the region become null, then the zone's mean goes, then a DEM-error term dem (b - b_ref) / 100."""
    found = with_bounds(cube, "value", 100 - percent, percent, by)
    keep = F.col("value").between(F.col("lo"), F.col("hi")) & (F.col("mask") <= mask_below)
    if crop is not None:
        keep &= crop
    cleaned = found.withColumn("value", F.when(keep, F.col("value"))).drop("lo", "hi")
    cleaned = reference_in_space(cleaned, zone, "value", by)
    if demerr:
        cleaned = cleaned.withColumn("value", F.col("value") - F.col("dem") * (F.col("bperp") - bperp_reference) / 100)
    return cleaned


def crop(grid: DataFrame, line_begin: int, line_end: int, col_begin: int, col_end: int) -> DataFrame:
    """The rectangle, counted from its corner."""
    inside = grid.where(box(line_begin, line_end, col_begin, col_end))
    return inside.withColumn("line", F.col("line") - line_begin).withColumn("col", F.col("col") - col_begin)


def cut(grid: DataFrame, line_begin: int, line_end: int, col_begin: int, col_end: int, *bands: str) -> DataFrame:
    """0 outside the box."""
    inside = box(line_begin, line_end, col_begin, col_end)
    return grid.withColumns({b: F.when(inside, F.col(b)).otherwise(0.0) for b in bands or ("value",)})


def cells(spark, lines: int, cols: int) -> DataFrame:
    """Every cell of a grid of that shape."""
    return spark.range(lines * cols).select((F.col("id") / cols).cast("long").alias("line"), (F.col("id") % cols).alias("col"))


def extend(grid: DataFrame, lines: int, cols: int) -> DataFrame:
    """Onto a larger grid; the added cells are null."""
    return cells(grid.sparkSession, lines, cols).join(grid, ["line", "col"], "left")


def crop_tapered(grid: DataFrame, line_begin: int, line_end: int, col_begin: int, col_end: int, buffer: int) -> DataFrame:
    """Null outside the crop; within `buffer` cells of an edge, a weight that falls linearly to the edge."""
    inside = box(line_begin, line_end, col_begin, col_end)
    distance = F.least(F.col("line") - line_begin, line_end - 1 - F.col("line"), F.col("col") - col_begin, col_end - 1 - F.col("col"))
    weight = F.least(F.lit(1.0), distance / F.lit(float(buffer)))
    return grid.withColumn("value", F.when(inside, F.col("value") * weight))


def mask_cube(cube: DataFrame, mask: DataFrame, threshold: float, value: str = "disp") -> DataFrame:
    joined = cube.join(mask.select("pixel", "mask"), "pixel", "left")
    return joined.withColumn(value, F.when(F.coalesce(F.col("mask"), F.lit(0.0)) >= threshold, F.col(value))).drop("mask")


def short_image_start(grid: DataFrame, block: int = 10) -> DataFrame:
    """The first line of the lowest block of lines that has no valid value, and whether there is one; a fit of such an image takes a lower order."""
    blocks = grid.groupBy(F.floor(F.col("line") / block).alias("block")).agg(F.count(valid("value")).alias("n"))
    return blocks.agg(F.min(F.when(F.col("n") == 0, F.col("block") * block)).alias("first_empty_line")).withColumn("short", F.col("first_empty_line").isNotNull())


def subsample(df: DataFrame, step: int, order: Sequence[str] = ("line", "col"), by: Sequence[str] = ()) -> DataFrame:
    """Every step-th row in order, the first included, numbered per line and then over lines, so that no sort is in one task."""
    line = order[0]
    counts = df.groupBy(*by, line).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*by).orderBy(line).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, line, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy(*by, line).orderBy(*order[1:]))
    numbered = df.withColumn("own", own).join(starts, [*by, line])
    return numbered.where((F.col("own") - 1 + F.col("start")) % step == 0).drop("own", "start")


def clean_seasonal(coefs: DataFrame, *, max_sigma_percent: float, min_elev: float, min_amp: float, max_amp: float) -> DataFrame:
    """Amplitude and phase of cells with a small enough sigma, high enough and of an amplitude in range; phases into [0, 2 pi)."""
    found = with_bounds(coefs, "sigma", 0, max_sigma_percent)
    keep = (F.col("sigma") <= F.col("hi")) & (F.col("elev") >= min_elev) & F.col("amp").between(min_amp, max_amp)
    phi = F.pmod(F.col("phi"), F.lit(2 * 3.141592653589793))
    return found.withColumn("amp", F.when(keep, F.col("amp"))).withColumn("phi", F.when(keep, phi)).drop("lo", "hi")


def component_quality(cells_: DataFrame) -> DataFrame:
    """Components with a sigma above its 98th percentile, more than 3 times the value, or a value outside the 0.2 to 99.8 percentiles become null."""
    cells_ = checkpoint(cells_)
    (s98,), (lo, hi) = quantiles(cells_, "sigma", (0.98,), True), quantiles(cells_, "value", (0.002, 0.998), True)
    s, d = F.col("sigma"), F.col("value")
    bad = (s > F.lit(s98)) | F.coalesce(F.try_divide(s, F.abs(d)) > 3, s > 0) | (d < F.lit(lo)) | (d > F.lit(hi))
    return cells_.withColumn("value", F.when(~F.coalesce(bad, F.lit(False)), d))


def event_mask(grid: DataFrame, level: float = 0.8) -> DataFrame:
    """A mask from one date: -(|d| - level)."""
    return grid.withColumn("mask", -(F.abs("value") - level))
