"""Raster algebra: joins of aligned rasters and expressions per cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import phase as P
from ..functions import ramps
from ..session import checkpoint
from .masks import beside, quantiles

CELL = ["line", "col"]


def scaled(df: DataFrame, value: str, factor: float, offset: float = 0.0) -> DataFrame:
    return df.withColumn(value, F.col(value) * factor + offset)


def combine(a: DataFrame, b: DataFrame, how: str, keys: Sequence[str] = CELL, zero_missing: bool = True) -> DataFrame:
    """Of two rasters (keys, value): add, subtract, amp (root of the sum of squares) or dphi (atan2); 0 is missing."""
    joined = a.select(*keys, F.col("value").alias("a")).join(b.select(*keys, F.col("value").alias("b")), list(keys))
    x, y = (P.null_where(F.col(c), *((0.0,) if zero_missing else ())) for c in "ab")
    value = {"add": x + y, "subtract": x - y, "amp": P.amplitude(x, y), "dphi": P.phase(x, y)}[how]
    return joined.select(*keys, value.alias("value"))


def shift_phase(pixels: DataFrame, model: DataFrame, sign: int, keys: Sequence[str]) -> DataFrame:
    """Pairs with a phase model added (sign 1) or removed (-1); invalid cells become 0 and the amplitude stays."""
    joined = pixels.join(model.select(*keys, F.col("value").alias("m")), list(keys), "left")
    moved = F.col("phase") + sign * F.col("m")
    bad = F.col("phase").isNull() | (F.col("phase") == 0) | F.col("m").isNull() | (moved < -10000)
    return joined.withColumn("phase", F.when(bad, 0.0).otherwise(moved)).drop("m")


def remove_model(obs: DataFrame, coefs: DataFrame, names: dict[str, Column], key: str = "pixel", value: str = "disp") -> DataFrame:
    """Observations less their model: coefficient columns of `coefs` times the given expressions; an absent coefficient counts 0."""
    joined = obs.join(coefs.select(key, *names), key, "left")
    model = F.lit(0.0)
    for name, basis in names.items():
        model = model + F.coalesce(F.col(name), F.lit(0.0)) * basis
    return joined.withColumn("model", model).withColumn(value, F.col(value) - F.col("model")).drop(*names)


def dense_model(coefs: DataFrame, names: dict[str, Column], first: float, years: float, steps: int) -> DataFrame:
    """Models on an even axis of decimal time `t`."""
    axis = F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("k")
    spread = coefs.select("*", axis).withColumn("t", F.lit(first) + F.lit(years / (steps - 1)) * F.col("k"))
    model = F.lit(0.0)
    for name, basis in names.items():
        model = model + F.col(name) * basis
    return spread.withColumn("model", model)


def apply_pair_ramps(pixels: DataFrame, coefs: DataFrame) -> DataFrame:
    """Phases less the 13-term ramp of their pair; coefs has a column for each slot."""
    joined = pixels.join(coefs.select("date1", "date2", *ramps.PAIR_SLOTS), ["date1", "date2"])
    ramp = ramps.apply({n: F.col(n) for n in ramps.PAIR_SLOTS}, F.col("col"), F.col("line"), F.col("elev"))
    return joined.withColumn("ramp", ramp).withColumn("phase", F.col("phase") - F.col("ramp")).drop(*ramps.PAIR_SLOTS)


def log_amplitude(amp: Column) -> Column:
    return F.when(amp > 0, F.log(amp))


def prepare_slc(pixels: DataFrame, mask_above: float, crop: Column, log: bool = True) -> DataFrame:
    """Complex cells (re, im, mask) for correlation: masked and cropped, their amplitude's log, put together again with the phase."""
    amp, phi = P.amplitude(F.col("re"), F.col("im")), P.phase(F.col("im"), F.col("re"))
    amp = log_amplitude(amp) if log else amp
    amp = F.when(F.col("mask") > mask_above, amp)
    return pixels.where(crop).withColumn("re_out", amp * F.cos(phi)).withColumn("im_out", amp * F.sin(phi)).withColumn("amp", amp)


def correlation_to_displacement(offsets: DataFrame, first: str, value: str, resolution: float) -> DataFrame:
    """Offsets less the median of the first image's, times the resolution."""
    offsets = checkpoint(offsets)
    (median,) = quantiles(offsets, first, (0.5,), True)
    return offsets.withColumn("displacement", (F.col(value) - F.lit(median)) * resolution)


def cutfile_weight(grid: DataFrame) -> DataFrame:
    """(grad / max 0.5 + 1 / (std + 1e-5) / 20) max, max being the largest gradient."""
    most = grid.agg(F.max("grad")).first()[0]
    return grid.withColumn("weight", (F.coalesce(F.try_divide(F.col("grad"), F.lit(most)), F.lit(0.0)) * 0.5 + 1 / (F.col("std") + 1e-5) / 20) * F.lit(most))


def zenith_to_los(delays: DataFrame, factor: float) -> DataFrame:
    """Zenith delays (date, ztd, inc in degrees) along the line of sight, in radians of phase."""
    return delays.withColumn("los", F.col("ztd") / F.cos(F.radians("inc")) * factor)


def replace_amplitude(waves: DataFrame, amplitude: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Complex cells (keys, re, im) with another raster's value as their amplitude; their phase stays, and 0 where they are 0."""
    joined = waves.join(amplitude.select(*keys, F.col("value").alias("new")), list(keys))
    size = P.amplitude(F.col("re"), F.col("im"))
    return joined.select(*keys, *[F.coalesce(F.try_divide(F.col(c), size) * F.col("new"), F.lit(0.0)).alias(c) for c in ("re", "im")])


def pair_difference(pairs: DataFrame, maps: DataFrame, value: str, keys: Sequence[str] = CELL) -> DataFrame:
    """Per pair and cell the second date's map less the first's."""
    first = maps.select(F.col("date").alias("date1"), *keys, F.col(value).alias("v1"))
    second = maps.select(F.col("date").alias("date2"), *keys, F.col(value).alias("v2"))
    joined = pairs.select("date1", "date2").join(first, "date1").join(second, ["date2", *keys])
    return joined.select("date1", "date2", *keys, (F.col("v2") - F.col("v1")).alias(value))


def loop_bias(pixels: DataFrame, loops: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Loops (loop, date1, date2, sign: 1 for the short pairs, -1 for the long one): the signed sum of phases per cell, less its mean over the loop, for each key `by`."""
    closed = loops.join(pixels, ["date1", "date2"])
    need = Window.partitionBy("loop", *by)
    sums = closed.groupBy("loop", *by, *CELL).agg(F.sum(F.col("sign") * F.col("phase")).alias("bias"), F.count("phase").alias("n"))
    sizes = loops.groupBy("loop").agg(F.count("*").alias("need"))
    whole = sums.join(sizes, "loop").where("n = need")
    return whole.withColumn("bias", F.col("bias") - F.avg("bias").over(need)).drop("n", "need")


def rescale_components(maps: DataFrame, vectors: DataFrame) -> DataFrame:
    """Component maps times the range of their time vector, and the vectors over it."""
    spans = vectors.groupBy("component").agg((F.max("value") - F.min("value")).alias("span"))
    return maps.join(beside(spans), "component").withColumn("value", F.col("value") * F.col("span")).drop("span")
