"""Pair lists and acquisitions: the interferogram network as edge and node tables.

pairs: (date1, date2, ...); nodes: (date, dec, bt, bperp, ...).  Dates are ints,
decimal years doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import baseline_limit

PAIR = ["date1", "date2"]


def acquisitions(pairs: DataFrame) -> DataFrame:
    """Distinct dates of a pair list."""
    return pairs.select(F.col("date1").alias("date")).union(pairs.select("date2")).distinct()


def date_range(nodes: DataFrame, first: float | None = None, last: float | None = None) -> DataFrame:
    """Dates from the year of `first` to the end of the year of `last`, both included."""
    if first is not None:
        nodes = nodes.where(F.col("dec") >= int(first))
    if last is not None:
        nodes = nodes.where(F.col("dec") <= int(last) + 1)
    return nodes


def with_baselines(pairs: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Edges with both ends' node columns, as <column>1 and <column>2. Node tables are a row a date; Catalyst broadcasts them by size."""
    for end in (1, 2):
        own = nodes.select(F.col("date").alias(f"date{end}"), *[F.col(c).alias(f"{c}{end}") for c in columns])
        pairs = pairs.join(own, f"date{end}")
    return pairs


def temporal_baseline() -> Column:
    return F.col("dec2") - F.col("dec1")


def keep_short(pairs: DataFrame, nodes: DataFrame, days: float) -> DataFrame:
    return with_baselines(pairs, nodes, "dec").where(F.abs(temporal_baseline()) <= baseline_limit(days))


def drop_short(pairs: DataFrame, nodes: DataFrame, days: float) -> DataFrame:
    return with_baselines(pairs, nodes, "dec").where(F.abs(temporal_baseline()) >= baseline_limit(days))


def except_pairs(pairs: DataFrame, removed: DataFrame) -> DataFrame:
    return pairs.join(removed.select(*PAIR), PAIR, "left_anti")


def spanning(pairs: DataFrame, nodes: DataFrame, event: float, first: float = 1.0, last: float = 1e9) -> DataFrame:
    """Pairs with the event strictly between their dates, and both dates strictly between the limits."""
    found = with_baselines(pairs, nodes, "dec")
    return found.where((F.col("dec1") < event) & (F.col("dec2") > event) & (F.col("dec1") > first) & (F.col("dec2") < last))


def coverage(pixels: DataFrame, value: str = "phase") -> DataFrame:
    """Of each pair, the share of its cells with a value that is neither missing nor 0."""
    zero = F.coalesce(F.nanvl(F.col(value), F.lit(None).cast("double")), F.lit(0.0)) == 0
    return pixels.groupBy(*PAIR).agg((1 - F.sum(zero.cast("long")) / F.count("*")).alias("coverage"))


def split_empty(pixels: DataFrame, min_count: int = 500, value: str = "phase") -> DataFrame:
    """Each pair with its number of filled cells and whether that is below the minimum."""
    filled = F.coalesce(F.nanvl(F.col(value), F.lit(None).cast("double")), F.lit(0.0)) != 0
    return pixels.groupBy(*PAIR).agg(F.sum(filled.cast("long")).alias("filled")).withColumn("empty", F.col("filled") < min_count)


def images_per_pixel(pixels: DataFrame, nodes: DataFrame, min_years: float, value: str = "phase") -> DataFrame:
    """Per cell, how many images have a filled pair of at least the given temporal baseline; both ends of a pair count."""
    found = with_baselines(pixels.where(F.coalesce(F.col(value), F.lit(0.0)) != 0), nodes, "dec").where(F.abs(temporal_baseline()) >= min_years)
    return found.select("line", "col", F.explode(F.array("date1", "date2")).alias("date")).groupBy("line", "col").agg(F.countDistinct("date").alias("images"))


def mean_baseline_per_pixel(pixels: DataFrame, nodes: DataFrame, value: str = "phase") -> DataFrame:
    found = with_baselines(pixels.where(F.coalesce(F.col(value), F.lit(0.0)) != 0), nodes, "dec")
    return found.groupBy("line", "col").agg(F.avg(F.abs(temporal_baseline())).alias("mean_bt"))


def weights_from_sigma(pairs: DataFrame, sigmas: DataFrame) -> DataFrame:
    """Pairs with exp(-sigma) of the listed sigma."""
    return pairs.join(sigmas.select(*PAIR, "sigma"), PAIR).withColumn("weight", F.exp(-F.col("sigma")))


def weights_from_baselines(pairs: DataFrame, nodes: DataFrame, critical_years: float, critical_perp: float) -> DataFrame:
    """Half the sum of exp(-critical / baseline) in time and across track; the longer, the heavier, and 0 for none."""
    found = with_baselines(pairs, nodes, "dec", "bperp")
    time = F.coalesce(F.exp(-F.try_divide(F.lit(critical_years), F.abs(temporal_baseline()))), F.lit(0.0))
    perp = F.coalesce(F.exp(-F.try_divide(F.lit(critical_perp), F.abs(F.col("bperp2") - F.col("bperp1")))), F.lit(0.0))
    return found.withColumn("weight", (perp + time) / 2)


def succeeded(pairs: DataFrame, flag: str = "success") -> DataFrame:
    """The list for the next job: pairs whose job succeeded."""
    return pairs.where(F.col(flag))


def correction_weights(stats: DataFrame) -> DataFrame:
    """(corr + 1 - std / largest std) / 2 for each pair."""
    return stats.withColumn("weight", (F.col("corr") + 1 - F.try_divide(F.col("std"), F.max("std").over(Window.partitionBy()))) / 2)


def consecutive(nodes: DataFrame, *order: str) -> DataFrame:
    """Each date with the next one; node tables have a row a date, so one sorted window is small."""
    by_date = Window.partitionBy().orderBy(*(order or ("date",)))
    return nodes.select(F.col("date").alias("date1"), F.lead("date").over(by_date).alias("date2")).where("date2 is not null")


def bridges(lines: DataFrame) -> DataFrame:
    """lines (n, text) with `COL: c ROW: r` marks, two after each other making a bridge -> col1, row1, col2, row2."""
    number = lambda mark: F.regexp_extract("text", mark + r":\s*(-?\d+)", 1).cast("int")
    marks = lines.where(F.col("text").rlike(r"COL:\s*-?\d+.*ROW:\s*-?\d+")).select("n", number("COL").alias("col"), number("ROW").alias("row"))
    by_n = Window.partitionBy().orderBy("n")
    ranked = marks.select("*", F.row_number().over(by_n).alias("k"), F.lead("col").over(by_n).alias("col2"), F.lead("row").over(by_n).alias("row2"))
    return ranked.where("k % 2 = 1 and col2 is not null").select(F.col("col").alias("col1"), F.col("row").alias("row1"), "col2", "row2")
