"""The alternating decomposition: ramps over space per date, then trends over time per pixel, weights updated between."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basis import Term
from ..session import checkpoint
from . import correction, solve


@dataclass
class Alternation:
    """What the last round left: flattened cells with their model, coefficients per pixel and weights per date."""

    cells: DataFrame
    coefficients: DataFrame
    weights: DataFrame


def alternate(cube: DataFrame, terms: list[Term], dates: int, rounds: int, flat: int, estimation: Column | None = None, save=None) -> Alternation:
    """cube: pixel, line, col, date, dec, disp.

    Every round: the ramp of each date's residual to the last model goes, each
    pixel is fitted with the dates' weights, and a date's weight becomes the
    root mean square of its residuals (the true mean over all pixels).  `save`
    cuts the plan, by default with a checkpoint: of the cells once a round, and
    of the tables of a row a date or pixel.
    """
    save = save or checkpoint
    cells = cube.withColumn("model", F.lit(0.0)).withColumn("flat", F.col("disp"))
    weights = cube.select("date").distinct().withColumn("sigma", F.lit(1.0))
    coefficients = None
    for _ in range(rounds):
        residual = cells.withColumn("value", F.col("disp") - F.coalesce("model", F.lit(0.0)))
        test = F.col("value").isNotNull() & (estimation if estimation is not None else F.lit(True))
        ramp = save(correction.fit_ramps(residual.where(test), ["date"], flat))
        flattened = correction.remove_ramps(residual, ramp, ["date"]).withColumn("flat", F.col("disp") - F.col("ramp")).drop("ramp", "value", "model")
        weighted = flattened.drop("sigma").join(weights, "date")  # one row a date on the right of each join: cheaper made twice than written
        coefficients = save(solve.fit_pixels(weighted, F.col("flat"), terms, dates, sigma=F.col("sigma")))
        model = weighted.join(coefficients.drop("n", "rss"), "pixel").withColumn("model", solve.evaluate(terms))
        cells = save(model.drop(*[c for t in terms for c in (f"m_{t.name}", f"s_{t.name}")], "sigma"))
        rest = (F.col("flat") - F.col("model")) ** 2
        weights = save(cells.groupBy("date").agg(F.greatest(F.sqrt(F.avg(rest)), F.lit(1e-6)).alias("sigma")))
    return Alternation(cells, coefficients, weights)
