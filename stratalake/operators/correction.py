"""Ramps, phase-elevation laws and atmospheric models: fitted by sums, applied as expressions.

Every correction is a fit by groups (dates or pairs, few rows) joined back to
the cells; no cell is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phase, ramps
from ..functions.basis import Term
from ..session import checkpoint
from . import solve
from .masks import valid, with_bounds
from .stats import binned_trimmed


def ramp_terms(flat: int, ivar: int = 0, nfit: int = 0, elevation: bool = False, pair: bool = False) -> list[Term]:
    names = ramps.names(flat, ivar, nfit, elevation, pair)
    return [Term(n, ramps.value(n, F.col("col"), F.col("line"), F.col("elev") if elevation else None)) for n in names]


def fit_ramps(rows: DataFrame, by: Sequence[str], flat: int, ivar: int = 0, nfit: int = 0, *, elevation: bool = False, pair: bool = False, value: str = "value", sigma: Column | None = None, min_rows: int = 0) -> DataFrame:
    """One row a group with a column for each term of the ramp; null where the group has no more than min_rows rows."""
    terms = ramp_terms(flat, ivar, nfit, elevation, pair)
    if not terms:
        return rows.select(*by).distinct()
    found = solve.fit(rows, F.col(value), terms, by, sigma, 1e-7, F.col("n") > min_rows)
    return found.select(*by, F.col("n").alias("n_rows"), *[F.col(f"m_{t.name}").alias(t.name) for t in terms])


def remove_ramps(rows: DataFrame, coefficients: DataFrame, by: Sequence[str], *, elevation: bool = False, value: str = "value") -> DataFrame:
    """Cells less their group's ramp, with coordinates counted from the same origin as in the fit."""
    names = [c for c in coefficients.columns if c in ramps.PAIR_SLOTS]
    z = F.col("elev") if elevation else None
    if not by:  # one fit over all rows: its numbers go into the plan
        row = coefficients.first()
        ramp = ramps.apply({n: F.lit(row[n] if row else None).cast("double") for n in names}, F.col("col"), F.col("line"), z)
        return rows.withColumn("ramp", ramp).withColumn(value, F.col(value) - F.col("ramp"))
    joined = rows.join(coefficients.select(*by, *[F.col(n).alias(f"_{n}") for n in names]), list(by), "left")
    ramp = ramps.apply({n: F.col(f"_{n}") for n in names}, F.col("col"), F.col("line"), z)
    return joined.withColumn("ramp", ramp).withColumn(value, F.col(value) - F.col("ramp")).drop(*[f"_{n}" for n in names])


def spatial_ramp(cells: DataFrame, estimation: Column, flat: int, ivar: int = 0, nfit: int = 0, *, elevation: bool = False, by: Sequence[str] = ("date",), value: str = "value", zone: Column | None = None, sigma: Column | None = None) -> DataFrame:
    """Per date: the ramp of the rows that pass `estimation`, taken from all rows; then the mean of the zone goes."""
    fitted = fit_ramps(cells.where(estimation), by, flat, ivar, nfit, elevation=elevation, value=value, sigma=sigma)
    out = remove_ramps(cells, fitted, by, elevation=elevation, value=value)
    if zone is not None:
        from .masks import reference_in_space

        out = reference_in_space(out, zone, value, by)
    return out


def phase_elevation(rows: DataFrame, by: Sequence[str], value: str = "value", elevation: str = "elev") -> DataFrame:
    """Plain regression of phase on elevation."""
    return rows.groupBy(*by).agg(F.regr_slope(value, elevation).alias("slope"), F.regr_intercept(value, elevation).alias("offset"), F.regr_count(value, elevation).alias("n"))


def model_correction(cells: DataFrame, mode: str, by: Sequence[str] = ("date",), *, value: str = "value", model: str = "model", min_rows: int = 0) -> DataFrame:
    """Observations less an atmospheric model and what the mode fits besides.

    cst: the difference's mean; lin: a plane of the difference; quad: a
    quadratic one; fit: slope and constant over the model; fit+quad: slope over
    the model and a quadratic ramp together.  Groups of no more than min_rows
    rows get nulls.
    """
    line, col = F.col("line").cast("double"), F.col("col").cast("double")
    one = Term("cst", F.lit(1.0))
    plane = [Term("r", col), Term("a", line)]
    square = [Term("r2", col * col), Term("a2", line * line), Term("ra", col * line)]
    terms = {"cst": [one], "lin": [*plane, one], "quad": [*square, *plane, one], "fit": [Term("model", F.col(model)), one], "fit+quad": [Term("model", F.col(model)), *square, *plane, one]}[mode]
    target = F.col(value) if mode.startswith("fit") else F.col(value) - F.col(model)
    fitted = solve.fit(cells.where(valid(value).isNotNull() & valid(model).isNotNull()), target, terms, list(by), min_rows=F.col("n") > min_rows)
    joined = cells.join(fitted.drop("n", "rss"), list(by), "left")
    rest = F.col(value) - solve.evaluate(terms) - (F.lit(0.0) if mode.startswith("fit") else F.col(model))
    return joined.withColumn("corrected", rest).drop(*[c for t in terms for c in (f"m_{t.name}", f"s_{t.name}")])


def fit_binned_model(cells: DataFrame, value: str, model: str, bins: int = 500, min_n: int = 500) -> DataFrame:
    """Slope and constant of phase over the model, from the trimmed medians of equal bins weighted by their deviation."""
    binned = binned_trimmed(cells, model, value, bins, min_n, 10, 90)
    return solve.fit(binned, F.col("median"), [Term("slope", F.col("x")), Term("offset", F.lit(1.0))], [], F.greatest(F.col("std"), F.lit(1e-6)))


def weighted_model_ramp(pixels: DataFrame, by: Sequence[str], value: str = "phase", model: str = "model", min_rows: int = 0) -> DataFrame:
    """Planar ramp of phase less model, the coherence taken as sigma: high coherence weighs less."""
    terms = [Term("r", F.col("col").cast("double")), Term("a", F.col("line").cast("double")), Term("cst", F.lit(1.0))]
    return solve.fit(pixels, F.col(value) - F.col(model), terms, list(by), F.col("coh"), min_rows=F.col("n") > min_rows)


def stratified_phase(gradients: DataFrame, degree: int, reference: float, by: Sequence[str] = (), *, value: str = "dphi", elevation: str = "elev", min_rows: int = 0) -> DataFrame:
    """Phase gradients over powers of height above a reference, weighted by coherence; degree 0 is the mean and -1 the median."""
    if degree == -1:
        return gradients.groupBy(*by).agg(F.percentile(value, 0.5).alias("m_z0"))
    dz = F.col(elevation) - F.lit(reference)
    terms = [Term(f"z{k}", F.pow(dz, F.lit(float(k))) if k else F.lit(1.0)) for k in range(degree + 1)]
    return solve.fit(gradients, F.col(value), terms, list(by), 1 / F.col("coh"), min_rows=F.col("n") > min_rows)


def flatten_stratified(waves: DataFrame, gradients: DataFrame, degree: int, reference: float, by: Sequence[str], *, elevation: str = "elev", min_rows: int = 0) -> DataFrame:
    """Complex cells (by, re, im, elevation) without the phase that follows height: `law` is taken from their phase and told beside them.

    gradients (by, dphi, elevation, coh) of phase over height give a polynomial
    of `degree` (`stratified_phase`); the law is its integral from the reference
    height.  Groups of no more than min_rows gradients keep their phase.
    """
    fitted = stratified_phase(gradients, degree, reference, by, elevation=elevation, min_rows=min_rows)
    joined = waves.join(fitted.select(*by, *[f"m_z{k}" for k in range(degree + 1)]), list(by), "left")
    dz, law = F.col(elevation) - F.lit(reference), F.lit(0.0)
    for k in range(degree + 1):
        law = law + F.coalesce(F.col(f"m_z{k}"), F.lit(0.0)) * F.pow(dz, F.lit(float(k + 1))) / (k + 1)
    told = joined.withColumn("law", law).drop(*[f"m_z{k}" for k in range(degree + 1)])
    re, im = phase.rotate(F.col("re"), F.col("im"), -F.col("law"))
    return told.withColumns({"re": re, "im": im})


def stack_ramp(stack: DataFrame, value: str = "stack") -> DataFrame:
    """A quadratic ramp of the values inside the 20 to 80 percentiles, taken from all cells."""
    stack = checkpoint(stack)
    inside = with_bounds(stack, value, 20, 80, stored=True).where(F.col(value).between(F.col("lo"), F.col("hi")))
    line, col = F.col("line").cast("double"), F.col("col").cast("double")
    terms = [Term("r2", col * col), Term("a2", line * line), Term("ra", col * line), Term("r", col), Term("a", line), Term("cst", F.lit(1.0))]
    row = solve.fit_all(inside, F.col(value), terms)
    ramp = F.lit(0.0)
    for t in terms:
        ramp = ramp + F.lit(row[f"m_{t.name}"] or 0.0) * t.value
    return stack.withColumn(value, F.col(value) - ramp)


def planar_ramp(grid: DataFrame, estimation: Column, value: str = "value", quadratic: bool = False) -> DataFrame:
    """One map less its plane (or quadratic surface) over the rows that pass."""
    line, col = F.col("line").cast("double"), F.col("col").cast("double")
    terms = ([Term("r2", col * col), Term("a2", line * line), Term("ra", col * line)] if quadratic else []) + [Term("r", col), Term("a", line), Term("cst", F.lit(1.0))]
    row = solve.fit_all(grid.where(estimation), F.col(value), terms)
    ramp = F.lit(0.0)
    for t in terms:
        ramp = ramp + F.lit(row[f"m_{t.name}"] or 0.0) * t.value
    return grid.withColumn(value, F.col(value) - ramp)


def seasonal_mode(folded: DataFrame, bins: int = 12) -> DataFrame:
    """Annual sine, cosine and constant of folded medians (part, above, median, std), per side, each weighted by its own deviation."""
    t = (F.col("part") + 0.5) / F.lit(float(bins)) * F.lit(2 * 3.141592653589793)
    terms = [Term("sin", F.sin(t)), Term("cos", F.cos(t)), Term("cst", F.lit(1.0))]
    return solve.fit(folded, F.col("median"), terms, ["above"], F.col("std"))


def tie_to_stations(grid: DataFrame, differences: DataFrame, quadratic: bool = False) -> DataFrame:
    """A map less the plane (or quadratic surface) through its differences to stations (x, y, diff, sigma); the map has x and y too."""
    x, y = F.col("x"), F.col("y")
    terms = ([Term("x2", x * x), Term("y2", y * y), Term("xy", x * y)] if quadratic else []) + [Term("x", x), Term("y", y), Term("cst", F.lit(1.0))]
    row = solve.fit_all(differences, F.col("diff"), terms, F.col("sigma"))
    ramp = F.lit(0.0)
    for t in terms:
        ramp = ramp + F.lit(row[f"m_{t.name}"] or 0.0) * t.value
    return grid.withColumn("value", F.col("value") - ramp)
