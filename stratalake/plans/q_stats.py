"""Queries over statistics, bins, stencils, resampling and lookups."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import masks as M
from ..operators import spatial as S
from ..operators import stats as A
from ..operators import stencil as N
from .registry import gram_sql, register, rounded


@register("a01_summary", "cube", """SELECT date, round(avg(disp), 5) AS mean, round(stddev_pop(disp), 5) AS std, round(median(disp), 5) AS median, round(quantile_cont(disp, 2e-2), 5) AS p2,
    round(quantile_cont(disp, 98e-2), 5) AS p98 FROM cube GROUP BY date""")  # fmt: skip
def _(t):
    return rounded(A.summary(t.cube, "disp", ["date"]), digits=5)


_SKEW = "(avg((value-m)*(value-m)*(value-m))/power(var_pop(value), 15e-1))"


@register("a02_describe", "grid", f"""WITH z AS (SELECT 'main' AS part, * FROM grid UNION ALL SELECT 'zoom', * FROM grid WHERE line < 5), c AS (SELECT part, avg(value) AS m FROM z GROUP BY part)
    SELECT part, round(min(value), 5) AS min, round(max(value), 5) AS max, round(avg(value), 5) AS mean, round(var_samp(value), 4) AS var, round(median(value), 5) AS median,
    round({_SKEW}, 5) AS skew, round(kurtosis_pop(value), 5) AS kurt, round(1e2*count(value)/count(*), 5) AS valid_percent FROM z JOIN c USING (part) GROUP BY part""")  # fmt: skip
def _(t):
    found = A.describe(t.grid, zoom=F.col("line") < 5)
    return rounded(rounded(found, "var", digits=4), digits=5)


def binned_sql(low: str, high: str, bins: int, n: int, source: str, by: str = "", more: str = "") -> str:
    """Common table expressions of the medians in bins of x, from `source` with x, y and the group columns: p, q and binned."""
    keys = f"{by}, " if by else ""
    joined = f"JOIN e USING ({by})" if by else ", e"
    return f"""r AS ({source}), e AS (SELECT {keys}min(x) AS low, max(x) AS high FROM r {f'GROUP BY {by}' if by else ''}),
    p AS (SELECT r.*, CAST(floor((x-low)/((high-low)/{bins})) AS INT) AS bin, low, (high-low)/{bins} AS width FROM r {joined} WHERE high > low),
    q AS (SELECT {keys}bin, quantile_cont(y, {low}) AS a, quantile_cont(y, {high}) AS b FROM p WHERE bin < {bins}-2 GROUP BY {keys}bin HAVING count(*) > {n}),
    kept AS (SELECT * FROM p JOIN q USING ({keys}bin) WHERE y > a AND y < b),
    binned AS (SELECT {keys}bin, any_value(low+(bin+15e-1)*width) AS x, median(y) AS median, stddev_pop(y) AS std, count(*) AS kept{more} FROM kept GROUP BY {keys}bin)"""


_CUBE_DEM = "SELECT elev AS x, disp AS y, line, col, pixel, date, sigma FROM cube JOIN dem USING (pixel)"


@register("a03_binned_median", "cube dem", "WITH " + binned_sql("5e-2", "95e-2", 50, 20, _CUBE_DEM, more=", median(line) AS median_line, median(col) AS median_col") +
          " SELECT bin, round(x, 5) AS x, round(median, 5) AS median, round(std, 5) AS std, kept, round(median_line, 5) AS median_line, round(median_col, 5) AS median_col FROM binned")
def _(t):
    return rounded(A.binned_trimmed(t.cube.join(t.dem, "pixel"), "elev", "disp", 50, 20, medians=("line", "col")), digits=5)


@register("a03b_cleaned_rows", "cube dem", "WITH " + binned_sql("5e-2", "95e-2", 50, 20, _CUBE_DEM) + " SELECT pixel, date, bin, round(y, 5) AS disp, round(sigma*std, 5) AS sigma FROM kept JOIN binned USING (bin)")
def _(t):
    rows = A.binned_trimmed(t.cube.join(t.dem, "pixel"), "elev", "disp", 50, 20, clean=True, sigma="sigma")
    return rounded(rows.select("pixel", "date", "bin", "disp", "sigma"), digits=5)


@register("a04_sliding_median", "cube dem", "WITH " + binned_sql("1e-1", "9e-1", 20, 50, _CUBE_DEM) + " SELECT bin, round(x, 5) AS x, round(median, 5) AS median, round(std, 5) AS std, kept FROM binned")
def _(t):
    return rounded(A.sliding_median(t.cube.join(t.dem, "pixel"), "elev", "disp", 20, 50), digits=5)


@register("a05_rms_per_date", "cube", "SELECT date, round(sqrt(avg((disp-50)*(disp-50))), 5) AS rms, round(avg((disp-50)*(disp-50)), 4) AS mean_square FROM cube GROUP BY date")
def _(t):
    found = A.rms_by(t.cube.withColumn("r", F.col("disp") - 50), "r", ["date"])
    return rounded(rounded(found, "mean_square", digits=4), digits=5)


@register("a06_rms_per_pixel", "cube", "SELECT pixel, round(sqrt(sum((disp-50)*(disp-50))/83), 5) AS rms FROM cube GROUP BY pixel")
def _(t):
    return rounded(A.rms_per_pixel(t.cube.withColumn("r", F.col("disp") - 50), "r", 83), digits=5)


@register("a07_explained_variance", "cube", "SELECT date, CASE WHEN count(*) > 1 THEN round(1e2*(1-var_pop(disp-9*sigma)/var_pop(disp)), 5) END AS explained FROM cube GROUP BY date")
def _(t):
    return rounded(A.explained_variance(t.cube.withColumn("model", 9 * F.col("sigma")), "disp", "model", ["date"]), digits=5)


@register("a08_correlations", "coefs", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b})*100)::INT AS corr FROM coefs" for i, a in enumerate(("reference", "linear", "seasonal_sin")) for b in ("reference", "linear", "seasonal_sin")[i:]))
def _(t):
    return A.correlations(t.coefs, ["reference", "linear", "seasonal_sin"])


_TRIMMED = """SELECT d.date, d.value AS x, d.model AS y FROM dates_px d JOIN (SELECT date, quantile_cont(value, 5e-3) AS v1, quantile_cont(value, 995e-3) AS v2, quantile_cont(model, 5e-3) AS m1, quantile_cont(model, 995e-3) AS m2 FROM dates_px GROUP BY date) b USING (date)
    WHERE value <> 0 AND model <> 0 AND value > v1 AND value < v2 AND model > m1 AND model < m2"""


def _gradient_of_medians(bins: int, n: int) -> str:
    return f"""WITH {binned_sql('1e-1', '9e-1', bins, n, _TRIMMED, 'date')},
    s AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY bin) AS i FROM binned), {gram_sql('s', ['date'], 'median', {'slope': 'x', 'offset': '1e0'}, '1/(std*std)', 'WHERE i > 1')},
    k AS (SELECT date, regr_slope(y, x) AS slope, regr_intercept(y, x) AS off, corr(y, x) AS corr, stddev_pop(x) AS std, stddev_pop(x-y) AS rest FROM r GROUP BY date)
    SELECT k.date, fitted.n IS NOT NULL AND fitted.n > 1 AS by_medians, round(CASE WHEN fitted.n > 1 THEN m_slope ELSE slope END, 5) AS gradient, round(CASE WHEN fitted.n > 1 THEN m_offset ELSE off END, 4) AS "offset",
    round(corr, 6) AS corr, round(std, 5) AS std, round(1e2*(std-rest)/std, 5) AS std_reduction FROM k LEFT JOIN fitted ON k.date=fitted.date"""


@register("a09_phase_gradient", "dates_px", _gradient_of_medians(10, 15))
def _(t):
    return rounded(rounded(rounded(A.phase_gradient(t.dates_px, "model", "value", ["date"], 10, 15), "corr"), "gradient", "std", "std_reduction", digits=5), "offset", digits=4)


@register("a09b_plain_gradient", "dates_px", _gradient_of_medians(200, 1000000))
def _(t):
    return rounded(rounded(rounded(A.phase_gradient(t.dates_px, "model", "value", ["date"], 200, 1000000), "corr"), "gradient", "std", "std_reduction", digits=5), "offset", digits=4)


@register("a10_zonal_mean", "points", "SELECT round(avg(value), 6) AS mean FROM points WHERE lon > 1 AND lon < 3 AND lat > 5e-1 AND lat < 2")
def _(t):
    return rounded(A.zonal_mean(t.points, M.within(1.0, 3.0, F.col("lon")) & M.within(0.5, 2.0, F.col("lat")), "value"))


@register("a11_pair_stack", "px", "SELECT line, col, round(avg(CASE WHEN phase <> 0 THEN phase END), 6) AS stack, count(CASE WHEN phase <> 0 THEN 1 END) AS n FROM px GROUP BY line, col")
def _(t):
    return rounded(A.stack_pairs(t.px))


@register("a12_amplitude_stack", "px", "SELECT line, col, round(avg(amp), 6) AS mean, CASE WHEN count(DISTINCT amp) > 1 THEN round(1/stddev_pop(amp), 6) END AS inverse_std FROM px WHERE amp <> 0 GROUP BY line, col")
def _(t):
    return rounded(A.stack_amplitude(t.px, ["line", "col"], "amp"))


@register("a13_multilook", "grid", "SELECT CAST(floor(line/4) AS BIGINT) AS line, CAST(floor(col/5) AS BIGINT) AS col, round(avg(value), 6) AS value FROM grid GROUP BY 1, 2")
def _(t):
    return rounded(A.multilook(t.grid, 4, 5))


@register("a14_fold_by_phase", "cube dem", """SELECT CAST(floor((dec-floor(dec))*12+1e-6) AS INT) AS part, slope > 25 AS above, round(median(disp), 5) AS median, round(stddev_pop(disp), 5) AS std, count(disp) AS n
    FROM cube JOIN dem USING (pixel) GROUP BY 1, 2""")  # fmt: skip
def _(t):
    rows = t.cube.join(t.dem, "pixel").withColumn("dec", F.col("dec") + 1e-6 / 12)
    return rounded(A.fold_by_phase(rows, "dec", "disp", F.col("slope") > 25), digits=5)


@register("a15_histogram", "grid", """WITH p AS (SELECT n > 8 AS side, least(floor((value-10)/(80e0/50)), 49)::INT AS bin FROM grid WHERE value >= 10 AND value <= 90),
    c AS (SELECT bin, side, count(*) AS n FROM p GROUP BY 1, 2) SELECT bin, side, n, round(n/(sum(n) OVER (PARTITION BY side)*16e-1), 6) AS density FROM c""")  # fmt: skip
def _(t):
    return rounded(A.histogram(t.grid, "value", 10, 90, 50, [(F.col("n") > 8).alias("side")]))


@register("a16_moving_mean", "cube", "SELECT pixel, date, round(avg(disp) OVER (PARTITION BY pixel ORDER BY date ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM cube")
def _(t):
    return rounded(A.moving_mean(t.cube, "disp", 3, ["pixel"], "date").select("pixel", "date", "smooth"))


@register("a17_table_summary", "pairs", "SELECT round(avg(phase), 6) AS mean_phase, round(stddev_pop(phase), 6) AS std_phase, round(avg(rms), 6) AS mean_rms, round(stddev_pop(rms), 6) AS std_rms FROM pairs")
def _(t):
    return rounded(A.table_summary(t.pairs, "phase", "rms"))


@register("a18_highest_density", "cube", """WITH r AS (SELECT pixel, disp, row_number() OVER (PARTITION BY pixel ORDER BY disp) AS i, CAST(floor(count(*) OVER (PARTITION BY pixel)*5e-1) AS INT) AS k FROM cube),
    p AS (SELECT a.pixel, a.disp AS low, b.disp AS high FROM r a JOIN r b ON a.pixel=b.pixel AND b.i=a.i+a.k)
    SELECT pixel, round(arg_min(low, (high-low, low)), 6) AS low, round(arg_min(high, (high-low, low)), 6) AS high FROM p GROUP BY pixel""")  # fmt: skip
def _(t):
    return rounded(A.highest_density(t.cube, "disp", 0.5, ["pixel"]))


@register("a19_profile_bins", "grid", """WITH p AS (SELECT CAST(floor(line/15) AS INT) AS bin, value FROM grid), b AS (SELECT bin, quantile_cont(value, 2e-2) AS lo, quantile_cont(value, 98e-2) AS hi FROM p GROUP BY bin)
    SELECT bin, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n FROM p JOIN b USING (bin) WHERE value BETWEEN lo AND hi GROUP BY bin""")  # fmt: skip
def _(t):
    return rounded(A.profile_bins(t.grid, "line", "value", 15))


@register("a20_variogram", "grid", """WITH p AS (SELECT line::DOUBLE AS x, col::DOUBLE AS y, value AS v FROM grid),
    d AS (SELECT sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS h, (a.v-b.v)*(a.v-b.v)/2 AS g FROM p a JOIN p b ON b.x BETWEEN a.x-7 AND a.x+7 AND b.y BETWEEN a.y-7 AND a.y+7 AND (a.x < b.x OR (a.x = b.x AND a.y < b.y)))
    SELECT CAST(floor(h/7e-1) AS INT) AS lag, round(avg(h), 5) AS h, round(avg(g), 4) AS gamma, count(*) AS n FROM d WHERE h < 7 GROUP BY 1""")  # fmt: skip
def _(t):
    return rounded(rounded(A.variogram(t.grid, "value", 7.0, 10), "gamma", digits=4), digits=5)


# For each of 200 ranges the two-parameter fit and the one without a nugget, of those without negative parts the nearest.
@register("a20b_spherical_model", "grid", """WITH p AS (SELECT line::DOUBLE AS x, col::DOUBLE AS y, value AS v FROM grid),
    d AS (SELECT sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS h, (a.v-b.v)*(a.v-b.v)/2 AS g FROM p a JOIN p b ON b.x BETWEEN a.x-7 AND a.x+7 AND b.y BETWEEN a.y-7 AND a.y+7 AND (a.x < b.x OR (a.x = b.x AND a.y < b.y))),
    l AS (SELECT avg(h) AS h, avg(g) AS g, count(*)::DOUBLE AS w FROM d WHERE h < 7 GROUP BY CAST(floor(h/7e-1) AS INT)), e AS (SELECT min(h) AS lo, 15e-1*max(h) AS hi FROM l),
    r AS (SELECT lo+(hi-lo)*range/199e0 AS reach FROM e, range(200)),
    s AS (SELECT reach, g, w, 15e-1*least(h/reach, 1)-5e-1*power(least(h/reach, 1), 3) AS s FROM l, r),
    n AS (SELECT reach, sum(w) AS w, sum(w*s) AS ws, sum(w*s*s) AS wss, sum(w*g) AS wg, sum(w*s*g) AS wsg, sum(w*g*g) AS wgg FROM s GROUP BY reach),
    f AS (SELECT reach, (wss*wg-ws*wsg)/(w*wss-ws*ws) AS a, (w*wsg-ws*wg)/(w*wss-ws*ws) AS b, w, ws, wss, wg, wsg, wgg FROM n UNION ALL SELECT reach, 0, wsg/wss, w, ws, wss, wg, wsg, wgg FROM n),
    c AS (SELECT reach, a, b, wgg-2*a*wg-2*b*wsg+a*a*w+2*a*b*ws+b*b*wss AS cost FROM f WHERE a >= 0 AND b >= 0)
    SELECT round(arg_min(a, cost), 4) AS nugget, round(arg_min(b, cost), 4) AS sill, round(arg_min(reach, cost), 4) AS "range" FROM c""")  # fmt: skip
def _(t):
    nugget, sill, reach = A.fit_spherical(A.variogram(t.grid, "value", 7.0, 10))
    return t.spark.createDataFrame([(round(nugget, 4), round(sill, 4), round(reach, 4))], "nugget double, sill double, range double")


@register("a21_circular_median", "grid", "SELECT line, round(median(value-floor(value/(2*pi()))*(2*pi())), 6) AS median FROM grid GROUP BY line")
def _(t):
    return rounded(A.circular_median(t.grid, "value", ["line"]))


# Geometry.
_LOOK, _HEAD = "radians(90-look)", "radians(-90-heading)"
_E, _N, _U = f"cos({_HEAD})*cos({_LOOK})", f"sin({_HEAD})*cos({_LOOK})", f"sin({_LOOK})"


@register("g01_los_vector", "frames", f"SELECT DISTINCT frame, round({_E}, 8) AS e, round({_N}, 8) AS n, round({_U}, 8) AS u FROM frames")
def _(t):
    e, n, u = G.los_vector(F.col("look"), F.col("heading"))
    return rounded(t.frames.select("frame", e.alias("e"), n.alias("n"), u.alias("u")), digits=8).distinct()


@register("g02_slope_frame", "frames dem", f"""WITH v AS (SELECT pixel, frame, {_E} AS e, {_N} AS n, {_U} AS u, radians(elev/10) AS r, radians(slope*1e0) AS s FROM frames JOIN dem USING (pixel))
    SELECT pixel, frame, round((e*cos(r)-n*sin(r))*cos(s)-u*sin(s), 6) AS c1, round(e*sin(r)+n*cos(r), 6) AS c2, round((e*cos(r)-n*sin(r))*sin(s)+u*cos(s), 6) AS c3 FROM v""")  # fmt: skip
def _(t):
    rows = t.frames.join(t.dem, "pixel")
    c = G.slope_frame(*G.los_vector(F.col("look"), F.col("heading")), F.radians(F.col("elev") / 10), F.radians(F.col("slope").cast("double")))
    return rounded(rows.select("pixel", "frame", *[x.alias(f"c{i}") for i, x in enumerate(c, 1)]))


@register("g03_enu_to_los", "stations", """SELECT station, round(ve*cos(radians(78e0))*cos(radians(56e0))+vn*sin(radians(78e0))*cos(radians(56e0))+vu*sin(radians(56e0)), 6) AS los,
    round(se*cos(radians(78e0))*cos(radians(56e0))+sn*sin(radians(78e0))*cos(radians(56e0))+su*sin(radians(56e0)), 6) AS s_linear,
    round(sqrt(power(se*cos(radians(78e0))*cos(radians(56e0)), 2)+power(sn*sin(radians(78e0))*cos(radians(56e0)), 2)+power(su*sin(radians(56e0)), 2)), 6) AS s_los FROM stations""")  # fmt: skip
def _(t):
    view = (F.lit(34.0), F.lit(-168.0))
    e, n, u, se, sn, su = (F.col(c) for c in ("ve", "vn", "vu", "se", "sn", "su"))
    return rounded(t.stations.select("station", G.enu_to_los(e, n, u, *view).alias("los"), G.enu_sigma_to_los_linear(se, sn, su, *view).alias("s_linear"), G.enu_sigma_to_los(se, sn, su, *view).alias("s_los")))


@register("g03b_enu_to_los_gamma", "stations", "SELECT station, round(ve*cos(2e-1)*cos(9e-1)+vn*sin(2e-1)*cos(9e-1)+vu*sin(9e-1), 6) AS los FROM stations")
def _(t):
    return rounded(t.stations.select("station", G.enu_to_los(F.col("ve"), F.col("vn"), F.col("vu"), F.lit(0.9), F.lit(0.2), "GAMMA").alias("los")))


@register("g04_series_to_los", "cube", "SELECT pixel, date, round(disp*cos(radians(78e0))*cos(radians(56e0))+sigma*sin(radians(78e0))*cos(radians(56e0))+(disp-sigma)*sin(radians(56e0)), 6) AS los FROM cube")
def _(t):
    los = G.enu_to_los(F.col("disp"), F.col("sigma"), F.col("disp") - F.col("sigma"), F.lit(34.0), F.lit(-168.0))
    return rounded(t.cube.select("pixel", "date", los.alias("los")))


# 40 columns and as many lines as the parts fill, at any scale.
def _dem(t):
    lines = t.dem_grid.agg(F.max("line")).first()[0] + 1
    return t.dem_grid.select("line", "col", "value"), lines


def _smooth_sql(sigma: float, normalised: bool) -> str:
    weights = N.gaussian_weights(sigma)
    radius = len(weights) // 2
    rows = ", ".join(f"({k - radius}, {w!r}::DOUBLE)" for k, w in enumerate(weights))
    mirror = lambda c, n: f"(CASE WHEN ((({c}) % (2*{n})) + 2*{n}) % (2*{n}) < {n} THEN ((({c}) % (2*{n})) + 2*{n}) % (2*{n}) ELSE 2*{n}-1-(((({c}) % (2*{n})) + 2*{n}) % (2*{n})) END)"
    value = "sum(w*x)/sum(w*ok)" if normalised else "sum(w*x)"
    return f"""WITH size AS (SELECT max(line)+1 AS nl FROM dem_grid), k(d, w) AS (VALUES {rows}), src AS (SELECT line, col, CASE WHEN slope % 7 = 0 THEN 0e0 ELSE value END AS x, CASE WHEN slope % 7 = 0 THEN 0e0 ELSE 1e0 END AS ok FROM dem_grid),
    h AS (SELECT o.line, o.col, sum(w*x) AS x, sum(w*ok) AS ok FROM dem_grid o, k JOIN src s ON s.line=o.line AND s.col={mirror('o.col+k.d', 40)} GROUP BY o.line, o.col),
    smoothed AS (SELECT o.line, o.col, {value} AS smooth FROM dem_grid o, size, k JOIN h s ON s.col=o.col AND s.line={mirror('o.line+k.d', 'nl')} GROUP BY o.line, o.col)"""  # noqa: E501


def _masked(t):
    grid, lines = t.dem_grid, None
    lines = grid.agg(F.max("line")).first()[0] + 1
    return grid.select("line", "col", F.when(F.col("slope") % 7 != 0, F.col("value")).alias("value")), lines


@register("g05_gaussian_lowpass", "dem_grid", _smooth_sql(2.0, True) + " SELECT line, col, round(smooth, 5) AS smooth FROM smoothed")
def _(t):
    grid, lines = _masked(t)
    return rounded(N.lowpass(grid, 2.0, lines, 40), digits=5)


@register("g06_highpass", "dem_grid", _smooth_sql(1.5, False) + " SELECT line, col, round(CASE WHEN slope % 7 <> 0 THEN value-smooth END, 5) AS value FROM dem_grid JOIN smoothed USING (line, col)")
def _(t):
    grid, lines = _masked(t)
    return rounded(N.highpass(grid, 1.5, lines, 40, normalise=False), digits=5)


def _gradient_sql(dx: float, dy: float) -> str:
    def part(axis, other, spacing):
        w = f"(PARTITION BY {other} ORDER BY {axis})"
        return f"CASE WHEN lag(value) OVER {w} IS NULL THEN (lead(value) OVER {w}-value)/{spacing}e0 WHEN lead(value) OVER {w} IS NULL THEN (value-lag(value) OVER {w})/{spacing}e0 ELSE (lead(value) OVER {w}-lag(value) OVER {w})/(2*{spacing}e0) END AS d_{axis}"

    return f"WITH g AS (SELECT line, col, value, {part('col', 'line', dx)}, {part('line', 'col', dy)} FROM dem_grid)"


@register("g07_slope_aspect", "dem_grid", _gradient_sql(20, 30) + " SELECT line, col, round(sqrt(d_col*d_col+d_line*d_line), 6) AS slope, round(degrees(atan2(d_line, -d_col)), 5) AS aspect FROM g")
def _(t):
    found = N.slope_aspect(t.dem_grid.select("line", "col", "value"), "value", 20.0, 30.0)
    return rounded(rounded(found.select("line", "col", "slope", "aspect"), "aspect", digits=5), "slope")


@register("g08_radar_slope", "dem_grid", _gradient_sql(8, 4) + " SELECT line, col, round(sqrt(d_col*d_col+d_line*d_line), 6) AS slope, round(d_col*sin(radians(34e0)), 6) AS los_slope FROM g")
def _(t):
    return rounded(N.radar_slope(t.dem_grid.select("line", "col", "value"), "value", 8.0, 4.0, F.lit(34.0)).select("line", "col", "slope", "los_slope"))


@register("g09_window_lookup", "stations grid", """SELECT station, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n FROM stations s JOIN grid g
    ON g.line BETWEEN s.line-2 AND s.line+2 AND g.col BETWEEN s.col-2 AND s.col+2 GROUP BY station""")  # fmt: skip
def _(t):
    return rounded(S.window_lookup(t.stations, t.grid, 2))


@register("g09b_weighted_lookup", "stations grid", """SELECT station, round(sum(value*rms)/sum(rms), 6) AS mean, count(*) AS n FROM stations s JOIN grid g
    ON g.line BETWEEN s.line-2 AND s.line+2 AND g.col BETWEEN s.col-2 AND s.col+2 GROUP BY station""")  # fmt: skip
def _(t):
    return rounded(S.window_lookup(t.stations, t.grid, 2, weight="rms").drop("std"))


@register("g10_growing_lookup", "stations grid", """WITH d AS (SELECT station, greatest(abs(g.line-s.line), abs(g.col-s.col)) AS d, value FROM stations s JOIN grid g ON g.line BETWEEN s.line-8 AND s.line+8 AND g.col BETWEEN s.col-8 AND s.col+8 WHERE n > 14),
    z AS (SELECT station, CASE WHEN min(d) <= 2 THEN 2 WHEN min(d) <= 4 THEN 4 WHEN min(d) <= 6 THEN 6 ELSE 8 END AS size FROM d GROUP BY station)
    SELECT station, size::INT AS size, round(avg(value), 6) AS mean, count(*) AS n FROM d JOIN z USING (station) WHERE d <= size GROUP BY station, size""")  # fmt: skip
def _(t):
    return rounded(S.growing_lookup(t.stations, t.grid.withColumn("value", F.when(F.col("n") > 14, F.col("value"))), (2, 4, 6, 8)))


@register("g11_geo_to_cell", "points dem_grid", """WITH l AS (SELECT line, col, col*125e-3 AS lon, line*61e-3 AS lat FROM dem_grid), d AS (
    SELECT point, l.line, l.col, greatest(1, ceil(greatest(abs(l.lon-p.lon), abs(l.lat-p.lat))/5e-2)) AS step FROM points p JOIN l ON abs(l.lon-p.lon) <= 5e-1 AND abs(l.lat-p.lat) <= 5e-1),
    f AS (SELECT point, min(step) AS s FROM d WHERE step <= 10 GROUP BY point)
    SELECT point, median(line)::DOUBLE AS line, median(col)::DOUBLE AS col, s::BIGINT AS step, greatest(max(line)-min(line), max(col)-min(col)) > 5 AS far FROM d JOIN f USING (point) WHERE step = s GROUP BY point, s""")  # fmt: skip
def _(t):
    lookup = t.dem_grid.select("line", "col", (F.col("col") * 0.125).alias("lon"), (F.col("line") * 0.061).alias("lat"))
    return S.geo_to_cell(t.points, lookup, 0.05, key="point")


@register("g12_cell_to_geo", "grid dem_grid", "SELECT line, col, round(col*125e-3, 6) AS lon, round(line*61e-3, 6) AS lat, n FROM grid JOIN (SELECT line, col FROM dem_grid) USING (line, col)")
def _(t):
    lookup = t.dem_grid.select("line", "col", (F.col("col") * 0.125).alias("lon"), (F.col("line") * 0.061).alias("lat"))
    return rounded(S.cell_to_geo(t.grid.select("line", "col", "n"), lookup).select("line", "col", "lon", "lat", "n"))


@register("g13_rasterise", "points", """WITH p AS (SELECT (lon-0)/3e-1 AS fx, (lat-0)/2e-1 AS fy, value, coh FROM points)
    SELECT CAST(floor(fy) AS BIGINT) AS line, CAST(floor(fx) AS BIGINT) AS col, round(sum(value*coh)/sum(coh), 6) AS value, count(*) AS n FROM p WHERE fx <> floor(fx) AND fy <> floor(fy) GROUP BY 1, 2""")  # fmt: skip
def _(t):
    return rounded(S.rasterise(t.points, 0.0, 0.3, 0.0, 0.2))


_STRIP = "WITH s AS (SELECT *, (col-50)*sin(radians(30e0))+(line-5)*cos(radians(30e0)) AS along, (col-50)*cos(radians(30e0))-(line-5)*sin(radians(30e0)) AS across FROM grid), k AS (SELECT * FROM s WHERE abs(across) <= 10 AND abs(along) <= 20)"


@register("g14_profile", "grid", _STRIP + " SELECT line, col, round(along, 6) AS along, round(across, 6) AS across, round(value, 6) AS value FROM k")
def _(t):
    return rounded(S.profile(t.grid, 50, 5, 30, 40, 20).select("line", "col", "along", "across", "value"))


@register("g15_average_resample", "grid", "SELECT CAST(floor(((5e1-25e-2*(line+5e-1))-6e1)/-9e-1) AS BIGINT) AS line, CAST(floor(((1e1+1e-1*(col+5e-1))-9)/7e-1) AS BIGINT) AS col, round(avg(value), 6) AS value FROM grid GROUP BY 1, 2")
def _(t):
    return rounded(S.average_resample(t.grid, (10.0, 0.1, 50.0, -0.25), (9.0, 0.7, 60.0, -0.9)))


@register("g16_bilinear_zoom", "dem_grid", """WITH z AS (SELECT max(line)+1 AS nl FROM dem_grid), o AS (SELECT a.range AS line, b.range AS col, a.range*((nl-1)/(nl*2-1)::DOUBLE) AS y, b.range*(39/79e0) AS x, nl FROM z, range(2*(SELECT max(line)+1 FROM dem_grid)) a, range(80) b),
    c AS (SELECT line, col, x, y, least(floor(y), nl-2)::BIGINT AS l0, least(floor(x), 38)::BIGINT AS c0 FROM o)
    SELECT c.line, c.col, round(sum((1-abs(y-s.line))*(1-abs(x-s.col))*value)/sum((1-abs(y-s.line))*(1-abs(x-s.col))), 5) AS value FROM c JOIN dem_grid s ON s.line BETWEEN l0 AND l0+1 AND s.col BETWEEN c0 AND c0+1 GROUP BY c.line, c.col""")  # fmt: skip
def _(t):
    grid, lines = _dem(t)
    return rounded(S.bilinear_zoom(grid, lines, 40, 2), digits=5)


@register("g18_multilook_complex", "px", """SELECT date1, date2, CAST(floor(line/4) AS BIGINT) AS line, CAST(floor(col/4) AS BIGINT) AS col, round(avg(coh*cos(phase)), 6) AS re, round(avg(coh*sin(phase)), 6) AS im FROM px GROUP BY 1, 2, 3, 4""")
def _(t):
    rows = t.px.select("date1", "date2", "line", "col", (F.col("coh") * F.cos("phase")).alias("re"), (F.col("coh") * F.sin("phase")).alias("im"))
    return rounded(A.multilook(rows, 4, 4, "re", "im", by=["date1", "date2"]))


@register("g19_neighbourhood", "grid", """SELECT a.line, a.col, round(avg(b.value), 6) AS mean, round(stddev_pop(b.value), 6) AS std, count(*) AS n FROM grid a JOIN grid b ON b.line BETWEEN a.line-1 AND a.line+1 AND b.col BETWEEN a.col-1 AND a.col+1 GROUP BY a.line, a.col""")
def _(t):
    return rounded(N.neighbourhood(t.grid, 1))


@register("g19b_block_windows", "grid", "SELECT CAST(floor(line/3) AS BIGINT) AS block_line, CAST(floor(col/3) AS BIGINT) AS block_col, count(*) AS n, round(arg_min(value, (line, col)), 6) AS first FROM grid GROUP BY 1, 2")
def _(t):
    found = N.block_windows(t.grid, 3)
    return rounded(found.select("block_line", "block_col", F.size("cells").cast("long").alias("n"), F.col("cells")[0].alias("first")))


def _utm_sql(zone: int, lon: str, lat: str) -> str:
    n = G.WGS84_F / (2 - G.WGS84_F)
    radius = G.WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    a = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    scale = f"{G.UTM_SCALE * radius!r}::DOUBLE"
    east = "+".join(f"{x!r}::DOUBLE*cos({2 * j}*xi)*sinh({2 * j}*eta)" for j, x in enumerate(a, 1))
    north = "+".join(f"{x!r}::DOUBLE*sin({2 * j}*xi)*cosh({2 * j}*eta)" for j, x in enumerate(a, 1))
    return f"""WITH p AS (SELECT point, radians({lat}) AS phi, radians({lon}-{6 * zone - 183}) AS lam FROM points),
    t AS (SELECT *, sinh(atanh(sin(phi))-{e!r}::DOUBLE*atanh({e!r}::DOUBLE*sin(phi))) AS t FROM p),
    x AS (SELECT point, atan2(t, cos(lam)) AS xi, asinh(sin(lam)/sqrt(t*t+cos(lam)*cos(lam))) AS eta FROM t)
    SELECT point, round({G.UTM_EAST}+{scale}*(eta+{east}), 3) AS east, round({scale}*(xi+{north}), 3) AS north FROM x"""


@register("g20_utm", "points", _utm_sql(46, "(lon+87)", "(lat+27)"))
def _(t):
    east, north = G.utm(F.col("lon") + 87, F.col("lat") + 27, 46)
    return rounded(t.points.select("point", east.alias("east"), north.alias("north")), digits=3)


@register("g21_window_median", "cube stations", """WITH w AS (SELECT station, date, median(disp) AS m FROM (SELECT station, station % 5 AS sl, col % 40 AS sc FROM stations) s JOIN cube c ON c.line BETWEEN sl-1 AND sl+1 AND c.col BETWEEN sc-1 AND sc+1 GROUP BY 1, 2),
    r AS (SELECT date, median(disp) AS m FROM cube WHERE line BETWEEN 1 AND 3 AND col BETWEEN 9 AND 11 GROUP BY 1)
    SELECT station, date, round(w.m-r.m, 6) AS disp FROM w JOIN r USING (date)""")  # fmt: skip
def _(t):
    points = t.stations.select("station", (F.col("station") % 5).alias("line"), (F.col("col") % 40).alias("col"))
    return rounded(S.window_median_difference(t.cube, points, 1, (2, 10)))


@register("g22_interpolate", "nodes", """WITH s AS (SELECT dec AS t, bperp AS v FROM nodes), a AS (SELECT 1995+range*75e-3 AS t FROM range(90)),
    b AS (SELECT a.t, (SELECT max(s.t) FROM s WHERE s.t <= a.t) AS t0, (SELECT min(s.t) FROM s WHERE s.t >= a.t) AS t1 FROM a)
    SELECT round(b.t, 6) AS t, round(CASE WHEN t0 IS NULL THEN y.v WHEN t1 IS NULL OR t1=t0 THEN x.v ELSE x.v+(y.v-x.v)*(b.t-t0)/(t1-t0) END, 4) AS value FROM b LEFT JOIN s x ON x.t=t0 LEFT JOIN s y ON y.t=t1""")  # fmt: skip
def _(t):
    samples = t.nodes.select(F.col("dec").alias("t"), F.col("bperp").alias("value"))
    axis = t.spark.range(90).select((1995 + F.col("id") * F.lit(0.075)).alias("t"))
    return rounded(rounded(S.interpolate_onto(axis, samples), "value", digits=4), "t")


@register("g23_moving_average", "cube", "SELECT pixel, date, round(coalesce(sum(disp) OVER (PARTITION BY pixel ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0)/5, 6) AS smooth FROM cube")
def _(t):
    return rounded(N.moving_average(t.cube, "disp", 5, ["pixel"], "date").select("pixel", "date", "smooth"))


@register("g24_savitzky_golay", "nodes", """WITH n AS (SELECT date, bperp, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS c FROM nodes), w(d, x) AS (VALUES {weights})
    SELECT a.date, round(sum(b.bperp*x), 4) AS smooth FROM n a JOIN w ON true JOIN n b ON b.i=a.i+d WHERE a.i > 10 AND a.i <= a.c-10 GROUP BY a.date""".replace(  # fmt: skip
    "{weights}", ", ".join(f"({k - 10}, {w!r}::DOUBLE)" for k, w in enumerate(N.savitzky_golay_weights(21, 3)))))
def _(t):
    from pyspark.sql import Window as W

    smooth = N.savitzky_golay(t.nodes.withColumn("all", F.lit(1)), "bperp", 21, 3, ["all"], "date")
    ranked = smooth.withColumn("i", F.row_number().over(W.partitionBy("all").orderBy("date"))).withColumn("c", F.count("*").over(W.partitionBy("all")))
    return rounded(ranked.where("i > 10 and i <= c - 10").select("date", "smooth"), digits=4)


@register("g25_grid_coordinates", "grid", "SELECT line, col, round(89.172891e0+83333e-8*col, 8) AS lon, round(27.616773e0-83333e-8*line, 8) AS lat FROM grid")
def _(t):
    return rounded(t.grid.select("line", "col", G.coordinate(F.col("col"), 89.172891, 0.00083333).alias("lon"), G.coordinate(F.col("line"), 27.616773, -0.00083333).alias("lat")), digits=8)
