"""Queries over least squares, ramps, networks, views, components and the iterated pipeline; sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import basis as B
from ..functions import geometry as G
from ..functions import ramps as R
from ..functions.basis import Term
from ..operators import constrained, correction, factor, iterate, network, solve, views
from ..operators import masks as M
from ..operators import stats as A
from ..sources import raster, sinks
from .q_stats import binned_sql
from .registry import gram_sql, register, rounded
from .tables import Tables

T0 = 1995.0
DATES = 83
LINEAR = {"reference": "1e0", "linear": "(dec-1995e0)"}
SEASONAL = LINEAR | {"seasonal_sin": "sin(2*pi()*(dec-1995e0))", "seasonal_cos": "cos(2*pi()*(dec-1995e0))"}


def _terms(seasonal: bool = False, **more) -> list[Term]:
    return B.terms(F.col("dec"), T0, seasonal=seasonal, **more)


def _fit_sql(by: list[str], source: str, y: str, terms: dict[str, str], weight: str = "1e0", where: str = "", digits: int = 5, test: str = "") -> str:
    head = ", ".join([*by, "n", *[f"round(m_{n}, {digits}) AS m_{n}" for n in terms]])
    return f"WITH {gram_sql(source, by, y, terms, weight, where)} SELECT {head} FROM fitted {test}"


def _coefs(df, by, terms, digits=5):
    return rounded(df.select(*by, "n", *[f"m_{t.name}" for t in terms]), digits=digits)


def _enough(by: list[str], terms, least: int, digits: int = 5) -> str:
    """Columns of fits that are null where a group has no more than `least` rows."""
    return ", ".join([*by, "n", *[f"CASE WHEN n > {least} THEN round(m_{n}, {digits}) END AS m_{n}" for n in terms]])


@register("v01_weighted_lsq", "cube", f"WITH {gram_sql('cube', ['date'], 'disp', {'cst': '1e0', 'r': 'col', 'a': 'line'}, '1/(sigma*sigma)')} SELECT {_enough(['date'], ['cst', 'r', 'a'], 10)} FROM fitted")
def _(t):
    terms = [Term("cst", F.lit(1.0)), Term("r", F.col("col")), Term("a", F.col("line"))]
    return _coefs(solve.fit(t.cube, F.col("disp"), terms, ["date"], F.col("sigma"), min_rows=F.col("n") > 10), ["date"], terms)


@register("v02_pixel_decomp", "cube", _fit_sql(["pixel"], "cube", "disp", SEASONAL, "1/(sigma*sigma)", digits=4, test=f"WHERE n > {DATES}/6e0"))
def _(t):
    terms = _terms(seasonal=True)
    found = solve.fit_pixels(t.cube, F.col("disp"), terms, DATES, sigma=F.col("sigma"))
    return _coefs(found.where("m_reference is not null"), ["pixel"], terms, digits=4)


@register("v02b_forward_model", "cube", f"WITH {gram_sql('cube', ['pixel'], 'disp', LINEAR)} SELECT pixel, date, round(m_reference+m_linear*(dec-1995e0), 4) AS model FROM cube JOIN fitted USING (pixel) WHERE n > {DATES}/6e0")
def _(t):
    terms = _terms()
    found = solve.fit_pixels(t.cube, F.col("disp"), terms, DATES).where("m_reference is not null").drop("n", "rss")
    return rounded(t.cube.join(found, "pixel").select("pixel", "date", solve.evaluate(terms).alias("model")), digits=4)


@register("v03_bounded_decomp")
def _(t):
    terms = _terms(steps=[1998.0], postseismic_terms=[(1998.0, 0.5)])
    found = constrained.fit_constrained(t.cube, F.col("disp"), terms, DATES, sigma=F.col("sigma"))
    return rounded(found, digits=5)


@register("v04_phase_constrained_decomp")
def _(t):
    terms = _terms(seasonal=True, seasonal_increase=True)
    return rounded(constrained.fit_constrained(t.cube, F.col("disp"), terms, DATES), digits=4)


@register("v05_coefficient_sigma", "cube", """WITH s AS (SELECT pixel, count(*) AS n, regr_slope(disp, dec-1995e0) AS b, regr_sxx(disp, dec-1995e0) AS sxx, regr_syy(disp, dec-1995e0) AS syy, regr_sxy(disp, dec-1995e0) AS sxy, avg(dec-1995e0) AS mx FROM cube GROUP BY pixel),
    v AS (SELECT *, greatest(syy-sxy*sxy/sxx, 0)/(n-2) AS s2 FROM s WHERE n > 14)
    SELECT pixel, round(b, 5) AS m_linear, round(sqrt(s2/sxx), 5) AS s_linear, round(sqrt(s2*(1e0/n+mx*mx/sxx)), 5) AS s_reference FROM v""")  # fmt: skip
def _(t):
    found = solve.fit_pixels(t.cube, F.col("disp"), _terms(), DATES).where("n > 14")
    return rounded(found.select("pixel", "m_linear", "s_linear", "s_reference"), digits=5)


@register("v06_truncated_svd", "cube", "SELECT pixel, count(*) AS n, round(regr_intercept(disp, dec-1995e0), 4) AS m_cst, round(regr_slope(disp, dec)/5, 4) AS m_x, round(2*regr_slope(disp, dec)/5, 4) AS m_x2 FROM cube GROUP BY pixel HAVING count(*) > 14")
def _(t):
    # The third term doubles the second: the cut leaves the shortest of the solutions, in which they share the slope by 1 to 2.
    x = F.col("dec") - F.lit(T0)
    terms = [Term("cst", F.lit(1.0)), Term("x", x), Term("x2", 2 * x)]
    found = solve.fit_truncated(t.cube, F.col("disp"), terms, ["pixel"], 1e-4)
    return rounded(found.where("n > 14").select("pixel", "n", "m_cst", "m_x", "m_x2"), digits=4)


# Powers of coordinates are scaled in the SQL, whose elimination doesn't pivot; that changes no ramp.
_PLACES = {"cst": "1e0", "r": "(col/5e1)", "r2": "power(col/5e1, 2)", "a": "(line/1e2)", "a2": "power(line/1e2, 2)", "a3": "power(line/1e2, 3)", "ra": "(col*line/5e3)", "ra2": "power(col*line/5e3, 2)"}
#: Heights in the SQL are in units of these.
_HEIGHT = {"dates_px": "1e0", "px": "1e3"}
#: A group's ramp is fitted to more rows than this.
_RAMP_ROWS = 40
#: Elevation terms or none, ivar and nfit: with the order they make a design.
_FORMS = [(False, 0, 0), (True, 0, 0), (True, 0, 1), (True, 1, 0), (True, 1, 1)]


def _ramp_query(flat: int, by: list[str], source: str, y: str, pair: bool, weight: str = "1e0", where: str = "") -> str:
    """All forms of an order: rows, deviation and mean of what the ramp takes, by group."""
    keys, steps, parts = ", ".join(by), [], []
    for k, (elevation, ivar, nfit) in enumerate(_FORMS):
        names = R.names(flat, ivar, nfit, elevation, pair)
        head = f"SELECT {elevation} AS elevation, {ivar} AS ivar, {nfit} AS nfit, {keys}, count(*) AS n"
        if not names:
            parts.append(f"{head}, round(sqrt(avg({y}*{y})), {3 if pair else 4}) AS rms, round(0e0, 4) AS mean_ramp FROM {source} {where} GROUP BY {keys}")
            continue
        z = f"(elev/{_HEIGHT[source]})"
        if "az2" not in names and ("a" in names or "az" not in names):  # then moving the heights' origin changes no ramp either
            z = f"({z}-1e0)"
        places = _PLACES | {"z": z, "z2": f"power({z}, 2)", "az": f"(line/1e2*{z})", "az2": f"power(line/1e2*{z}, 2)"}
        steps.append(gram_sql(source, by, y, {n: places[n] for n in names}, weight, where, f"f{k}_"))
        ramp = "(" + " + ".join(f"m_{n}*{places[n]}" for n in names) + ")"
        enough, digits = f"CASE WHEN any_value(n) > {_RAMP_ROWS} THEN round", 3 if pair else 4
        parts.append(f"{head}, {enough}(sqrt(avg(power({y}-{ramp}, 2))), {digits}) END AS rms, {enough}(avg({ramp}), {digits}) END AS mean_ramp FROM {source} JOIN f{k}_fitted USING ({keys}) {where} GROUP BY {keys}")
    return f"WITH {', '.join(steps)} {' UNION ALL '.join(parts)}"


def _ramps(rows, flat: int, by: list[str], pair: bool, value: str, sigma=None):
    out = None
    for elevation, ivar, nfit in _FORMS:
        fitted = correction.fit_ramps(rows, by, flat, ivar, nfit, elevation=elevation, pair=pair, value=value, sigma=sigma, min_rows=_RAMP_ROWS)
        known = fitted.where(f"n_rows > {_RAMP_ROWS}") if "n_rows" in fitted.columns else fitted
        back = correction.remove_ramps(rows, fitted, by, elevation=elevation, value=value)
        done = back.groupBy(*by).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col(value) ** 2)).alias("rms"), F.avg("ramp").alias("mean_ramp")).join(known.select(*by, F.lit(True).alias("known")), by, "left")
        done = done.select(F.lit(elevation).alias("elevation"), F.lit(ivar).alias("ivar"), F.lit(nfit).alias("nfit"), *by, "n", *[F.when(F.col("known"), F.col(c)).alias(c) for c in ("rms", "mean_ramp")])
        out = done if out is None else out.unionByName(done)
    return rounded(out, digits=3 if pair else 4)


# Ramps of every order in all their forms, by frame and date and, fitted to pairs with their coherence, by first date.
for _flat in R.ORDERS:
    register(f"v07_ramp_{_flat}", "dates_px", _ramp_query(_flat, ["frame", "date"], "dates_px", "value", False))(lambda t, flat=_flat: _ramps(t.dates_px, flat, ["frame", "date"], False, "value"))

for _flat in R.PAIR_ORDERS:
    register(f"v07b_pair_ramp_{_flat}", "px", _ramp_query(_flat, ["date1"], "px", "phase", True, "1/(coh*coh)", "WHERE phase <> 0"))(
        lambda t, flat=_flat: _ramps(t.px.where("phase <> 0"), flat, ["date1"], True, "phase", F.col("coh"))
    )


def _network_sql(weight: str, value: str, sign: int, rounds: int, result: str) -> str:
    """A network's dates by damped rounds of one equation a date, from 0: sign -1 for differences, 1 for sums without negative values."""
    step = f"x + ({{b}} - ({{d}}*x {'+' if sign > 0 else '-'} {{o}}))/(2*{{d}})"
    step = step.format(b="b", d="d", o="o")
    return f"""WITH RECURSIVE p AS (SELECT date1, date2, {weight} AS w, {value} AS v FROM pairs), e AS MATERIALIZED (SELECT date1 AS i, date2 AS j, w, {sign}*w*v AS wv FROM p UNION ALL SELECT date2, date1, w, w*v FROM p),
    g AS MATERIALIZED (SELECT i, sum(w) AS d, sum(wv) AS b FROM e GROUP BY i),
    it AS (SELECT 0 AS k, i, 0e0 AS x FROM g UNION ALL SELECT k, i, {'greatest(0, ' + step + ')' if sign > 0 else step} FROM (
        SELECT it.k+1 AS k, g.i, any_value(g.b) AS b, any_value(g.d) AS d, sum(e.w*it.x) AS o, max(CASE WHEN it.i=g.i THEN it.x END) AS x FROM it JOIN (SELECT * FROM e UNION ALL SELECT i, i, 0e0, 0e0 FROM g) e ON e.j=it.i JOIN g ON g.i=e.i WHERE it.k < {rounds} GROUP BY it.k, g.i)),
    z AS (SELECT i AS date, x FROM it WHERE k={rounds}) {result}"""


_PINNED = "SELECT date, round(x-(SELECT arg_min(x, date) FROM z), 5) AS value, (SELECT min(date) FROM z) AS part FROM z"
_SIGMA = "1/exp(-((date2-date1)/1e2)/2)"


@register("v08_network_closure", "pairs", _network_sql(f"1/power({_SIGMA}+1/(n/1e1)+1/(exp(-rms/(SELECT quantile_cont(rms, 8e-1) FROM pairs))+1e-2), 2)", "phase", -1, 400, _PINNED))
def _(t):
    weighted = t.pairs.withColumn("bt", (F.col("date2") - F.col("date1")) / 100)
    (p80,) = M.quantiles(t.pairs, "rms", (0.8,))
    sigma = network.pair_weights(bt_years=F.col("bt"), length=F.col("n").cast("double"), lines=10, rms=F.col("rms"), rms_p80=p80)
    return rounded(network.invert(weighted, "phase", sigma), digits=5)


@register("v09_unweighted_closure", "nodes", "SELECT date, round(bperp-(SELECT arg_min(bperp, date) FROM nodes), 4) AS value FROM nodes")
def _(t):
    # Consistent pairs: the inversion gives back what they were made from.
    n = t.nodes.select("date", "bperp")
    a, b = n.select(F.col("date").alias("date1"), F.col("bperp").alias("b1")), n.select(F.col("date").alias("date2"), F.col("bperp").alias("b2"))
    pairs = t.pairs.select("date1", "date2").join(a, "date1").join(b, "date2").withColumn("d", F.col("b2") - F.col("b1"))
    back = network.invert(pairs, "d")
    last = t.nodes.join(back, "date")
    first = last.agg(F.min_by("value", "date")).first()[0]
    return rounded(last.select("date", (F.col("value") - F.lit(first)).alias("value")), digits=4)


@register("v10_variance_split", "pairs", _network_sql("1e0", "rms*rms", 1, 400, "SELECT date, round(x, 6) AS value, (SELECT min(date) FROM z) AS part FROM z"))
def _(t):
    return rounded(network.invert(t.pairs.withColumn("v", F.col("rms") * F.col("rms")), "v", sign=(1, 1), pin=False, non_negative=True), digits=6)


@register("v11_component_network", "pairs", _network_sql(f"1/power({_SIGMA}, 2)", "phase", -1, 400, _PINNED))
def _(t):
    sigma = network.pair_weights(bt_years=(F.col("date2") - F.col("date1")) / 100)
    return rounded(network.invert(t.pairs, "phase", sigma), digits=5)


_LOS = "cos(radians(-90-heading))*cos(radians(90-look))", "sin(radians(-90-heading))*cos(radians(90-look))", "sin(radians(90-look))"


@register("v12_los_decomposition", "frames", f"""WITH g AS (SELECT pixel, count(*) AS views, sum(power(({_LOS[0]})/sigma, 2)) AS a, sum(({_LOS[0]})*({_LOS[2]})/sigma/sigma) AS b, sum(power(({_LOS[2]})/sigma, 2)) AS c,
    sum(({_LOS[0]})*los/sigma/sigma) AS x, sum(({_LOS[2]})*los/sigma/sigma) AS y FROM frames GROUP BY pixel HAVING count(*) > 1)
    SELECT pixel, views, round((c*x-b*y)/(a*c-b*b), 5) AS east, round((a*y-b*x)/(a*c-b*b), 5) AS up, round(sqrt(c/(a*c-b*b)), 5) AS s_east, round(sqrt(a/(a*c-b*b)), 5) AS s_up FROM g""")  # fmt: skip
def _(t):
    vector = G.los_vector(F.col("look"), F.col("heading"))
    return rounded(views.decompose_los(t.frames, (1, 3), vector=vector).where("views > 1"), digits=5)


@register("v13_tie_to_stations", "stations grid", f"""WITH {gram_sql('stations', [], 've', {'x': 'line::DOUBLE', 'y': 'col::DOUBLE', 'cst': '1e0'}, '1/(se*se)')}
    SELECT line, col, round(value-(m_x*line+m_y*col+m_cst), 5) AS value FROM grid, fitted""")  # fmt: skip
def _(t):
    differences = t.stations.select(F.col("line").cast("double").alias("x"), F.col("col").cast("double").alias("y"), F.col("ve").alias("diff"), F.col("se").alias("sigma"))
    rows = t.grid.withColumns({"x": F.col("line").cast("double"), "y": F.col("col").cast("double")})
    return rounded(correction.tie_to_stations(rows, differences).select("line", "col", "value"), digits=5)


@register("v14_joint_tie")
def _(t):
    e, n, u = G.los_vector(F.col("look"), F.col("heading"))
    points = t.frames.select(F.col("pixel").alias("point"), "frame", (F.col("pixel") % 40 / 40.0).alias("x"), (F.floor(F.col("pixel") / 40) / 50.0).alias("y"), "los", "sigma", e.alias("e"), n.alias("n"), u.alias("u"))
    stations = t.stations.select((F.col("station") * 7).alias("point"), "ve", "vn", "vu")
    return rounded(views.tie_frames(points, stations), digits=4)


@register("v15_phase_elevation", "cube dem", "SELECT date, round(regr_slope(disp, elev), 6) AS slope, round(regr_intercept(disp, elev), 4) AS \"offset\", regr_count(disp, elev) AS n FROM cube JOIN dem USING (pixel) GROUP BY date HAVING count(*) > 5")
def _(t):
    found = correction.phase_elevation(t.cube.join(t.dem, "pixel"), ["date"], "disp").where("n > 5")
    return rounded(rounded(found, "offset", digits=4), "slope")


_MODEL_FORMS = {"cst": ["cst"], "lin": ["r", "a", "cst"], "quad": ["r2", "a2", "ra", "r", "a", "cst"], "fit": ["model", "cst"], "fit+quad": ["model", "r2", "a2", "ra", "r", "a", "cst"]}
for _mode, _names in _MODEL_FORMS.items():
    _fit = {n: (_PLACES | {"model": "model"})[n] for n in _names}
    _y = "value" if _mode.startswith("fit") else "(value-model)"
    _rest = " + ".join(f"m_{n}*({e})" for n, e in _fit.items())
    register(f"v16_model_correction_{_mode.replace('+', '_')}", "dates_px", f"""WITH {gram_sql('dates_px', ['frame', 'date'], _y, _fit)}
    SELECT frame, date, count(*) AS n, round(stddev_pop({_y}-({_rest})), 4) AS std FROM dates_px JOIN fitted USING (frame, date) GROUP BY frame, date""")(  # fmt: skip
        lambda t, mode=_mode: rounded(correction.model_correction(t.dates_px, mode, ["frame", "date"]).groupBy("frame", "date").agg(F.count("*").alias("n"), F.stddev_pop("corrected").alias("std")), digits=4)
    )


@register("v16b_binned_model_fit", "dates_px", f"""WITH {binned_sql('1e-1', '9e-1', 31, 5, 'SELECT model AS x, value AS y FROM dates_px')}, s AS (SELECT x, median, greatest(std, 1e-6) AS std FROM binned),
    {gram_sql('s', [], 'median', {'slope': 'x', 'offset': '1e0'}, '1/(std*std)')}, o AS (SELECT sum(power(median-(m_slope*x+m_offset), 2)) AS rss, sum(x) AS sx, sum(x*x) AS sxx, count(*) AS k FROM s, fitted)
    SELECT n, round(m_slope, 4) AS m_slope, round(m_offset, 4) AS m_offset, round(sqrt(rss/(k-2)*k/(k*sxx-sx*sx)), 4) AS s_slope, round(sqrt(rss/(k-2)*sxx/(k*sxx-sx*sx)), 4) AS s_offset FROM fitted, o""")  # fmt: skip
def _(t):
    rows = t.dates_px.select(F.col("value").alias("phase"), "model")
    return rounded(correction.fit_binned_model(rows, "phase", "model", 31, 5).drop("rss"), digits=4)


@register("v17_weighted_model_ramp", "px", f"WITH {gram_sql('px', ['date1'], '(phase-model)', {'r': 'col::DOUBLE', 'a': 'line::DOUBLE', 'cst': '1e0'}, '1/(coh*coh)')} SELECT {_enough(['date1'], ['r', 'a', 'cst'], 10)} FROM fitted")
def _(t):
    found = correction.weighted_model_ramp(t.px, ["date1"], min_rows=10)
    return _coefs(found, ["date1"], [Term("r", F.lit(0)), Term("a", F.lit(0)), Term("cst", F.lit(0))])


@register("v18_stratified_phase", "px", f"WITH {gram_sql('px', ['date1'], 'phase', {'z0': '1e0', 'z1': '(elev-950e0)'}, 'coh*coh')} SELECT {_enough(['date1'], ['z0', 'z1'], 10)} FROM fitted")
def _(t):
    return _coefs(correction.stratified_phase(t.px, 1, 950.0, ["date1"], value="phase", min_rows=10), ["date1"], [Term("z0", F.lit(0)), Term("z1", F.lit(0))])


@register("v19_profile_ramp", "grid", """WITH s AS (SELECT *, (col-50)*sin(radians(30e0))+(line-5)*cos(radians(30e0)) AS along, (col-50)*cos(radians(30e0))-(line-5)*sin(radians(30e0)) AS across FROM grid),
    k AS (SELECT * FROM s WHERE abs(across) <= 15 AND abs(along) <= 25), f AS (SELECT regr_slope(value, along) AS b, regr_intercept(value, along) AS a FROM k WHERE along > 0)
    SELECT line, col, round(value-(a+b*along), 5) AS value FROM k, f""")  # fmt: skip
def _(t):
    from ..operators import spatial as S

    return rounded(S.profile_ramp(S.profile(t.grid, 50, 5, 30, 50, 30), "pos").select("line", "col", "value"), digits=5)


_QUAD = {"r2": "(col*col)::DOUBLE", "a2": "(line*line)::DOUBLE", "ra": "(col*line)::DOUBLE", "r": "col::DOUBLE", "a": "line::DOUBLE", "cst": "1e0"}


@register("v20_stack_ramp", "px", f"""WITH k AS (SELECT line, col, avg(CASE WHEN phase <> 0 THEN phase END) AS stack FROM px GROUP BY 1, 2), b AS (SELECT quantile_cont(stack, 2e-1) AS lo, quantile_cont(stack, 8e-1) AS hi FROM k),
    i AS (SELECT k.* FROM k, b WHERE stack BETWEEN lo AND hi), {gram_sql('i', [], 'stack', _QUAD)} SELECT line, col, round(stack-({' + '.join(f'm_{n}*({e})' for n, e in _QUAD.items())}), 5) AS stack FROM k, fitted""")  # fmt: skip
def _(t):
    return rounded(correction.stack_ramp(A.stack_pairs(t.px)).select("line", "col", "stack"), digits=5)


_PLANE = {"r": "col::DOUBLE", "a": "line::DOUBLE", "cst": "1e0"}


@register("v21_planar_ramp", "grid", f"WITH {gram_sql('grid', [], 'value', _PLANE, where='WHERE n > 4')} SELECT line, col, round(value-({' + '.join(f'm_{n}*({e})' for n, e in _PLANE.items())}), 5) AS value FROM grid, fitted")
def _(t):
    return rounded(correction.planar_ramp(t.grid, F.col("n") > 4).select("line", "col", "value"), digits=5)


@register("v22_seasonal_mode", "cube dem", f"""WITH p AS (SELECT CAST(floor((dec-floor(dec))*12+1e-6) AS INT) AS part, slope > 25 AS above, disp FROM cube JOIN dem USING (pixel)),
    q AS (SELECT part, above, median(disp) AS med, stddev_pop(disp) AS std FROM p GROUP BY 1, 2), {gram_sql('q', ['above'], 'med', {'sin': 'sin((part+5e-1)/12e0*(2*pi()))', 'cos': 'cos((part+5e-1)/12e0*(2*pi()))', 'cst': '1e0'}, '1/(std*std)')}
    SELECT above, n, round(m_sin, 5) AS m_sin, round(m_cos, 5) AS m_cos, round(m_cst, 5) AS m_cst FROM fitted""")  # fmt: skip
def _(t):
    folded = A.fold_by_phase(t.cube.join(t.dem, "pixel").withColumn("dec", F.col("dec") + 1e-6 / 12), "dec", "disp", F.col("slope") > 25)
    return _coefs(correction.seasonal_mode(folded.drop("n")), ["above"], [Term("sin", F.lit(0)), Term("cos", F.lit(0)), Term("cst", F.lit(0))])


@register("v23_mask_ramp", "grid", f"WITH {gram_sql('grid', [], 'value', _QUAD, where='WHERE n > 2')} SELECT line, col, round(value-({' + '.join(f'm_{n}*({e})' for n, e in _QUAD.items())}), 4) AS value FROM grid, fitted")
def _(t):
    return rounded(correction.planar_ramp(t.grid, F.col("n") > 2, quadratic=True).select("line", "col", "value"), digits=4)


@register("v24_pca")
def _(t):
    maps, vectors = factor.pca(t.vectors, 5)
    shares = vectors.groupBy("component").agg(F.first("explained").alias("explained"))
    return rounded(maps.join(shares, "component"), digits=4)


# With as many components as dates a series is its mean and the sum of all its components, and the squares agree.
@register("v24b_all_components", "vectors", """WITH l AS (SELECT pixel, unnest(disp)::DOUBLE AS v, unnest(range(len(disp))) AS i FROM vectors), m AS (SELECT i, avg(v) AS m FROM l GROUP BY i)
    SELECT pixel, round(sum((v-m)*(v-m)), 4) AS square, count(*) AS n FROM l JOIN m USING (i) GROUP BY pixel""")  # fmt: skip
def _(t):
    size = len(t.vectors.select("disp").first()[0])
    maps, _ = factor.pca(t.vectors, size)
    return rounded(maps.groupBy("pixel").agg(F.sum(F.col("value") ** 2).alias("square"), F.count("*").alias("n")), digits=4)


@register("v26b_full_reconstruction", "vectors", """WITH l AS (SELECT pixel, unnest(disp)::DOUBLE AS v, unnest(range(len(disp)))::INT AS idx FROM vectors), m AS (SELECT idx, avg(v) AS m FROM l GROUP BY idx)
    SELECT pixel, idx, round(v-m, 4) AS model FROM l JOIN m USING (idx)""")  # fmt: skip
def _(t):
    size = len(t.vectors.select("disp").first()[0])
    maps, vectors = factor.pca(t.vectors, size)
    return rounded(factor.reconstruct(maps, vectors.drop("explained"), list(range(size))), digits=4)


@register("v25_ica")
def _(t):
    maps, _ = factor.ica(t.vectors, 4)
    return rounded(maps, digits=3)


@register("v26_reconstruct")
def _(t):
    maps, vectors = factor.pca(t.vectors, 4)
    return rounded(factor.reconstruct(maps, vectors.drop("explained"), [0, 1, 2]), digits=4)


@register("v27_alternating")
def _(t):
    done = iterate.alternate(t.cube.select("pixel", "line", "col", "date", "dec", "disp"), _terms(), DATES, 2, 3)
    return rounded(done.weights, digits=5)


@register("v27b_alternating_series")
def _(t):
    done = iterate.alternate(t.cube.select("pixel", "line", "col", "date", "dec", "disp"), _terms(), DATES, 2, 3)
    cells = done.cells.groupBy("pixel").agg(F.avg("flat").alias("flat"), F.avg("model").alias("model"), F.count("*").alias("n_cells"))
    return rounded(done.coefficients.select("pixel", "n", "m_reference", "m_linear", "s_linear").join(cells, "pixel"), digits=4)


@register("v28_group_residual", "cube", f"WITH {gram_sql('cube', ['pixel'], 'disp', LINEAR)} SELECT date, round(sqrt(avg(power(disp-(m_reference+m_linear*(dec-1995e0)), 2))), 5) AS rms FROM cube JOIN fitted USING (pixel) WHERE n > {DATES}/6e0 GROUP BY date")
def _(t):
    terms = _terms()
    found = solve.fit_pixels(t.cube, F.col("disp"), terms, DATES).where("m_reference is not null").drop("n", "rss")
    rest = t.cube.join(found, "pixel").withColumn("r", F.col("disp") - solve.evaluate(terms))
    return rounded(A.rms_by(rest, "r", ["date"]).select("date", "rms"), digits=5)


@register("v29_line_decomp", "cube", _fit_sql(["line", "col"], "cube", "disp", LINEAR, test=f"WHERE n > {DATES}/10e0"))
def _(t):
    terms = _terms()
    found = solve.fit(t.cube, F.col("disp"), terms, ["line", "col"], min_rows=F.col("n") > DATES / 10).where("m_reference is not null")
    return _coefs(found, ["line", "col"], terms)


@register("v30_point_decomp", "cube", _fit_sql(["pixel"], "cube", "disp", LINEAR, where="WHERE pixel IN (3, 41, 77)"))
def _(t):
    terms = _terms()
    return _coefs(solve.fit(t.cube.where(F.col("pixel").isin(3, 41, 77)), F.col("disp"), terms, ["pixel"]), ["pixel"], terms)


@register("b16_simple_fits", "cube", "SELECT pixel, round(regr_slope(disp, dec), 5) AS slope, round(regr_intercept(disp, dec-1995e0), 5) AS \"offset\", 2*round(stddev_pop(disp), 5) AS two_sigma FROM cube GROUP BY pixel")
def _(t):
    x = F.col("dec") - F.lit(1995.0)
    found = t.cube.groupBy("pixel").agg(F.regr_slope("disp", "dec").alias("slope"), F.regr_intercept(F.col("disp"), x).alias("offset"), (2 * F.round(F.stddev_pop("disp"), 5)).alias("two_sigma"))
    return rounded(found, "slope", "offset", digits=5)


# Sources and sinks over the test tables: what is written is read back.
def _export(t: Tables, name: str) -> str:
    from ..session import use_checkpoint_dir

    use_checkpoint_dir(t.spark)
    import uuid

    return f"{t.spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


@register("k01_cells_round_trip", "grid", "SELECT CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col, round(value, 6) AS value FROM grid")
def _(t):
    path = _export(t, "cells")
    sinks.write_cells(t.grid.select("line", "col", "value"), path, 5)
    return rounded(sinks.read_cells(t.spark, path))


@register("k05_window_update", "grid", "SELECT CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col, round(CASE WHEN line >= 5 AND line < 10 THEN -value ELSE value END, 6) AS value FROM grid")
def _(t):
    path = _export(t, "update")
    cells = t.grid.select("line", "col", "value")
    sinks.write_cells(cells, path, 5)
    sinks.update_window(cells.where("line >= 5 and line < 10").withColumn("value", -F.col("value")), path, 5)
    return rounded(sinks.read_cells(t.spark, path))


@register("k06_text_round_trip", "pairs", "SELECT date1, date2, round(rms, 6) AS rms FROM pairs")
def _(t):
    path = _export(t, "text")
    sinks.write_text_table(t.pairs.select("date1", "date2", "rms"), path, 12)
    read = t.spark.read.option("sep", " ").schema("date1 int, date2 int, rms double").csv(path)
    return rounded(read)


@register("k07_stack_dates", "dates_px", "SELECT date::INT AS date, line, col, round(avg(value), 6) AS value FROM dates_px GROUP BY 1, 2, 3")
def _(t):
    mean = t.dates_px.groupBy("date", "line", "col").agg(F.avg("value").alias("value"))
    dates = [r["date"] for r in t.dates_px.select("date").distinct().orderBy("date").collect()]  # one row a date
    maps = [(d, mean.where(F.col("date") == d).drop("date")) for d in dates]
    return rounded(sinks.stack_dates(maps).select("date", "line", "col", "value"))


@register("k12_copy_band", "px", "SELECT line, col, round(sum(phase), 5) AS value FROM px GROUP BY line, col")
def _(t):
    band = sinks.copy_band(t.px, True)
    return rounded(band.groupBy("line", "col").agg(F.sum("value").alias("value")), digits=5)


@register("s02_cube_shapes", "cube", "SELECT pixel, count(*) AS n, round(sum(disp), 4) AS total FROM cube GROUP BY pixel")
def _(t):
    dates = t.nodes.select("date").orderBy("date").collect()
    index = {r["date"]: i for i, r in enumerate(dates)}  # one entry a date
    lookup = t.spark.createDataFrame(list(index.items()), "date int, idx int")
    wide = raster.cube_to_wide(t.cube.join(lookup, "date"), len(index), ("pixel",))
    back = raster.cube_to_long(wide, ("pixel",)).where("disp is not null")
    return rounded(back.groupBy("pixel").agg(F.count("*").alias("n"), F.sum("disp").alias("total")), digits=4)


@register("s07_window_read", "grid", "SELECT line, col, round(value, 6) AS value FROM grid WHERE line >= 3 AND line < 6")
def _(t):
    return rounded(raster.read_window(t.grid.select("line", "col", "value"), 3, 3))


@register("m00_missing_values", "obs", "SELECT pixel, idate, round(CASE WHEN disp <> 9990 THEN disp END, 6) AS disp FROM obs")
def _(t):
    from ..functions.phase import null_where

    return rounded(t.obs.select("pixel", "idate", null_where(F.col("disp"), 9990, 9999).alias("disp")))


@register("j01_pair_pipeline", "px", f"""WITH b AS (SELECT date1, date2, quantile_cont(phase, 5e-2) AS lo, quantile_cont(phase, 95e-2) AS hi FROM px GROUP BY 1, 2),
    e AS (SELECT px.* FROM px JOIN b USING (date1, date2) WHERE phase <> 0 AND phase > lo AND phase < hi), {gram_sql('e', ['date1'], 'phase', {'cst': '1e0', 'z': '(elev/1e3)'})}
    SELECT date1, date2, line, col, CASE WHEN n > 20 THEN round(phase-(m_cst+m_z*elev/1e3), 4) END AS phase FROM px LEFT JOIN fitted USING (date1)""")  # fmt: skip
def _(t):
    rows = M.with_bounds(t.px, "phase", 5, 95, ("date1", "date2")).where("phase <> 0 and phase > lo and phase < hi")
    fitted = correction.fit_ramps(rows, ["date1"], 0, elevation=True, pair=True, value="phase", min_rows=20)
    done = correction.remove_ramps(t.px, fitted, ["date1"], elevation=True, value="phase")
    known = fitted.where("n_rows > 20").select("date1", F.lit(True).alias("known"))
    done = done.join(known, "date1", "left").withColumn("phase", F.when(F.col("known"), F.col("phase")))
    return rounded(done.select("date1", "date2", "line", "col", "phase"), digits=4)


@register("j11_add_back", "px", "SELECT date1, date2, line, col, round(CASE WHEN phase = 0 THEN 0 ELSE phase+model END, 6) AS phase FROM px")
def _(t):
    from ..operators import algebra as L

    model = t.px.select("date1", "date2", "line", "col", F.col("model").alias("value"))
    found = L.shift_phase(t.px.select("date1", "date2", "line", "col", "amp", "phase"), model, 1, ["date1", "date2", "line", "col"])
    return rounded(found.select("date1", "date2", "line", "col", "phase"))


@register("x01_windowed_coverage", "series", """SELECT epoch(date_trunc('day', ts))::BIGINT AS start, user_id AS pixel, count(*) AS n, count(CASE WHEN value <> 0 THEN 1 END) AS filled FROM events GROUP BY 1, 2""")
def _(t):
    from ..streaming.coverage import windowed_coverage

    found = windowed_coverage(t.base("events").withColumnRenamed("user_id", "pixel"))
    return found.select(F.unix_timestamp("start").alias("start"), "pixel", "n", "filled")
