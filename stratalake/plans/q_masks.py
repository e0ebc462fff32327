"""Queries over masks, crops and referencing, and raster algebra."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import phase as PH
from ..functions import ramps
from ..operators import algebra as A
from ..operators import masks as M
from .registry import register, rounded

CUBE_DEM = "cube JOIN dem USING (pixel)"


@register("f01_estimation_rows", "cube dem", f"SELECT pixel, date, round(disp, 6) AS disp FROM {CUBE_DEM} WHERE elev > 91e1 AND elev < 1000 AND sigma > 1e-6 AND sigma < 3 AND line > 1 AND line < 40 AND col > 2 AND col < 30 AND slope > 5")
def _(t):
    rows = t.cube.join(t.dem, "pixel").withColumnsRenamed({"sigma": "rms", "disp": "value", "slope": "mask"})
    found = M.estimation_rows(rows, elevation=(910.0, 1000.0), rms_below=3.0, mask_above=5, crop=(1, 40, 2, 30))
    return rounded(found.select("pixel", "date", F.col("value").alias("disp")))


@register("f02_pair_estimation_rows", "px", """WITH b AS (SELECT date1, date2, quantile_cont(phase, 5e-2) AS lo, quantile_cont(phase, 95e-2) AS hi FROM px GROUP BY 1, 2)
    SELECT date1, date2, line, col, round(phase, 6) AS phase FROM px JOIN b USING (date1, date2)
    WHERE elev > 900 AND elev < 1000 AND slope > 10 AND phase <> 0 AND phase > lo AND phase < hi AND coh > 2e-1 AND (line < 5 OR line > 7)""")  # fmt: skip
def _(t):
    found = M.pair_estimation_rows(t.px, elevation=(900, 1000), min_slope=10, percent=95, min_coherence=0.2, excluded_lines=(5, 7))
    return rounded(found.select("date1", "date2", "line", "col", "phase"))


@register("f03_reference_rows", "grid", "SELECT line, col, round(value, 6) AS value FROM grid WHERE line > 2 AND line < 9 AND col > 10 AND col < 40 AND n > 3")
def _(t):
    return rounded(M.reference_rows(t.grid.withColumn("mask", F.col("n")), (2, 9, 10, 40), 3).select("line", "col", "value"))


CLIP = "WITH b AS (SELECT quantile_cont(value, 5e-2) AS lo, quantile_cont(value, 95e-2) AS hi FROM grid) SELECT line, col, round(CASE WHEN value >= lo AND value <= hi THEN value {0} END, 6) AS value FROM grid, b"


@register("f04_percentile_clip", "grid", CLIP.format(""))
def _(t):
    return rounded(M.clip_percentile(t.grid.select("line", "col", "value"), "value", 95))


@register("f05_percentile_zero", "grid", CLIP.format("ELSE 0e0"))
def _(t):
    return rounded(M.clip_percentile(t.grid.select("line", "col", "value"), "value", 95, outside=0.0))


@register("f06_mask", "grid grid2", "SELECT line, col, round(CASE WHEN m = 0 OR abs(m*2) > 11e-1 THEN NULL ELSE 3*(value-10) END, 6) AS value FROM grid LEFT JOIN (SELECT line, col, value AS m FROM grid2) USING (line, col)")
def _(t):
    return rounded(M.mask_by(t.grid.select("line", "col", "value"), t.grid2, 1.1, absolute=True, scale=3.0, shift=10.0, scale_mask=2.0))


@register("f07_mask_pair", "px grid2", "SELECT date1, date2, line, col, round(CASE WHEN m > 5e-1 THEN 0 ELSE amp END, 6) AS amp, round(CASE WHEN m > 5e-1 THEN 0 ELSE phase END, 6) AS phase FROM px LEFT JOIN (SELECT line, col, value AS m FROM grid2) USING (line, col)")
def _(t):
    return rounded(M.mask_pair(t.px.select("date1", "date2", "line", "col", "amp", "phase"), t.grid2, 0.5))


@register("f08_clean_cube", "dates_px", """WITH b AS (SELECT frame, date, quantile_cont(value, 2e-2) AS lo, quantile_cont(value, 98e-2) AS hi FROM dates_px GROUP BY frame, date),
    c AS (SELECT frame, date, line, col, elev, CASE WHEN value >= lo AND value <= hi AND rms <= 40 THEN value END AS v FROM dates_px JOIN b USING (frame, date)),
    z AS (SELECT frame, date, avg(v) AS m FROM c WHERE line < 5 GROUP BY frame, date)
    SELECT frame, date, line, col, round(v-coalesce(m, 0)-elev*(date-1997)/1e2, 6) AS value FROM c LEFT JOIN z USING (frame, date)""")  # fmt: skip
def _(t):
    rows = t.dates_px.select("frame", "date", "line", "col", "value", F.col("rms").alias("mask"), F.col("elev").alias("dem"), F.col("date").cast("double").alias("bperp"))
    found = M.clean_cube(rows, percent=98, mask_below=40, zone=F.col("line") < 5, demerr=True, bperp_reference=1997.0, by=("frame", "date"))
    return rounded(found.select("frame", "date", "line", "col", "value"))


@register("f09_reference_in_time", "cube", """WITH r AS (SELECT pixel, max(disp) AS ref FROM cube WHERE date=199706 GROUP BY pixel)
    SELECT pixel, date, round(CASE WHEN date=199706 OR disp-coalesce(ref, 0) <> 0 THEN disp-coalesce(ref, 0) END, 6) AS disp FROM cube LEFT JOIN r USING (pixel)""")  # fmt: skip
def _(t):
    return rounded(M.reference_in_time(t.cube.select("pixel", "date", "disp"), 199706))


@register("f10_reference_in_space", "cube", """WITH z AS (SELECT date, sum(disp/sigma)/sum(1/sigma) AS m FROM cube WHERE line < 3 GROUP BY date)
    SELECT pixel, date, round(disp-coalesce(m, 0), 6) AS disp FROM cube LEFT JOIN z USING (date)""")  # fmt: skip
def _(t):
    found = M.reference_in_space(t.cube, F.col("line") < 3, "disp", ["date"], 1 / F.col("sigma"))
    return rounded(found.select("pixel", "date", "disp"))


@register("f11_reference_pair", "px", """WITH i AS (SELECT * FROM px WHERE line < 8), b AS (SELECT date1, date2, quantile_cont(phase, 5e-2) AS lo, quantile_cont(phase, 95e-2) AS hi FROM i GROUP BY 1, 2),
    z AS (SELECT date1, date2, sum(phase*coh)/sum(coh) AS m FROM i JOIN b USING (date1, date2) WHERE phase BETWEEN lo AND hi GROUP BY 1, 2)
    SELECT date1, date2, line, col, round(phase-coalesce(m, 0), 6) AS phase FROM px LEFT JOIN z USING (date1, date2)""")  # fmt: skip
def _(t):
    found = M.reference_in_space(t.px, F.col("line") < 8, "phase", ["date1", "date2"], F.col("coh"), (5, 95))
    return rounded(found.select("date1", "date2", "line", "col", "phase"))


@register("f12_zone_mean", "grid", "SELECT line, col, round(value-(SELECT avg(value) FROM grid WHERE line >= 2 AND line < 9 AND col >= 10 AND col < 40), 6) AS value FROM grid")
def _(t):
    found = M.reference_in_space(t.grid.withColumn("one", F.lit(1)), M.box(2, 9, 10, 40), "value", ["one"])
    return rounded(found.select("line", "col", "value"))


@register("f13_crop", "grid", "SELECT line-2 AS line, col-10 AS col, round(value, 6) AS value FROM grid WHERE line >= 2 AND line < 9 AND col >= 10 AND col < 40")
def _(t):
    return rounded(M.crop(t.grid.select("line", "col", "value"), 2, 9, 10, 40))


@register("f14_cut", "px", "SELECT date1, date2, line, col, round(CASE WHEN line >= 2 AND line < 9 AND col >= 3 AND col < 12 THEN phase ELSE 0 END, 6) AS phase, round(CASE WHEN line >= 2 AND line < 9 AND col >= 3 AND col < 12 THEN amp ELSE 0 END, 6) AS amp FROM px")
def _(t):
    return rounded(M.cut(t.px.select("date1", "date2", "line", "col", "phase", "amp"), 2, 9, 3, 12, "phase", "amp"))


@register("f15_extend", "grid", "SELECT r.line, r.col, round(value, 6) AS value FROM (SELECT a.range AS line, b.range AS col FROM range(120) a, range(110) b) r LEFT JOIN grid ON grid.line=r.line AND grid.col=r.col")
def _(t):
    return rounded(M.extend(t.grid.select("line", "col", "value"), 120, 110))


@register("f16_crop_tapered", "grid", "SELECT line, col, round(CASE WHEN line >= 1 AND line < 90 AND col >= 5 AND col < 95 THEN value*least(1e0, least(line-1, 89-line, col-5, 94-col)/1e1) END, 6) AS value FROM grid")
def _(t):
    return rounded(M.crop_tapered(t.grid.select("line", "col", "value"), 1, 90, 5, 95, 10))


@register("f17_geographic_crop", "points", "SELECT point, CAST(floor((lon-1e-1)/5e-1+5e-1) AS INT) AS col, CAST(floor((lat-3)/-25e-2+5e-1) AS INT) AS line FROM points WHERE lon > 5e-1 AND lon < 3 AND lat > 5e-1 AND lat < 2")
def _(t):
    from ..functions import geometry as G

    inside = t.points.where(M.within(0.5, 3.0, F.col("lon")) & M.within(0.5, 2.0, F.col("lat")))
    return inside.select("point", G.cell(F.col("lon"), 0.1, 0.5).alias("col"), G.cell(F.col("lat"), 3.0, -0.25).alias("line"))


@register("f18_mask_cube", "cube dem", f"SELECT pixel, date, round(CASE WHEN slope >= 20 THEN disp END, 6) AS disp FROM {CUBE_DEM}")
def _(t):
    mask = t.dem.select("pixel", F.col("slope").cast("double").alias("mask"))
    return rounded(M.mask_cube(t.cube.select("pixel", "date", "disp"), mask, 20).select("pixel", "date", "disp"))


@register("f19_short_image", "grid", """SELECT min(CASE WHEN n=0 THEN b*10 END)::BIGINT AS first_empty_line, min(CASE WHEN n=0 THEN b*10 END) IS NOT NULL AS short FROM (
    SELECT CAST(floor(line/10) AS BIGINT) AS b, sum(CASE WHEN line < 60 THEN 1 ELSE 0 END) AS n FROM grid GROUP BY 1)""")  # fmt: skip
def _(t):
    return M.short_image_start(t.grid.select("line", "col", F.when(F.col("line") < 60, F.col("value")).alias("value")))


@register("f20_subsample", "grid", "SELECT line, col, round(value, 6) AS value FROM (SELECT *, row_number() OVER (ORDER BY line, col) AS i FROM grid WHERE n > 2) WHERE (i-1) % 3 = 0")
def _(t):
    return rounded(M.subsample(t.grid.where("n > 2").select("line", "col", "value"), 3))


@register("f21_clean_seasonal", "coefs dem", """WITH a AS (SELECT pixel, sqrt(seasonal_sin*seasonal_sin+seasonal_cos*seasonal_cos) AS amp, atan2(seasonal_sin, seasonal_cos) AS phi, s_sin, elev FROM coefs JOIN dem USING (pixel)),
    b AS (SELECT quantile_cont(s_sin, 8e-1) AS hi FROM a)
    SELECT pixel, round(CASE WHEN s_sin <= hi AND elev >= 920 AND amp BETWEEN 1 AND 3 THEN amp END, 6) AS amp,
           round(CASE WHEN s_sin <= hi AND elev >= 920 AND amp BETWEEN 1 AND 3 THEN phi+CASE WHEN phi < 0 THEN 2*pi() ELSE 0 END END, 6) AS phi FROM a, b""")  # fmt: skip
def _(t):
    joined = t.coefs.join(t.dem, "pixel")
    rows = joined.select("pixel", PH.amplitude(F.col("seasonal_sin"), F.col("seasonal_cos")).alias("amp"), PH.phase(F.col("seasonal_sin"), F.col("seasonal_cos")).alias("phi"), F.col("s_sin").alias("sigma"), "elev")
    return rounded(M.clean_seasonal(rows, max_sigma_percent=80, min_elev=920, min_amp=1, max_amp=3).select("pixel", "amp", "phi"))


@register("f22_component_quality", "grid", """WITH b AS (SELECT quantile_cont(rms, 98e-2) AS s98, quantile_cont(value, 2e-3) AS lo, quantile_cont(value, 998e-3) AS hi FROM grid)
    SELECT line, col, round(CASE WHEN rms > s98 OR rms/abs(value) > 3 OR value < lo OR value > hi THEN NULL ELSE value END, 6) AS value FROM grid, b""")  # fmt: skip
def _(t):
    return rounded(M.component_quality(t.grid.select("line", "col", "value", F.col("rms").alias("sigma"))).select("line", "col", "value"))


@register("f23_point_in_polygon", "points", """SELECT point FROM points WHERE 3*(lat-5e-1)-5e-1*(lon-5e-1) > 0 AND 5e-1*(lat-1)-15e-1*(lon-35e-1) > 0
    AND -3*(lat-25e-1)-(-5e-1)*(lon-4) > 0 AND -5e-1*(lat-2)-(-15e-1)*(lon-1) > 0""")  # fmt: skip
def _(t):
    from ..functions import geometry as G

    corners = [(0.5, 0.5), (3.5, 1.0), (4.0, 2.5), (1.0, 2.0)]
    return t.points.where(G.in_convex_polygon(F.col("lon"), F.col("lat"), corners)).select("point")


@register("f24_event_mask", "grid2", "SELECT line, col, round(-(abs(value)-8e-1), 6) AS mask FROM grid2")
def _(t):
    return rounded(M.event_mask(t.grid2).select("line", "col", "mask"))


# Raster algebra.
@register("r01_scale", "grid", "SELECT line, col, round(value*-44563e-4+1, 6) AS value FROM grid")
def _(t):
    return rounded(A.scaled(t.grid.select("line", "col", "value"), "value", -4.4563, 1.0))


for _how, _expr in {"add": "a.value+b.value", "subtract": "a.value-b.value", "amp": "sqrt(a.value*a.value+b.value*b.value)", "dphi": "atan2(a.value, b.value)"}.items():
    register(f"r02_combine_{_how}", "grid grid2", f"SELECT a.line, a.col, round(CASE WHEN a.value <> 0 AND b.value <> 0 THEN {_expr} END, 6) AS value FROM grid a JOIN grid2 b ON a.line=b.line AND a.col=b.col")(
        lambda t, how=_how: rounded(A.combine(t.grid, t.grid2, how))
    )


@register("r03_remove_phase_model", "px grid2", """SELECT date1, date2, line, col, round(amp, 6) AS amp, round(CASE WHEN phase = 0 OR m IS NULL OR phase-m < -10000 THEN 0 ELSE phase-m END, 6) AS phase
    FROM px LEFT JOIN (SELECT line, col, value AS m FROM grid2) USING (line, col)""")  # fmt: skip
def _(t):
    found = A.shift_phase(t.px.select("date1", "date2", "line", "col", "amp", "phase"), t.grid2, -1, ["line", "col"])
    return rounded(found.select("date1", "date2", "line", "col", "amp", "phase"))


@register("r04_complex_to_phase", "px", "SELECT date1, date2, line, col, round(sqrt(phase*phase+coh*coh), 6) AS amp, round(atan2(coh, phase), 6) AS phi FROM px")
def _(t):
    re, im = F.col("phase"), F.col("coh")
    return rounded(t.px.select("date1", "date2", "line", "col", PH.amplitude(re, im).alias("amp"), PH.phase(im, re).alias("phi")))


@register("r05_wrap", "grid", "SELECT line, col, round((value+pi())-floor((value+pi())/(2*pi()))*(2*pi())-pi(), 6) AS value FROM grid")
def _(t):
    return rounded(t.grid.select("line", "col", PH.wrap(F.col("value")).alias("value")))


@register("r06_seasonal_amp_phase", "coefs", """SELECT pixel, round(sqrt(seasonal_sin*seasonal_sin+seasonal_cos*seasonal_cos), 6) AS amp, round(atan2(seasonal_sin, seasonal_cos), 6) AS phi,
    round(sqrt(s_sin*s_sin+s_cos*s_cos), 6) AS s_amp, round((s_cos*abs(seasonal_sin)+s_sin*abs(seasonal_cos))/(s_cos*s_cos+s_sin*s_sin), 6) AS s_phi FROM coefs""")  # fmt: skip
def _(t):
    a, b, sa, sb = (F.col(c) for c in ("seasonal_sin", "seasonal_cos", "s_sin", "s_cos"))
    return rounded(t.coefs.select("pixel", PH.amplitude(a, b).alias("amp"), PH.phase(a, b).alias("phi"), PH.amplitude_sigma(sa, sb).alias("s_amp"), PH.phase_sigma(a, b, sa, sb).alias("s_phi")))


def _model_terms():
    from ..functions import basis as B

    dec = F.col("dec")
    return {"reference": F.lit(1.0), "linear": B.linear(dec, 1995.0), "seasonal_sin": B.harmonic(dec, 1995.0, 1.0), "seasonal_cos": B.harmonic(dec, 1995.0, 1.0, True)}


_MODEL = "(reference+linear*(dec-1995)+seasonal_sin*sin(2*pi()*(dec-1995))+seasonal_cos*cos(2*pi()*(dec-1995)))"


@register("r07_remove_model", "cube coefs", f"SELECT pixel, date, round({_MODEL}, 5) AS model, round(disp-{_MODEL}, 5) AS disp FROM cube JOIN coefs USING (pixel)")
def _(t):
    return rounded(A.remove_model(t.cube.select("pixel", "date", "dec", "disp"), t.coefs, _model_terms()).select("pixel", "date", "model", "disp"), digits=5)


# Every pixel on a day's step over eight years; what is compared sums a pixel's days up.
@register("r08_dense_model", "coefs", """SELECT pixel, count(*) AS n, round(min(m), 5) AS lowest, round(max(m), 5) AS highest, round(avg(m), 5) AS mean, round(sum(m*k)/2920e0, 3) AS moment FROM (
    SELECT pixel, range::INT AS k, reference+linear*(8e0/2919*range)+seasonal_sin*sin(2*pi()*(8e0/2919*range))+seasonal_cos*cos(2*pi()*(8e0/2919*range)) AS m FROM coefs, range(2920)) GROUP BY pixel""")  # fmt: skip
def _(t):
    from ..functions import basis as B

    time = F.col("t")
    terms = {"reference": F.lit(1.0), "linear": B.linear(time, 1995.0), "seasonal_sin": B.harmonic(time, 1995.0, 1.0), "seasonal_cos": B.harmonic(time, 1995.0, 1.0, True)}
    days = A.dense_model(t.coefs, terms, 1995.0, 8.0, 2920)
    m = F.col("model")
    found = days.groupBy("pixel").agg(F.count("*").alias("n"), F.min(m).alias("lowest"), F.max(m).alias("highest"), F.avg(m).alias("mean"), (F.sum(m * F.col("k")) / F.lit(2920.0)).alias("moment"))
    return rounded(rounded(found, "lowest", "highest", "mean", digits=5), "moment", digits=3)


_SLOTS = {"r3": "1e-7", "r2": "1e-5", "r": "1e-3", "a3": "2e-7", "a2": "2e-5", "a": "2e-3", "ra2": "1e-8", "ra": "1e-5", "cst": "rms", "z": "1e-4", "z2": "1e-7", "az": "1e-6", "az2": "1e-11"}
_RAMP = "+".join(f"{m}*{e}" for m, e in zip(
    (f"s.{k}" for k in ramps.PAIR_SLOTS), ("col**3", "col**2", "col", "line**3", "line**2", "line", "(col*line)**2", "col*line", "1", "elev", "elev**2", "line*elev", "(line*elev)**2"), strict=True))


@register("r09_apply_pair_ramp", "px pairs", f"""SELECT date1, date2, line, col, round({_RAMP}, 6) AS ramp, round(phase-({_RAMP}), 6) AS phase FROM px
    JOIN (SELECT date1 AS d1, date2 AS d2, {', '.join(f'{v} AS {k}' for k, v in _SLOTS.items())} FROM pairs) s ON d1=date1 AND d2=date2""")  # fmt: skip
def _(t):
    coefs = t.pairs.select("date1", "date2", *[F.expr(v).cast("double").alias(k) for k, v in _SLOTS.items()])
    return rounded(A.apply_pair_ramps(t.px.select("date1", "date2", "line", "col", "phase", "elev"), coefs))\
        .select("date1", "date2", "line", "col", "ramp", "phase")


@register("r10_azimuth_polynomial", "grid", "SELECT line, col, round(value+1+1e-1*col+1e-3*col*col+1e-7*col*col*col*col, 6) AS value FROM grid")
def _(t):
    x = F.col("col").cast("double")
    return rounded(t.grid.select("line", "col", (F.col("value") + ramps.azimuth_polynomial(x, *map(F.lit, (1.0, 0.1, 1e-3, 1e-7)))).alias("value")))


@register("r11_rotate", "px", "SELECT date1, date2, line, col, round(phase*cos(model)-coh*sin(model), 6) AS re, round(phase*sin(model)+coh*cos(model), 6) AS im FROM px")
def _(t):
    re, im = PH.rotate(F.col("phase"), F.col("coh"), F.col("model"))
    return rounded(t.px.select("date1", "date2", "line", "col", re.alias("re"), im.alias("im")))


@register("r12_log_amplitude", "px", "SELECT date1, date2, line, col, round(CASE WHEN phase > 0 THEN ln(phase) END, 6) AS v FROM px")
def _(t):
    return rounded(t.px.select("date1", "date2", "line", "col", A.log_amplitude(F.col("phase")).alias("v")))


@register("r13_prepare_slc", "px", """SELECT date1, date2, line, col, round(CASE WHEN slope > 10 THEN ln(sqrt(phase*phase+coh*coh)) END, 6) AS amp,
    round(CASE WHEN slope > 10 THEN ln(sqrt(phase*phase+coh*coh))*cos(atan2(coh, phase)) END, 6) AS re_out FROM px WHERE line >= 2 AND line < 9 AND col >= 3 AND col < 12""")  # fmt: skip
def _(t):
    rows = t.px.select("date1", "date2", "line", "col", F.col("phase").alias("re"), F.col("coh").alias("im"), F.col("slope").alias("mask"))
    return rounded(A.prepare_slc(rows, 10, M.box(2, 9, 3, 12)).select("date1", "date2", "line", "col", "amp", "re_out"))


@register("r14_displacement", "px", "SELECT date1, date2, line, col, round((coh-(SELECT quantile_cont(amp, 5e-1) FROM px))*12, 6) AS displacement FROM px")
def _(t):
    return rounded(A.correlation_to_displacement(t.px.select("date1", "date2", "line", "col", "amp", "coh"), "amp", "coh", 12.0).select("date1", "date2", "line", "col", "displacement"))


@register("r15_cutfile_weight", "grid", "WITH m AS (SELECT max(value) AS mx FROM grid) SELECT line, col, round((value/mx*5e-1+1/(rms+1e-5)/20)*mx, 6) AS weight FROM grid, m")
def _(t):
    return rounded(A.cutfile_weight(t.grid.select("line", "col", F.col("value").alias("grad"), F.col("rms").alias("std"))).select("line", "col", "weight"))


@register("r16_zenith_to_los", "dates_px", """WITH z AS (SELECT frame, date, line, col, model/cos(radians(34e0))*-1256e-1 AS los FROM dates_px)
    SELECT frame, a.date::INT AS date1, b.date::INT AS date2, line, col, round(b.los-a.los, 6) AS los FROM z a JOIN z b USING (frame, line, col) WHERE a.date < b.date""")  # fmt: skip
def _(t):
    delays = t.dates_px.select("frame", "date", "line", "col", F.col("model").alias("ztd"), F.lit(34.0).alias("inc"))
    years = [r["date"] for r in t.dates_px.select("date").distinct().orderBy("date").collect()]  # one row a year
    pairs = t.spark.createDataFrame([(a, b) for a in years for b in years if a < b], "date1 int, date2 int")
    return rounded(A.pair_difference(pairs, A.zenith_to_los(delays, -125.6), "los", ("frame", "line", "col")))


@register("r17_add_geoid", "grid grid2", "SELECT a.line, a.col, round(a.value+b.value, 6) AS value FROM grid a JOIN grid2 b ON a.line=b.line AND a.col=b.col")
def _(t):
    return rounded(A.combine(t.grid, t.grid2, "add", zero_missing=False))


@register("r18_loop_bias", "dates_px", """WITH s AS (SELECT a.date-1995 AS loop, frame, line, col, (b.value-a.value)*CASE WHEN a.date=1996 THEN 11e-1 ELSE 1 END+(c.value-b.value)*CASE WHEN b.date=1996 THEN 11e-1 ELSE 1 END-(c.value-a.value) AS bias
    FROM dates_px a JOIN dates_px b USING (line, col, frame) JOIN dates_px c USING (line, col, frame) WHERE b.date=a.date+1 AND c.date=a.date+2)
    SELECT loop::INT AS loop, frame, line, col, round(bias-avg(bias) OVER (PARTITION BY frame, loop), 6) AS bias FROM s""")  # fmt: skip
def _(t):
    years = [r["date"] for r in t.dates_px.select("date").distinct().orderBy("date").collect()]  # one row a year
    triples = [(a, b, c) for a, b, c in zip(years, years[1:], years[2:], strict=False)]
    pairs = t.spark.createDataFrame(sorted({p for a, b, c in triples for p in ((a, b), (b, c), (a, c))}), "date1 int, date2 int")
    cells = A.pair_difference(pairs, t.dates_px.select("frame", "date", "line", "col", "value"), "value", ("frame", "line", "col"))
    cells = cells.withColumn("phase", F.col("value") * F.when((F.col("date1") == 1996) & (F.col("date2") == 1997), 1.1).otherwise(1.0))
    loops = t.spark.createDataFrame([x for a, b, c in triples for x in ((a - 1995, a, b, 1), (a - 1995, b, c, 1), (a - 1995, a, c, -1))], "loop int, date1 int, date2 int, sign int")
    return rounded(A.loop_bias(cells.select("frame", "date1", "date2", "line", "col", "phase"), loops, ("frame",)))


@register("r19_rescale_components", "dates_px", """WITH v AS (SELECT frame, max(m)-min(m) AS span FROM (SELECT frame, date, avg(model) AS m FROM dates_px GROUP BY 1, 2) GROUP BY 1)
    SELECT frame AS component, date, line, col, round(value*span, 6) AS value FROM dates_px JOIN v USING (frame)""")  # fmt: skip
def _(t):
    vectors = t.dates_px.groupBy(F.col("frame").alias("component"), "date").agg(F.avg("model").alias("value"))
    maps = t.dates_px.select(F.col("frame").alias("component"), "date", "line", "col", "value")
    return rounded(A.rescale_components(maps, vectors).select("component", "date", "line", "col", "value"))


