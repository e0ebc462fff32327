"""Queries over dates, basis functions, pair lists and acquisitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import basis as B
from ..functions import dates as D
from ..operators import pairs as P
from .registry import register, rounded

ENDS = "pairs JOIN nodes n1 ON n1.date=date1 JOIN nodes n2 ON n2.date=date2"


@register("l01_decimal_year", "obs", "SELECT DISTINCT idate, round(year(d)+dayofyear(d)/365.1e0, 8) AS dec FROM obs")
def _(t):
    return rounded(t.obs.select("idate", D.decimal_year(F.col("d")).alias("dec")).distinct(), digits=8)


@register("l02_decimal_year_by_month", "obs", "SELECT DISTINCT idate, round(year(d)+(month(d)-1)/12e0+(day(d)-1)/365e0, 8) AS dec FROM obs")
def _(t):
    return rounded(t.obs.select("idate", D.decimal_year_by_month(F.col("d")).alias("dec")).distinct(), digits=8)


@register("l03_date_range", "nodes", "SELECT date, round(dec, 6) AS dec, round(bperp, 4) AS bperp FROM nodes WHERE dec >= 1996 AND dec <= 1999")
def _(t):
    return rounded(rounded(P.date_range(t.nodes, 1996.4, 1998.2).select("date", "dec", "bperp"), "dec"), "bperp", digits=4)


@register("l04_acquisitions", "pairs", "SELECT date1 AS date FROM pairs UNION SELECT date2 FROM pairs")
def _(t):
    return P.acquisitions(t.pairs)


def _pair_sql(where: str) -> str:
    return f"SELECT date1, date2, round(n2.dec-n1.dec, 6) AS bt FROM {ENDS} WHERE {where}"


def _bt(df):
    return rounded(df.select("date1", "date2", P.temporal_baseline().alias("bt")))


@register("l05_pairs_keep_short", "pairs nodes", _pair_sql("abs(n2.dec-n1.dec) <= 200/365.1e0"))
def _(t):
    return _bt(P.keep_short(t.pairs, t.nodes, 200))


@register("l06_pairs_drop_short", "pairs nodes", _pair_sql("abs(n2.dec-n1.dec) >= 200/365.1e0"))
def _(t):
    return _bt(P.drop_short(t.pairs, t.nodes, 200))


@register("l07_pairs_anti", "pairs", "SELECT date1, date2, n FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM pairs q WHERE q.n > 20 AND q.date1=p.date1 AND q.date2=p.date2)")
def _(t):
    return P.except_pairs(t.pairs, t.pairs.where("n > 20")).select("date1", "date2", "n")


@register("l08_pairs_spanning_event", "pairs nodes", _pair_sql("n1.dec < 1997.3e0 AND n2.dec > 1997.3e0 AND n1.dec > 1996e0 AND n2.dec < 1999e0"))
def _(t):
    return _bt(P.spanning(t.pairs, t.nodes, 1997.3, 1996.0, 1999.0))


@register("l09_coverage", "px", "SELECT date1, date2, round(1-sum(CASE WHEN phase=0 THEN 1 ELSE 0 END)/count(*), 6) AS coverage FROM px GROUP BY date1, date2")
def _(t):
    return rounded(P.coverage(t.px))


@register("l10_empty_split", "px", "SELECT date1, date2, sum(CASE WHEN phase<>0 THEN 1 ELSE 0 END)::BIGINT AS filled, sum(CASE WHEN phase<>0 THEN 1 ELSE 0 END) < 8 AS empty FROM px GROUP BY date1, date2")
def _(t):
    return P.split_empty(t.px, 8)


@register("l11_images_per_pixel", "px nodes", """SELECT line, col, count(DISTINCT date) AS images FROM (
    SELECT line, col, unnest([date1, date2]) AS date FROM px JOIN nodes n1 ON n1.date=date1 JOIN nodes n2 ON n2.date=date2 WHERE phase<>0 AND abs(n2.dec-n1.dec) >= 5e-1) GROUP BY line, col""")  # fmt: skip
def _(t):
    return P.images_per_pixel(t.px, t.nodes, 0.5)


@register("l12_mean_baseline_per_pixel", "px nodes", "SELECT line, col, round(avg(abs(n2.dec-n1.dec)), 6) AS mean_bt FROM px JOIN nodes n1 ON n1.date=date1 JOIN nodes n2 ON n2.date=date2 WHERE phase<>0 GROUP BY line, col")
def _(t):
    return rounded(P.mean_baseline_per_pixel(t.px, t.nodes))


@register("l13_weights_from_sigma", "pairs", "SELECT date1, date2, round(exp(-rms), 6) AS weight FROM pairs")
def _(t):
    sigmas = t.pairs.select("date1", "date2", F.col("rms").alias("sigma"))
    return rounded(P.weights_from_sigma(t.pairs, sigmas).select("date1", "date2", "weight"))


@register("l14_weights_from_baselines", "pairs nodes", f"SELECT date1, date2, round((CASE WHEN n2.bperp=n1.bperp THEN 0 ELSE exp(-1e2/abs(n2.bperp-n1.bperp)) END+exp(-5e-1/abs(n2.dec-n1.dec)))/2, 6) AS weight FROM {ENDS}")
def _(t):
    return rounded(P.weights_from_baselines(t.pairs, t.nodes, 0.5, 100.0).select("date1", "date2", "weight"))


@register("l15_succeeded", "pairs", "SELECT date1, date2 FROM pairs WHERE rms < 6e-2")
def _(t):
    return P.succeeded(t.pairs.withColumn("success", F.col("rms") < 0.06)).select("date1", "date2")


@register("l16_network", "pairs nodes", f"SELECT date1, date2, round(n1.dec, 6) AS dec1, round(n1.bperp, 4) AS bperp1, round(n2.dec, 6) AS dec2, round(n2.bperp, 4) AS bperp2 FROM {ENDS}")
def _(t):
    found = P.with_baselines(t.pairs, t.nodes, "dec", "bperp").select("date1", "date2", "dec1", "bperp1", "dec2", "bperp2")
    return rounded(rounded(found, "dec1", "dec2"), "bperp1", "bperp2", digits=4)


@register("l17_correction_weights", "px", """SELECT date1, date2, round((c+1-s/max(s) OVER ())/2, 6) AS weight FROM (
    SELECT date1, date2, avg(coh) AS c, stddev_pop(phase) AS s FROM px GROUP BY date1, date2)""")  # fmt: skip
def _(t):
    stats = t.px.groupBy("date1", "date2").agg(F.avg("coh").alias("corr"), F.stddev_pop("phase").alias("std"))
    return rounded(P.correction_weights(stats).select("date1", "date2", "weight"))


@register("l18_consecutive_dates", "nodes", "SELECT date AS date1, nxt AS date2 FROM (SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM nodes) WHERE nxt IS NOT NULL")
def _(t):
    return P.consecutive(t.nodes)


@register("l19_bridges", "stations", """WITH marks AS (SELECT station AS n, line AS col, col AS row, row_number() OVER (ORDER BY station) AS k, lead(line) OVER (ORDER BY station) AS col2, lead(col) OVER (ORDER BY station) AS row2 FROM stations)
    SELECT col::INT AS col1, row::INT AS row1, col2::INT AS col2, row2::INT AS row2 FROM marks WHERE k % 2 = 1 AND col2 IS NOT NULL""")  # fmt: skip
def _(t):
    lines = t.stations.select(F.col("station").alias("n"), F.concat(F.lit("mark COL: "), "line", F.lit(" ROW: "), "col").alias("text"))
    return P.bridges(lines)


@register("l20_task_files", "pairs", """SELECT date1, date2, 'int_' || date1 || '_' || date2 AS directory, date1 || '-' || date2 || '.unw' AS link FROM pairs""")
def _(t):
    return t.pairs.select("date1", "date2", F.concat_ws("_", F.lit("int"), "date1", "date2").alias("directory"), F.concat(F.concat_ws("-", "date1", "date2"), F.lit(".unw")).alias("link"))


# The library of basis functions, each over the dates of all acquisitions.
_ANGLE = "(2*pi()*{0}*(dec-1995e0))"
BASIS = {
    "b01_heaviside": ("CASE WHEN dec-1997e0 >= 0 THEN 1e0 ELSE 0e0 END", lambda x: B.heaviside(x - 1997.0)),
    "b02_box": ("(CASE WHEN dec-1997e0+5e-1 >= 0 THEN 1e0 ELSE 0e0 END)-(CASE WHEN dec-1997e0-5e-1 >= 0 THEN 1e0 ELSE 0e0 END)", lambda x: B.box(x - 1997.0)),
    "b03_step": ("CASE WHEN dec >= 19965e-1 THEN 1e0 ELSE 0e0 END", lambda x: B.step(x, 1996.5)),
    "b04_postseismic": ("log10(1+greatest((dec-19965e-1)/5e-1, 0e0))", lambda x: B.postseismic(x, 1996.5, 0.5)),
    "b05_reference": ("1e0", B.constant),
    "b06_linear": ("dec-1995e0", lambda x: B.linear(x, 1995.0)),
    "b07_growing_seasonal": (f"(dec-1995e0)*(sin({_ANGLE.format('1e0')})+cos({_ANGLE.format('1e0')}))", lambda x: B.growing_harmonic(x, 1995.0) + B.growing_harmonic(x, 1995.0, True)),
    "b08_semiannual": (f"sin({_ANGLE.format('2e0')})+2*cos({_ANGLE.format('2e0')})", lambda x: B.harmonic(x, 1995.0, 2.0) + 2 * B.harmonic(x, 1995.0, 2.0, True)),
    "b09_biannual": (f"sin({_ANGLE.format('5e-1')})+2*cos({_ANGLE.format('5e-1')})", lambda x: B.harmonic(x, 1995.0, 0.5) + 2 * B.harmonic(x, 1995.0, 0.5, True)),
    "b10_annual": (f"sin({_ANGLE.format('1e0')})+2*cos({_ANGLE.format('1e0')})", lambda x: B.harmonic(x, 1995.0, 1.0) + 2 * B.harmonic(x, 1995.0, 1.0, True)),
    "b11_slow_slip": ("5e-1*(1+tanh((dec-1998e0)/4e-1))", lambda x: B.slow_slip(x, 1998.0, 0.4)),
    "b12_degree_days": (
        """sqrt(CASE WHEN day > 3e-1 AND day < 7e-1 THEN day-3e-1 ELSE 7e-1-3e-1 END)
        - sqrt((7e-1-3e-1)/(1-(7e-1-3e-1)))*sqrt(CASE WHEN day > 7e-1 THEN day-7e-1 WHEN day < 3e-1 THEN day+1-7e-1 ELSE 0e0 END)""",
        lambda x: B.degree_days(x, 1995.0, 0.3, 0.7),
    ),
    "b15_temperature": ("3e-1*dec+2*cos(2*pi()*dec)+sin(2*pi()*dec)+5", lambda x: B.temperature(x, 0.3, 2.0, 1.0, 5.0)),
}
for _name, (_sql, _make) in BASIS.items():
    register(_name, "nodes", f"SELECT date, round({_sql}, 6) AS g FROM (SELECT date, round(dec, 6) AS dec, round(dec, 6)-floor(round(dec, 6)) AS day FROM nodes)")(
        lambda t, make=_make: rounded(rounded(t.nodes.select("date", "dec"), "dec").select("date", make(F.col("dec")).alias("g")))
    )


@register("b13_bperp_kernel", "nodes", "SELECT date, round(bperp-(SELECT arg_min(bperp, date) FROM nodes), 4) AS g FROM nodes")
def _(t):
    first = t.nodes.agg(F.min_by("bperp", "date")).first()[0]
    return rounded(t.nodes.select("date", (F.col("bperp") - F.lit(first)).alias("g")), digits=4)


@register("b14_vector_kernel", "nodes", "SELECT date, row_number() OVER (ORDER BY date) AS idx, round(bt*2, 6) AS g FROM nodes")
def _(t):
    from pyspark.sql import Window

    listed = t.nodes.select("date", (F.col("bt") * 2).alias("g")).withColumn("idx", F.row_number().over(Window.partitionBy().orderBy("date")))
    return rounded(t.nodes.select("date").join(listed, "date"))
