"""Queries that write tables as the text files of the field and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import phase as PH
from ..operators import algebra as L
from ..operators import correction
from ..operators import masks as M
from ..sources import raster as R
from ..sources import sinks
from ..sources import tables as S
from .q_solvers import _export
from .registry import gram_sql, register, rounded
from .tables import Tables


def _text(t: Tables, name: str, df, *columns) -> str:
    """A folder of text lines: the columns with blanks between, a comment line beside them."""
    path = _export(t, name)
    lines = df.select(F.concat_ws(" ", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]).alias("value"))
    lines.union(t.spark.range(1).select(F.lit("# comment line").alias("value"))).write.text(path)
    return path


@register("s08_acquisition_list", "nodes", "SELECT date, round(dec, 6) AS dec, round(bt, 6) AS bt, round(bperp, 6) AS bperp, round(bperp*2, 6) AS bperp2 FROM nodes")
def _(t):
    path = _text(t, "images", t.nodes, F.lit(1), "date", F.lit("x"), "dec", "bt", "bperp", F.col("bperp") * 2)
    return rounded(S.read_acquisitions(t.spark, path, 2).drop("nb"))


@register("s09_pair_list", "pairs", "SELECT date1, date2, CASE WHEN n > 30 THEN round(rms, 6) END AS sigma FROM pairs")
def _(t):
    path = _text(t, "pairs", t.pairs, "date1", "date2", F.when(F.col("n") > 30, F.col("rms")))
    return rounded(S.read_pairs(t.spark, path))


@register("s10_baseline_table", "nodes", "SELECT date, round(bperp, 6) AS bperp, round(bt, 6) AS bt, round(dec, 6) AS dec FROM nodes")
def _(t):
    return rounded(S.read_baselines(t.spark, _text(t, "baselines", t.nodes, "date", "bperp", "bt", F.lit(0), "dec")).select("date", "bperp", "bt", "dec"))


@register("s10b_date_list", "nodes", "SELECT date, round(bperp, 6) AS bperp, round(bt, 6) AS bt, round(dec, 6) AS dec FROM nodes")
def _(t):
    return rounded(S.read_baselines(t.spark, _text(t, "dates", t.nodes, "date", "dec", "bt", "bperp"), "list_dates").select("date", "bperp", "bt", "dec"))


@register("s11_date_weights", "nodes", "SELECT round(sum(bt), 4) AS total, count(*) AS n FROM nodes")
def _(t):
    return rounded(S.read_weights(t.spark, _text(t, "weights", t.nodes, "bt")).agg(F.sum("weight").alias("total"), F.count("*").alias("n")), digits=4)


@register("s12_station_velocities", "stations", "SELECT 'S' || station AS station, round(ve, 6) AS ve, round(se, 6) AS dve, round(vu, 6) AS vup FROM stations")
def _(t):
    path = _text(t, "stations", t.stations, F.concat(F.lit("S"), "station"), F.lit(87.0), F.lit(27.0), "ve", "se", "vn", "sn", "vu", "su")
    return rounded(S.read_stations(t.spark, path).select("station", "ve", "dve", "vup"))


@register("s13_station_series", "nodes", """SELECT component, round(sum(d), 3) AS d, round(sum(s), 3) AS sigma, count(*) AS n FROM (SELECT unnest(['east', 'north', 'up']) AS component, unnest([dec, bt, bperp])*1000 AS d, unnest([bt, dec, 1e0])*1000 AS s FROM nodes) GROUP BY component""")
def _(t):
    path = _text(t, "series", t.nodes, "dec", "dec", "bt", "bperp", "bt", "dec", F.lit(1.0))
    return rounded(S.read_station_series(t.spark, path).groupBy("component").agg(F.sum("d").alias("d"), F.sum("sigma").alias("sigma"), F.count("*").alias("n")), digits=3)


@register("s14_points", "points", "SELECT round(lat, 6) AS lat, round(lon, 6) AS lon, round(value, 6) AS value, round(coh, 6) AS coh FROM points")
def _(t):
    return rounded(S.read_points(t.spark, _text(t, "points", t.points, "lat", "lon", "value", "coh")))


@register("s19_vector_kernel", "nodes", "SELECT round(sum(bperp), 4) AS total, count(*) AS n FROM nodes")
def _(t):
    return rounded(S.read_vectors(t.spark, _text(t, "vector", t.nodes, "bperp")).agg(F.sum("value").alias("total"), F.count("*").alias("n")), digits=4)


# Binary rasters: the tables are written as the files of the field and read back. Files have float32.
_SHAPE = "(SELECT max(line)+1 AS nl FROM dem_grid)"
_FULL = f"SELECT l.range AS line, c.range AS col, value, slope FROM range((SELECT max(line)+1 FROM dem_grid)) l CROSS JOIN range(40) c LEFT JOIN dem_grid d ON d.line=l.range AND d.col=c.range"


def _lines(t: Tables) -> int:
    return t.dem_grid.agg(F.max("line")).first()[0] + 1


def _float32(df, *columns, digits=5):
    return rounded(df.select("line", "col", *columns), digits=digits)


@register("s01_float_grid", "dem_grid", f"SELECT line, col, round(value::FLOAT::DOUBLE, 5) AS value FROM ({_FULL})")
def _(t):
    path = _export(t, "grid")
    sinks.write_r4(t.dem_grid, path + ".r4", 40)
    sinks.write_text(t.spark, path + ".in", f"40 {_lines(t)}\n")
    cols = R.shape_from_lect(R.read_text(t.spark, path + ".in"))[1]
    return _float32(R.read_r4(t.spark, path + ".r4", cols), "value")


for _interleave in ("bsq", "bil", "bip"):

    @register(f"s03_raster_band_{_interleave}", "dem_grid", f"SELECT line, col, round(CASE WHEN slope <> 7 THEN slope::FLOAT::DOUBLE END, 5) AS value FROM ({_FULL}) WHERE line >= 1 AND col >= 3 AND col < 37")
    def _(t, interleave=_interleave):
        path, lines = _export(t, "bands"), _lines(t)
        if interleave == "bil":
            sinks.write_r4(t.dem_grid, path, 40, ("value", "slope"))
        elif interleave == "bsq":
            below = t.dem_grid.select((F.col("line") + lines).alias("line"), "col", F.col("slope").cast("double").alias("value"))
            sinks.write_r4(t.dem_grid.select("line", "col", "value").union(below), path, 40)
        else:
            pairs = t.dem_grid.select("line", F.explode(F.array(F.struct((2 * F.col("col")).alias("col"), "value"), F.struct((2 * F.col("col") + 1).alias("col"), F.col("slope").cast("double").alias("value")))).alias("c")).select("line", "c.*")
            sinks.write_r4(pairs, path, 80)
        sinks.write_text(t.spark, path + ".hdr", sinks.envi_header(lines, 40, 2, "float32", interleave, missing=7.0))
        return _float32(R.read_band(t.spark, path, 2, window=(1, lines, 3, 37)), "value")


_PAIR = f"SELECT line, col, coalesce(slope, 0)::FLOAT::DOUBLE AS amp, coalesce(value, 0)::FLOAT::DOUBLE AS phase FROM ({_FULL})"


def _two_bands(t: Tables, path: str):
    sinks.write_r4(t.dem_grid.select("line", "col", F.col("slope").cast("double").alias("amp"), F.col("value").alias("phase")), path, 40, ("amp", "phase"), missing=0.0)
    sinks.write_text(t.spark, path + ".rsc", f"WIDTH 40\nFILE_LENGTH {_lines(t)}\n")
    return R.read_rmg(t.spark, path, R.shape_from_rsc(R.read_text(t.spark, path + ".rsc"))[1])


@register("s04_two_band_grid", "dem_grid", f"SELECT line, col, round(phase, 5) AS phase, round(amp, 5) AS amp FROM ({_PAIR})")
def _(t):
    return _float32(_two_bands(t, _export(t, "pair") + ".unw"), "phase", "amp")


@register("s05_big_endian_grid", "dem_grid", f"SELECT line, col, round(value::FLOAT::DOUBLE, 5) AS value FROM ({_FULL})")
def _(t):
    path = _export(t, "gamma")
    sinks.write_r4(t.dem_grid, path, 40, kind=">f4")
    sinks.write_text(t.spark, path + ".par", f"title: x\nrange_samples:   40\nazimuth_lines:  {_lines(t)}\n")
    return _float32(R.read_gamma(t.spark, path, R.shape_from_par(R.read_text(t.spark, path + ".par"))[1]), "value")


@register("s05b_big_endian_complex", "dem_grid", f"SELECT line, col, round(coalesce(value, 0)::FLOAT::DOUBLE, 5) AS re, round(coalesce(slope, 0)::FLOAT::DOUBLE, 5) AS im FROM ({_FULL})")
def _(t):
    path = _export(t, "complex")
    pairs = t.dem_grid.select("line", F.explode(F.array(F.struct((2 * F.col("col")).alias("col"), "value"), F.struct((2 * F.col("col") + 1).alias("col"), F.col("slope").cast("double").alias("value")))).alias("c")).select("line", "c.*")
    sinks.write_r4(pairs, path, 80, missing=0.0, kind=">f4")
    return _float32(R.read_gamma(t.spark, path, 40, True), "re", "im")


@register("s06_marked_grid", "dem_grid", f"SELECT line, col, round(value::FLOAT::DOUBLE, 5) AS value FROM ({_FULL})")
def _(t):
    path = _export(t, "marked")
    sinks.write_r4(t.dem_grid, path, 40)
    sinks.write_text(t.spark, path + ".txt", f"40 /* X dimension of the image */\n{_lines(t)} /* Y dimension of the image */\n")
    return _float32(R.read_marked(t.spark, path, path + ".txt"), "value")


@register("s15_delay_grid", "dem_grid", f"SELECT line, col, round(value::FLOAT::DOUBLE, 5) AS value, round(89e0+5e-1*col, 5) AS lon, round(27e0-25e-2*line, 5) AS lat FROM ({_FULL})")
def _(t):
    path = _export(t, "delay") + ".ztd"
    sinks.write_r4(t.dem_grid, path, 40)
    sinks.write_text(t.spark, path + ".rsc", f"WIDTH 40\nFILE_LENGTH {_lines(t)}\nXMIN 0\nXMAX 39\nYMIN 0\nYMAX 1\nX_FIRST 89.0\nY_FIRST 27.0\nX_STEP 0.5\nY_STEP -0.25\n")
    cells, (x0, dx, y0, dy) = R.read_ztd(t.spark, path)
    return _float32(cells.withColumns({"lon": F.lit(x0) + dx * F.col("col"), "lat": F.lit(y0) + dy * F.col("line")}), "value", "lon", "lat")


@register("s18_processing_file", "nodes", "SELECT 'date' AS key, count(*) AS n, sum(date)::DOUBLE AS total FROM nodes UNION ALL SELECT 'limit', 1, 25e-1 UNION ALL SELECT 'flag', 1, 1e0")
def _(t):
    path = _export(t, "job") + ".proc"
    dates = "".join(f"date = {r['date']}  # an image\n" for r in t.nodes.select("date").orderBy("date").collect())  # one row a date
    sinks.write_text(t.spark, path, f"# a job\n{dates}limit = 2.5\nflag = yes\n")
    job = S.Processing(R.read_text(t.spark, path))
    found = {"date": [float(d) for d in job.get("date", int)], "limit": [job.get("limit", float)], "flag": [float(job.get("flag", bool))]}
    return t.spark.createDataFrame([(k, len(v), sum(v)) for k, v in found.items()], "key string, n long, total double")


@register("s20_settings", "points", "SELECT point, round(value, 6) AS value FROM points WHERE lon > 5e-1 AND lon < 3 AND lat > 5e-1 AND lat < 2")
def _(t):
    import json

    path = _export(t, "tie") + ".json"
    sinks.write_text(t.spark, path, json.dumps({"stations": "points", "maps": "value", "bounds": [0.5, 3.0, 0.5, 2.0]}))
    settings = S.TieSettings.read(json.loads(R.read_text(t.spark, path)))
    west, east, south, north = settings.bounds
    rows = getattr(t, settings.stations).where(M.within(west, east, F.col("lon")) & M.within(south, north, F.col("lat")))
    return rounded(rows.select("point", *settings.maps))


@register("k02_georeferenced_raster", "grid", "SELECT CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col, round(value, 6) AS value, round(89e0+1e-1*(col+5e-1), 6) AS x, round(27e0-5e-2*(line+5e-1), 6) AS y FROM grid")
def _(t):
    path = _export(t, "raster")
    sinks.write_raster(t.grid.select("line", "col", "value"), path, "grid", (89.0, 0.1, 27.0, -0.05), block_lines=20)
    return rounded(sinks.read_raster(t.spark, path))


@register("k03_two_band_writer", "dem_grid", f"SELECT line, col, round(phase, 5) AS phase, round(amp, 5) AS amp FROM ({_PAIR})")
def _(t):
    # What was read is written again, and that is read.
    path = _export(t, "again")
    sinks.write_r4(_two_bands(t, path + ".unw"), path + "2.unw", 40, ("amp", "phase"), missing=0.0)
    return _float32(R.read_rmg(t.spark, path + "2.unw", 40), "phase", "amp")


@register("k04_envi_header", "dem_grid", f"SELECT k AS key, v AS value FROM (SELECT unnest(['samples', 'lines', 'bands', 'data type', 'interleave', 'byte order']) AS k, unnest(['40', nl::VARCHAR, '1', '4', 'bip', '0']) AS v FROM {_SHAPE})")
def _(t):
    path, lines = _export(t, "header"), _lines(t)
    sinks.write_text(t.spark, path + ".hdr", sinks.envi_header(lines, 40, 1, "float32", georeference=(89.0, 0.5, 27.0, -0.25)))
    sinks.write_r4(t.dem_grid, path, 40)
    found = R.envi_fields(R.read_text(t.spark, path + ".hdr"))
    if R.read_band(t.spark, path).count() != 40 * lines:
        raise ValueError("the header doesn't fit the raster")
    return t.spark.createDataFrame([(k, found[k]) for k in ("samples", "lines", "bands", "data type", "interleave", "byte order")], "key string, value string")


@register("k08_phase_to_metres", "dem_grid", f"SELECT line, col, round(phase*(56e-3/(4*pi())), 6) AS value FROM ({_PAIR})")
def _(t):
    path = _export(t, "metres")
    sinks.write_displacement(_two_bands(t, path + ".unw"), path, 0.056)
    return _float32(t.spark.read.parquet(path), "value", digits=6)


@register("k09_chunked_cube", "cube", "SELECT pixel, line, col, date, round(disp, 5) AS disp FROM cube")
def _(t):
    path = _export(t, "chunks")
    sinks.write_cube(t.cube.select("pixel", "line", "col", "date", "disp"), path, 2, 20)
    return rounded(sinks.read_chunk(t.spark, path).select("pixel", "line", "col", "date", "disp"), digits=5)


@register("k09b_one_chunk", "cube", "SELECT pixel, date, round(disp, 5) AS disp FROM cube WHERE line >= 2 AND line < 4 AND col >= 20")
def _(t):
    path = _export(t, "chunk")
    sinks.write_cube(t.cube.select("pixel", "line", "col", "date", "disp"), path, 2, 20)
    return rounded(sinks.read_chunk(t.spark, path, 1, 1).select("pixel", "date", "disp"), digits=5)


# Jobs of the pair pipeline that are compositions of operators.
@register("j02_remove_model_from_wrapped", "px", "SELECT date1, date2, line, col, round(coh*cos(phase-model), 6) AS re, round(coh*sin(phase-model), 6) AS im FROM px")
def _(t):
    re, im = PH.rotate(F.col("coh") * F.cos("phase"), F.col("coh") * F.sin("phase"), -F.col("model"))
    return rounded(t.px.select("date1", "date2", "line", "col", re.alias("re"), im.alias("im")))


@register("j03_replace_amplitude", "px", "SELECT date1, date2, line, col, round(coh*cos(phase), 6) AS re, round(coh*sin(phase), 6) AS im FROM px")
def _(t):
    waves = t.px.select("date1", "date2", "line", "col", (F.col("amp") * F.cos("phase")).alias("re"), (F.col("amp") * F.sin("phase")).alias("im"))
    keys = ["date1", "date2", "line", "col"]
    return rounded(L.replace_amplitude(waves, t.px.select(*keys, F.col("coh").alias("value")), keys))


# Phase gradients by height give each first date its law; it goes from the wrapped phase of all its cells and comes back at the end.
@register("j07_flatten_atmosphere", "px", f"""WITH {gram_sql('px', ['date1'], 'model', {'z0': '1e0', 'z1': '((elev-950e0)/1e2)'}, 'coh*coh')},
    m AS (SELECT px.*, CASE WHEN n > 10 THEN m_z0*(elev-950e0)+m_z1*1e-2*(elev-950e0)*(elev-950e0)/2 ELSE 0e0 END AS law FROM px JOIN fitted USING (date1))
    SELECT date1, date2, line, col, round(coh*cos(phase-law), 5) AS re, round(coh*sin(phase-law), 5) AS im, round(law, 4) AS law FROM m""")  # fmt: skip
def _(t):
    keys = ["date1", "date2", "line", "col"]
    waves = t.px.select(*keys, "elev", (F.col("coh") * F.cos("phase")).alias("re"), (F.col("coh") * F.sin("phase")).alias("im"))
    found = correction.flatten_stratified(waves, t.px.select("date1", F.col("model").alias("dphi"), "elev", "coh"), 1, 950.0, ["date1"], min_rows=10)
    return rounded(rounded(found.select(*keys, "re", "im", "law"), "law", digits=4), "re", "im", digits=5)


@register("j11b_zone_reference", "px", """WITH z AS (SELECT date1, date2, avg(phase) AS m FROM px WHERE line > 2 AND line < 9 AND phase <> 0 GROUP BY 1, 2)
    SELECT date1, date2, line, col, round(phase-coalesce(m, 0), 6) AS phase FROM px LEFT JOIN z USING (date1, date2)""")  # fmt: skip
def _(t):
    zone = M.within(2, 9, F.col("line")) & (F.col("phase") != 0)
    return rounded(M.reference_in_space(t.px, zone, "phase", ["date1", "date2"]).select("date1", "date2", "line", "col", "phase"))
