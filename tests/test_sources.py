"""Binary and text sources and sinks: what is written is read back."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalake.sources import raster, sinks, tables
from stratalake.streaming.coverage import windowed_coverage


def cells(df, *names):
    return {(r["line"], r["col"]): tuple(r[n] for n in names) for r in df.collect()}


def test_r4_and_cube(spark, tmp_path):
    x = np.arange(12, dtype="<f4").reshape(3, 4)
    x[1, 2] = np.nan
    (tmp_path / "a.r4").write_bytes(x.tobytes())
    got = cells(raster.read_r4(spark, str(tmp_path / "a.r4"), 4), "value")
    assert got[2, 3] == (11.0,) and got[1, 2] == (None,) and len(got) == 12
    cube = np.arange(24, dtype="<f4").reshape(3, 4, 2)
    cube[0, 0, 1] = 9990
    (tmp_path / "cube").write_bytes(cube.tobytes())
    wide = raster.read_cube(spark, str(tmp_path / "cube"), 4, 2)
    assert cells(wide, "disp")[0, 0] == ([0.0, None],) and cells(wide, "disp")[2, 3] == ([22.0, 23.0],)
    back = raster.cube_to_wide(raster.cube_to_long(wide), 2)
    assert cells(back, "disp") == cells(wide, "disp")


def test_rmg_gamma_and_writer(spark, tmp_path):
    amp, phase = np.ones((2, 3), "<f4"), np.arange(6, dtype="<f4").reshape(2, 3)
    (tmp_path / "a.unw").write_bytes(np.concatenate([amp, phase], axis=1).astype("<f4").tobytes())
    pair = raster.read_rmg(spark, str(tmp_path / "a.unw"), 3)
    assert cells(pair, "amp", "phase")[1, 2] == (1.0, 5.0)
    sinks.write_r4(pair, str(tmp_path / "b.unw"), 3, ("amp", "phase"), missing=0.0)
    assert (tmp_path / "b.unw").read_bytes() == (tmp_path / "a.unw").read_bytes()
    (tmp_path / "g").write_bytes(phase.astype(">f4").tobytes())
    assert cells(raster.read_gamma(spark, str(tmp_path / "g"), 3), "value")[0, 1] == (1.0,)
    (tmp_path / "c").write_bytes((phase + 1j).astype(">c8").tobytes())
    assert cells(raster.read_gamma(spark, str(tmp_path / "c"), 3, True), "re", "im")[1, 0] == (3.0, 1.0)


def test_headers():
    assert raster.shape_from_lect("200  300\n") == (300, 200)
    rsc = "WIDTH 780\nFILE_LENGTH  300\nX_FIRST 89.17\nX_STEP 0.1\nY_FIRST 27.6\nY_STEP -0.1\n"
    assert raster.shape_from_rsc(rsc) == (300, 780) and raster.georeference(rsc) == (89.17, 0.1, 27.6, -0.1)
    assert raster.shape_from_par("range_samples:  50\nazimuth_lines: 70\n") == (70, 50)
    assert raster.shape_from_marks("100 /* X dimension */\n 80 /* Y dimension */\n") == (80, 100)
    head = sinks.envi_header(3, 4, 2, "float32", georeference=(1.0, 0.1, 2.0, -0.1))
    assert "data type = 4" in head and "lines = 3" in head and "map info" in head


def test_text_tables(spark, tmp_path):
    (tmp_path / "images").write_text("# nb date x dec bt bp\n1 20070218 1 2007.13 0 853\n\n2 20070706 1 2007.51 0.37 0\n")
    assert [tuple(r) for r in tables.read_acquisitions(spark, str(tmp_path / "images")).collect()] == [(1, 20070218, 2007.13, 0.0, 853.0), (2, 20070706, 2007.51, 0.37, 0.0)]
    (tmp_path / "pairs").write_text("20070218 20070706 0.5\n20070218 20080106\n")
    assert [r["sigma"] for r in tables.read_pairs(spark, str(tmp_path / "pairs")).collect()] == [0.5, None]
    (tmp_path / "w").write_text("0.2\n0.3\n")
    assert [r["weight"] for r in tables.read_weights(spark, str(tmp_path / "w")).collect()] == [0.2, 0.3]
    (tmp_path / "KTHM.txt").write_text("2001.5 0.001 0.002 0.003 0.1 0.2 0.3\n")
    got = tables.read_station_series(spark, str(tmp_path / "KTHM.txt")).collect()
    assert [(r["station"], r["component"], round(r["d"], 6)) for r in got] == [("KTHM", "east", 1.0), ("KTHM", "north", 2.0), ("KTHM", "up", 3.0)]
    (tmp_path / "b").write_text("20070218 10 0.5 x 2007.1\n")
    assert tables.read_baselines(spark, str(tmp_path / "b")).first()["dec"] == 2007.1
    (tmp_path / "v").write_text("AAAA 1 2 3 4 5 6 7 8\n")
    assert tables.read_stations(spark, str(tmp_path / "v")).first()["vup"] == 7.0


def test_processing_file():
    p = tables.Processing("a = 1\nlist = x\nlist = y # note\nflag = yes\n", {"d": "2.5"})
    assert p.get("a", int) == 1 and p.get("list") == ["x", "y"] and p.get("flag", bool) is True and p.get("d", float) == 2.5


def test_windows_as_a_stream(spark, tmp_path):
    schema = "ts timestamp, pixel long, value double"
    rows = spark.createDataFrame([("2024-01-01 00:10:00", 1, 2.0), ("2024-01-01 05:00:00", 1, 0.0), ("2024-01-02 01:00:00", 1, 3.0), ("2024-01-09 00:00:00", 2, None)], "ts string, pixel long, value double").select(F.to_timestamp("ts").alias("ts"), "pixel", "value")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = windowed_coverage(stream).writeStream.format("memory").queryName("cov").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    batch = {tuple(r) for r in windowed_coverage(rows).collect()}
    assert {tuple(r) for r in spark.table("cov").collect()} == batch and len(batch) == 3


def files(path):
    return {str(f.relative_to(path)): f.read_bytes() for f in path.rglob("part-*.parquet")}


def test_cells_and_chunks_are_a_file_a_group_of_blocks(spark, tmp_path):
    """As many files as groups of blocks, whatever the number of tasks; an update leaves other blocks and other folders alone."""
    grid = spark.range(0, 4000, 1, 16).select((F.col("id") % 1000).alias("line"), F.floor(F.col("id") / 1000).alias("col"), F.col("id").cast("double").alias("value")).repartition(16)
    sinks.write_cells(grid, str(tmp_path / "cells"), 5)
    before, all_cells = files(tmp_path / "cells"), cells(grid, "value")
    assert len(before) == 2 and cells(sinks.read_cells(spark, str(tmp_path / "cells")), "value") == all_cells
    assert cells(sinks.read_cells(spark, str(tmp_path / "cells"), 150), "value") == {k: v for k, v in all_cells.items() if k[0] // 5 == 150}
    window = grid.where("line >= 505 and line < 508").withColumn("value", -F.col("value"))
    sinks.update_window(window, str(tmp_path / "cells"), 5)
    want = {k: v for k, v in all_cells.items() if k[0] // 5 != 101} | cells(window, "value")
    assert cells(sinks.read_cells(spark, str(tmp_path / "cells")), "value") == want
    after = files(tmp_path / "cells")
    assert len(after) == 2 and len(set(before.items()) & set(after.items())) == 1
    sinks.update_window(window, str(tmp_path / "new"), 5)
    assert cells(sinks.read_cells(spark, str(tmp_path / "new")), "value") == cells(window, "value")
    sinks.write_cube(grid, str(tmp_path / "cube"), 2, 2)
    assert len(files(tmp_path / "cube")) == 5
    assert cells(sinks.read_chunk(spark, str(tmp_path / "cube"), 301, 1), "value") == {k: v for k, v in all_cells.items() if k[0] // 2 == 301 and k[1] >= 2}
    assert cells(sinks.read_chunk(spark, str(tmp_path / "cube"), col_block=0), "value") == {k: v for k, v in all_cells.items() if k[1] < 2}


def test_malformed_shapes():
    with pytest.raises(KeyError):
        raster.shape_from_rsc("WIDTH 3\n")
