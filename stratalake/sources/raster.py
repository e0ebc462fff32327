"""Binary rasters as tables: one row a cell, decoded from records of a line each.

Any file system that Spark reads will do.  A single file is read as fixed-length
records, which Hadoop's input format splits over tasks, so its size doesn't
matter; a pattern or folder of many files is read file by file, each by one
task (2 GB a file at most).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "line long, col long, value double"


def shape_from_lect(text: str) -> tuple[int, int]:
    """(lines, cols) of a one-line `cols lines [bands]` text."""
    cols, lines = map(int, text.split()[:2])
    return lines, cols


def header(text: str) -> dict[str, str]:
    """`KEY value` lines of a resource file."""
    return {parts[0]: parts[1].strip() for line in text.splitlines() if len(parts := line.split(None, 1)) == 2}


def shape_from_rsc(text: str) -> tuple[int, int]:
    found = header(text)
    return int(found["FILE_LENGTH"]), int(found["WIDTH"])


def georeference(text: str) -> tuple[float, float, float, float]:
    """(x0, dx, y0, dy) of a resource file."""
    found = header(text)
    return tuple(float(found[k]) for k in ("X_FIRST", "X_STEP", "Y_FIRST", "Y_STEP"))


def shape_from_par(text: str) -> tuple[int, int]:
    """(lines, cols) of a parameter file with `azimuth_lines:` and `range_samples:`."""
    number = lambda name: int(re.search(rf"^\s*{name}\s*:\s*(\d+)", text, re.M)[1])
    return number("azimuth_lines"), number("range_samples")


def shape_from_marks(text: str, lines_mark: str = "Y.*dim", cols_mark: str = "X.*dim") -> tuple[int, int]:
    """(lines, cols) of a text that names each size behind a number on its line."""
    number = lambda mark: int(next(re.match(r"\s*(\d+)", line)[1] for line in text.splitlines() if re.search(mark, line, re.I)))
    return number(lines_mark), number(cols_mark)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text, read by Spark."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]).decode("utf-8", "replace")


def _single_file(spark: SparkSession, path: str) -> str | None:
    """The file's full name, if the path names one file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where) or not system.getFileStatus(where).isFile():
        return None
    return system.getFileStatus(where).getPath().toString()


def _records(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(file, line, content): fixed-length records in their order."""
    if name := _single_file(spark, path):
        # The only use of an RDD: no DataFrame source splits a headerless file.
        numbered = spark.sparkContext.binaryRecords(path, size).zipWithIndex().map(lambda r: (name, r[1], bytearray(r[0])))
        return spark.createDataFrame(numbered, "file string, line long, content binary")
    files = spark.read.format("binaryFile").load(path).select("path", "content", "length")
    count = F.floor(F.col("length") / size).cast("int")
    return files.select(F.col("path").alias("file"), "content", F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1))).alias("line")).select(
        "file", F.col("line").cast("long").alias("line"), F.substring("content", F.col("line") * size + 1, F.lit(size)).alias("content")
    )


def _decode(records: DataFrame, kind: str, columns: dict[str, tuple[int, int]], parts: int = 1) -> DataFrame:
    """Records (file, line, content) of numbers as cells; columns: name -> (first number, step) of a cell's value."""
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, line, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                numbers = np.frombuffer(content, kind)
                values = [numbers[first::step] if parts == 1 else numbers[first : first + len(numbers) // parts] for first, step in columns.values()]
                n = len(values[0])
                out = []
                for v in values:
                    v = v.astype(float)
                    out.append(pa.array(v, mask=np.isnan(v)))
                yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(np.full(n, line)), pa.array(np.arange(n)), *out], names=["file", "line", "col", *names])

    return records.mapInArrow(run, "file string, line long, col long, " + ", ".join(f"{n} double" for n in names))


def read_r4(spark: SparkSession, path: str, cols: int) -> DataFrame:
    """Headerless little-endian float32 grid."""
    return _decode(_records(spark, path, 4 * cols), "<f4", {"value": (0, 1)})


def read_cube(spark: SparkSession, path: str, cols: int, dates: int, missing: tuple[float, ...] = (9990.0, 9999.0)) -> DataFrame:
    """Pixel-interleaved float32 cube: line, col, disp array over dates, the listed values null."""
    records = _records(spark, path, 4 * cols * dates)

    def run(batches):
        for batch in batches:
            for file, line, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                x = np.frombuffer(content, "<f4").astype(float)
                flat = pa.array(x, mask=np.isnan(x) | np.isin(x, missing))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, dates), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array([file] * cols), pa.array(np.full(cols, line)), pa.array(np.arange(cols)), lists], names=["file", "line", "col", "disp"])

    return records.mapInArrow(run, "file string, line long, col long, disp array<double>")


def cube_to_long(wide: DataFrame, keys: tuple[str, ...] = ("line", "col")) -> DataFrame:
    return wide.select(*keys, F.posexplode("disp").alias("idx", "disp"))


def cube_to_wide(long: DataFrame, dates: int, keys: tuple[str, ...] = ("line", "col")) -> DataFrame:
    """Arrays over all dates, null where a date has no row."""
    held = long.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("idx", "disp"))).alias("m"))
    return held.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(dates - 1)), lambda i: F.element_at("m", i)).alias("disp"))


def read_rmg(spark: SparkSession, path: str, cols: int) -> DataFrame:
    """Line-interleaved two-band file: first band amplitude (or coherence), second phase."""
    return _decode(_records(spark, path, 8 * cols), "<f4", {"amp": (0, 1), "phase": (cols, 1)}, parts=2)


def read_gamma(spark: SparkSession, path: str, cols: int, complex_values: bool = False) -> DataFrame:
    """Big-endian float32 or complex64 grid."""
    if complex_values:
        return _decode(_records(spark, path, 8 * cols), ">f4", {"re": (0, 2), "im": (1, 2)})
    return _decode(_records(spark, path, 4 * cols), ">f4", {"value": (0, 1)})


#: The numpy kinds of ENVI data type codes.
ENVI_KINDS = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 6: "c8", 9: "c16", 12: "u2", 13: "u4", 14: "i8", 15: "u8"}


def envi_fields(text: str) -> dict[str, str]:
    """`key = value` lines of an ENVI header, keys in lower case."""
    return {k.strip().lower(): v.strip() for line in text.splitlines() if "=" in line for k, v in [line.split("=", 1)]}


def read_band(spark: SparkSession, path: str, band: int = 1, header_path: str | None = None, missing: float | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """One band (from 1) of a raster with an ENVI header beside it (`path`.hdr): bsq, bil or bip, any real type, either byte order.

    Cells equal to `missing`, by default the header's data ignore value, are
    null, as is NaN; window is (line begin, line end, col begin, col end), the
    ends not included, and the cells keep the places they have in the raster.
    """
    h = envi_fields(read_text(spark, header_path or path + ".hdr"))
    lines, cols, bands = int(h["lines"]), int(h["samples"]), int(h["bands"])
    if int(h.get("header offset", 0)):
        raise ValueError("a raster with a header inside its file")
    kind = (">" if h.get("byte order", "0") == "1" else "<") + ENVI_KINDS[int(h["data type"])]
    if not 1 <= band <= bands:
        raise ValueError(f"band {band} of {bands}")
    absent = missing if missing is not None else float(h["data ignore value"]) if "data ignore value" in h else None
    interleave, width = h["interleave"].lower(), np.dtype(kind).itemsize
    if interleave == "bsq":  # records of a line of one band, band after band
        records = _records(spark, path, width * cols).where((F.col("line") >= lines * (band - 1)) & (F.col("line") < lines * band))
        cells = _decode(records.withColumn("line", F.col("line") - lines * (band - 1)), kind, {"value": (0, 1)})
    elif interleave == "bil":
        cells = _decode(_records(spark, path, width * cols * bands), kind, {"value": (cols * (band - 1), 1)}, parts=bands)
    else:
        cells = _decode(_records(spark, path, width * cols * bands), kind, {"value": (band - 1, bands)})
    if absent is not None:
        cells = cells.withColumn("value", F.when(F.col("value") != F.lit(float(absent)), F.col("value")))
    if window:
        cells = cells.where((F.col("line") >= window[0]) & (F.col("line") < window[1]) & (F.col("col") >= window[2]) & (F.col("col") < window[3]))
    return cells


def read_marked(spark: SparkSession, path: str, text_path: str, lines_mark: str = "Y.*dim", cols_mark: str = "X.*dim") -> DataFrame:
    """Headerless little-endian float32 grid, its shape from the marked lines of a text."""
    return read_r4(spark, path, shape_from_marks(read_text(spark, text_path), lines_mark, cols_mark)[1])


def read_window(raster: DataFrame, first_line: int, lines: int) -> DataFrame:
    """A block of lines of a stored table; a filter that parquet's statistics and partitions take up."""
    return raster.where((F.col("line") >= first_line) & (F.col("line") < first_line + lines))


def read_ztd(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[float, float, float, float]]:
    """Atmospheric delay grid with its resource file beside it -> (cells, georeference)."""
    text = read_text(spark, path + ".rsc")
    _, cols = shape_from_rsc(text)
    return read_r4(spark, path, cols), georeference(text)
