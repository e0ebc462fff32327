"""Sinks: tables of cells, text tables, headers and headerless binary grids."""

from __future__ import annotations

import contextlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint

# The data type codes of ENVI headers.
ENVI_CODES = {"uint8": 1, "int16": 2, "int32": 3, "float32": 4, "float64": 5, "complex64": 6, "complex128": 9, "uint16": 12, "uint32": 13, "int64": 14, "uint64": 15}


#: Neighbouring blocks of lines that share a folder. A folder a block would cost as much for a few cells as for many.
FOLDER_BLOCKS = 100


def _blocked(df: DataFrame, block_lines: int) -> DataFrame:
    block = F.floor(F.col("line") / block_lines)
    return df.withColumns({"line_block": block, "line_group": F.floor(block / FOLDER_BLOCKS)})


def _by_folders(blocked: DataFrame, *blocks: str) -> DataFrameWriter:
    """A writer of a folder a group of blocks, these in order in its files. A group's rows meet before, so that its files are as many as its size asks for and not as many as there are tasks."""
    return blocked.hint("rebalance", "line_group").sortWithinPartitions("line_group", *blocks).write.mode("overwrite").partitionBy("line_group")


def write_cells(df: DataFrame, path: str, block_lines: int = 100) -> None:
    """Parquet by blocks of lines, in order, so that a window read opens only its folders and decodes only its pages."""
    _by_folders(_blocked(df, block_lines), "line_block").parquet(path)


def _of_block(stored: DataFrame, line_block: int | None) -> DataFrame:
    if line_block is None:
        return stored
    return stored.where((F.col("line_group") == line_block // FOLDER_BLOCKS) & (F.col("line_block") == line_block))


def read_cells(spark: SparkSession, path: str, line_block: int | None = None) -> DataFrame:
    """What write_cells wrote, all or one block of lines."""
    return _of_block(spark.read.parquet(path), line_block).drop("line_block", "line_group")


def update_window(df: DataFrame, path: str, block_lines: int = 100) -> None:
    """Replace the blocks that the rows belong to; the others stay, and only folders of replaced blocks are written again."""
    spark, new = df.sparkSession, checkpoint(_blocked(df, block_lines))
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = new
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        groups = [r[0] for r in new.select("line_group").distinct().collect()]  # one number a folder
        held = spark.read.parquet(path).where(F.col("line_group").isin(groups)).join(new.select("line_block").distinct(), "line_block", "left_anti")
        out = new.unionByName(held.select(*[F.col(c).cast(new.schema[c].dataType) for c in new.columns]))
    _by_folders(out, "line_block").option("partitionOverwriteMode", "dynamic").parquet(path)


def binary_lines(df: DataFrame, cols: int, values: tuple[str, ...] = ("value",), missing: float = float("nan"), kind: str = "<f4") -> DataFrame:
    """(line, content): each line's cells as binary numbers, bands of a line one after the other."""
    cells = df.select("line", F.struct("col", *values).alias("c")).groupBy("line").agg(F.collect_list("c").alias("cells"))

    def run(batches):
        for batch in batches:
            out = []
            for cells_ in batch.column(1).to_pylist():
                row = np.full((len(values), cols), missing)
                for c in cells_:
                    for k, name in enumerate(values):
                        if c[name] is not None:
                            row[k, c["col"]] = c[name]
                out.append(row.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["line", "content"])

    return cells.mapInArrow(run, f"line {df.schema['line'].dataType.simpleString()}, content binary")


def write_r4(df: DataFrame, path: str, cols: int, values: tuple[str, ...] = ("value",), missing: float = float("nan"), kind: str = "<f4") -> None:
    """One headerless file on any file system that Spark writes, line after line.

    The format is one file, so the sorted lines pass through the driver, a
    partition at a time; `write_cells` is the sink that all tasks write.
    """
    with _created(df.sparkSession, path) as out:
        for row in binary_lines(df, cols, values, missing, kind).orderBy("line").toLocalIterator():
            out.write(bytearray(row["content"]))


@contextlib.contextmanager
def _created(spark: SparkSession, path: str):
    """A new file's stream, by Hadoop's file system of the path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        yield out
    finally:
        out.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file: headers and shapes beside a raster."""
    with _created(spark, path) as out:
        out.write(bytearray(text.encode()))


def write_raster(df: DataFrame, path: str, name: str, georeference: tuple[float, float, float, float], epsg: int = 4326, block_lines: int = 100) -> None:
    """Cells by blocks of lines and, beside them, the georeference that they carry over from their source."""
    write_cells(df, f"{path}/cells", block_lines)
    metadata(df.sparkSession, name, georeference, epsg).coalesce(1).write.mode("overwrite").json(f"{path}/georeference")


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    """What write_raster wrote: the cells with their centres' coordinates x and y."""
    known = spark.read.schema("raster string, x0 double, dx double, y0 double, dy double, epsg int").json(f"{path}/georeference").first()
    cells = read_cells(spark, f"{path}/cells")
    return cells.withColumns({"x": F.lit(known["x0"]) + F.lit(known["dx"]) * (F.col("col") + 0.5), "y": F.lit(known["y0"]) + F.lit(known["dy"]) * (F.col("line") + 0.5)})


def write_displacement(pair: DataFrame, path: str, wavelength: float, block_lines: int = 100) -> None:
    """The phase band of a two-band raster as metres along the line of sight: phase times wavelength / (4 pi)."""
    metres = pair.select("line", "col", (F.col("phase") * F.lit(wavelength / (4 * math.pi))).alias("value"))
    write_cells(metres, path, block_lines)


def write_cube(cube: DataFrame, path: str, block_lines: int = 100, block_cols: int = 100) -> None:
    """A long cube by chunks of lines and columns, all dates of a chunk together and chunks in order, so that a solver's block is a few pages of a few files."""
    _by_folders(_blocked(cube, block_lines).withColumn("col_block", F.floor(F.col("col") / block_cols)), "line_block", "col_block").parquet(path)


def read_chunk(spark: SparkSession, path: str, line_block: int | None = None, col_block: int | None = None) -> DataFrame:
    """A cube's chunks, all or those of a block of lines or columns; of a block of lines only its folder is opened."""
    cube = _of_block(spark.read.parquet(path), line_block)
    if col_block is not None:
        cube = cube.where(F.col("col_block") == col_block)
    return cube.drop("line_block", "col_block", "line_group")


def envi_header(lines: int, cols: int, bands: int, dtype: str, interleave: str = "bip", georeference: tuple[float, float, float, float] | None = None, missing: float | None = None) -> str:
    """Text of an ENVI header."""
    out = ["ENVI", f"samples = {cols}", f"lines = {lines}", f"bands = {bands}", "header offset = 0", "file type = ENVI Standard", f"data type = {ENVI_CODES[dtype]}", f"interleave = {interleave}", "byte order = 0"]
    if missing is not None:
        out.append(f"data ignore value = {missing}")
    if georeference:
        x0, dx, y0, dy = georeference
        out.append(f"map info = {{Geographic Lat/Lon, 1, 1, {x0}, {y0}, {abs(dx)}, {abs(dy)}, WGS-84}}")
    return "\n".join(out) + "\n"


def metadata(spark, name: str, georeference: tuple[float, float, float, float], epsg: int = 4326) -> DataFrame:
    """A raster's georeference as a row."""
    return spark.createDataFrame([(name, *georeference, epsg)], "raster string, x0 double, dx double, y0 double, dy double, epsg int")


def write_text_table(df: DataFrame, path: str, decimals: int = 10) -> None:
    """Blank-separated text with doubles rounded."""
    columns = [F.format_number(c, decimals) if t == "double" else F.col(c).cast("string") for c, t in df.dtypes]
    df.select(F.concat_ws(" ", *[F.regexp_replace(c, ",", "") for c in columns]).alias("value")).write.mode("overwrite").text(path)


def stack_dates(maps: list[tuple[int, DataFrame]]) -> DataFrame:
    """Maps of dates as one table with a date column."""
    out = None
    for date, df in maps:
        part = df.withColumn("date", F.lit(date))
        out = part if out is None else out.unionByName(part)
    return out


def copy_band(raster: DataFrame, two_bands: bool) -> DataFrame:
    """The band that format copies take: the second of a two-band file, else the only one."""
    return raster.select("line", "col", (F.col("phase") if two_bands else F.col("value")).alias("value"))
