"""What the operators share on the Spark side: cutting lineage and partition counts."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def use_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's shared folder from spark.checkpoint.dir; a folder of our own only where all of Spark is one process."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = context.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="stratalake-checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read from there: a lost executor costs no recomputation upstream."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Shuffle files of what has been checkpointed go now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _release() -> None:
    """Memory that a task no longer needs goes back to the machine; the worker process lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow, with the worker's memory released behind each task; for DataFrame.transform."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        _release()

    return df.mapInArrow(run, schema)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, under names of our own, so that no other column can clash."""
    return df.select([df[f"`{source}`"].alias(name) for name, source in columns.items()])


def free_name(df: DataFrame, name: str) -> str:
    """A column name like `name` that the table lacks, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: A key is hot that holds more than one in so many rows; there are fewer such keys than this, whatever the data.
HOT_SHARE = 1000


def hot_keys(counted: DataFrame, on: str, n: str) -> DataFrame:
    """The hot ones of a table with a row a key and the number of rows that have it: fewer than HOT_SHARE."""
    total = counted.agg(F.sum(n)).first()[0] or 0
    return checkpoint(counted.where(F.col(n) * HOT_SHARE > total).select(on))


def join_skewed(rows: DataFrame, keyed: DataFrame, on: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with a table of one row a key: hot keys meet where the rows are, the others by a shuffle in which no key weighs much."""
    few = F.broadcast(hot)
    near = rows.join(few, on, "left_semi").join(F.broadcast(keyed.join(few, on, "left_semi")), on, how)
    return near.unionByName(rows.join(few, on, "left_anti").join(keyed.join(few, on, "left_anti"), on, how))


#: Edges of a component search for each task; small searches run in few tasks and leave few files.
EDGES_PER_TASK = 20_000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of the nodes that occur in `edges` (a, b); component is the smallest node that links reach.

    Alternates large-star and small-star rounds, each of them an aggregation
    with partial sums and a join of narrow rows.  Every round is checkpointed.  Self-links
    and null ends are left out; an empty table gives an empty one.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges = checkpoint(edges)
    tasks = min(partitions(edges.sparkSession), 4 + edges.count() // EDGES_PER_TASK)
    edges, before = edges.coalesce(tasks), None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = checkpoint(large.where("u > v").coalesce(tasks).distinct().coalesce(tasks))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = checkpoint(small.where("u > v").coalesce(tasks).distinct().coalesce(tasks))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("v", "v"))
