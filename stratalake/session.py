"""What every part needs from the session: cutting lineage in the folder that the cluster names."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def use_checkpoint_dir(spark: SparkSession) -> None:
    """The shared folder from spark.checkpoint.dir; a folder of our own only where all of Spark is one process."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = context.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="stratalake-"))


def checkpoint(df: DataFrame) -> DataFrame:
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
