"""Cutting lineage: intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of a small intermediate table that one task reads at once.
ROWS_AT_ONCE = 200_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where it is unset, a session of one machine gets a folder of
    its own; on a cluster that is an error, as executors would not see each other's files."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="reelquery-checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> tuple[DataFrame, int]:
    """df, checkpointed and read in as few partitions as its rows need, and the number of its rows. A table of up to
    ROWS_AT_ONCE rows is one partition, so what is joined or grouped with its like needs no further shuffle; larger ones
    are shuffled as usual."""
    seen = Observation()
    kept = checkpoint(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    rows = seen.get["rows"]
    return kept.coalesce(max(1, -(-rows // ROWS_AT_ONCE))), rows


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate files, in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
