"""Feature bags: one file a clip, a matrix of segments by dimensions, as .npy or as text."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAGS = "path string, sha256 string, segments int, dimension int, vectors array<array<float>>, error string"


def parsed(path: str, content: bytes, dimension: int) -> np.ndarray:
    """The matrix in a file; pickled arrays are refused."""
    if path.endswith(".npy"):
        return np.load(io.BytesIO(content), allow_pickle=False).astype(np.float32)
    if path.endswith(".txt"):
        return np.loadtxt(io.BytesIO(content), dtype=np.float32, ndmin=1).reshape(-1, dimension)
    raise ValueError("supported formats: .npy, .txt")


def read_bags(spark: SparkSession, path: str, segments: int = 32, dimension: int = 4096) -> DataFrame:
    """A row per .npy or .txt file below path: path, sha256 (of its bytes), segments, dimension, vectors and error.

    A bag must be a finite matrix of segments by dimension; nothing is reshaped or padded. What is not has an error and no
    vectors, and does not stop the others. Empty files are no rows; registered_bags calls them missing. Files are read by Spark from whatever store they are in and dealt to tasks by
    size, so a bag (half a megabyte at 32 by 4096) is never more than one row of a task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{npy,txt}").load(path)
    files = files.select("path", F.sha2("content", 256).alias("sha256"), "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for name, digest, content in part.itertuples(index=False):
                try:
                    bag = parsed(name, content, dimension)
                    if bag.shape != (segments, dimension) or not np.isfinite(bag).all():
                        raise ValueError(f"expected finite [{segments},{dimension}], got {list(bag.shape)}")
                    out.append((name, digest, *bag.shape, bag.tolist(), None))
                except Exception as failure:  # noqa: BLE001  a broken file is a row with its error
                    out.append((name, digest, None, None, None, f"{type(failure).__name__}: {failure}"[:300]))
            yield pd.DataFrame(out, columns=["path", "sha256", "segments", "dimension", "vectors", "error"]).astype({"segments": "Int32", "dimension": "Int32"})

    return files.mapInPandas(run, BAGS)


def registered_bags(records: DataFrame, bags: DataFrame) -> DataFrame:
    """video_id, state of records (video_id, feature_path, feature_sha256 or null) against bags (path, sha256, error): ready,
    missing, changed (other bytes than registered) or broken."""
    rows = records.join(bags.select(F.col("path").alias("feature_path"), "sha256", "error", F.lit(True).alias("_there")), "feature_path", "left")
    state = F.when(F.col("_there").isNull(), "missing").when(F.col("feature_sha256").isNotNull() & (F.col("feature_sha256") != F.col("sha256")), "changed").when(F.col("error").isNotNull(), "broken").otherwise("ready")
    return rows.select("video_id", state.alias("state"))
