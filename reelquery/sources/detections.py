"""Detection files and feature bags: versioned JSON lines with explicit empty frames, and shape checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.sources.manifests import require_none

VERSION, COORDINATES = 1, "absolute_xyxy"
#: A frame's detections. A frame without people is a row with an empty list, never a missing row.
DETECTIONS = "version int, coordinates string, dataset string, clip_id string, image_size array<int>, detections array<struct<box: array<double>, score: double, class_id: long>>, metadata map<string, string>"


def canonical(detections: Column) -> Column:
    """Detections in the order of center, corners, falling score and class."""
    key = lambda d: F.struct(((d["box"][0] + d["box"][2]) / 2).alias("cx"), ((d["box"][1] + d["box"][3]) / 2).alias("cy"), d["box"].alias("box"), (-d["score"]).alias("low"), d["class_id"].alias("class_id"), d.alias("row"))
    return F.transform(F.array_sort(F.transform(detections, key)), lambda x: x["row"])


def detection_violations(df: DataFrame) -> DataFrame:
    """dataset, clip_id, code for every broken rule."""
    box = lambda d: (F.size(d["box"]) == 4) & F.forall(d["box"], lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & (d["box"][0] < d["box"][2]) & (d["box"][1] < d["box"][3])
    whole = F.forall("detections", lambda d: F.coalesce(box(d) & (d["score"] >= 0) & (d["score"] <= 1), F.lit(False)))
    cases = [
        (~F.col("version").eqNullSafe(VERSION) | ~F.col("coordinates").eqNullSafe(COORDINATES), "unsupported_format"),
        (F.col("clip_id").isNull() | F.col("dataset").isNull(), "missing_identity"),
        (F.col("detections").isNull() | ~F.coalesce(whole, F.lit(False)), "invalid_detection"),
    ]
    own = df.select("dataset", "clip_id", F.explode(F.array_compact(F.array(*[F.when(when, code) for when, code in cases]))).alias("code"))
    twice = df.groupBy("dataset", "clip_id").agg(F.count("*").alias("n")).where("n > 1").select("dataset", "clip_id", F.lit("duplicate_clip").alias("code"))
    return own.unionByName(twice)


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """Detections of a file in canonical order; malformed lines and broken rules raise."""
    df = spark.read.schema(DETECTIONS).option("mode", "FAILFAST").option("allowNonNumericNumbers", False).json(path)
    require_none(detection_violations(df), "the detections break rules")
    return df.withColumn("detections", canonical(F.col("detections")))


def write_detections(df: DataFrame, path: str) -> None:
    """JSON lines in canonical order, sorted by clip within files; an existing target is an error."""
    require_none(detection_violations(df), "the detections break rules")
    rows = df.withColumn("detections", canonical(F.col("detections"))).select(*[x.split()[0] for x in DETECTIONS.split(", ") if x.split()[0] in df.columns])
    rows.repartitionByRange("dataset", "clip_id").sortWithinPartitions("dataset", "clip_id").write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def bag_violations(df: DataFrame, bag: str, segments: int, dimensions: int, key: str = "video_id") -> DataFrame:
    """key, code of bags (arrays of vectors) that have another shape or hold numbers that are not finite."""
    shape = (F.size(bag) == segments) & F.forall(bag, lambda v: F.size(v) == dimensions)
    finite = F.forall(bag, lambda v: F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    code = F.when(~F.coalesce(shape, F.lit(False)), "shape").when(~F.coalesce(finite, F.lit(False)), "not_finite")
    return df.select(key, code.alias("code")).where("code IS NOT NULL")


def scene_violations(df: DataFrame) -> DataFrame:
    """key, code of a scene manifest (source_id, video_id, center_frame, split, frame_paths, actors with boxes in unit
    coordinates): repeated scenes, identities or files that cross splits, and boxes that are none."""
    key = F.concat_ws("/", "source_id", "video_id", F.col("center_frame").cast("string"))
    twice = df.groupBy("source_id", "center_frame").agg(F.count("*").alias("n"), F.first(key).alias("key")).where("n > 1").select("key", F.lit("duplicate_scene").alias("code"))
    rows = twice
    for name in ("source_id", "video_id"):
        rows = rows.unionByName(df.groupBy(F.col(name).alias("key")).agg(F.count_distinct("split").alias("n")).where("n > 1").select("key", F.lit(f"{name}_crosses_splits").alias("code")))
    paths = df.select("split", F.explode("frame_paths").alias("key")).groupBy("key").agg(F.count_distinct("split").alias("n")).where("n > 1")
    rows = rows.unionByName(paths.select("key", F.lit("path_crosses_splits").alias("code")))
    fine = F.forall("actors", lambda a: (a["x1"] >= 0) & (a["y1"] >= 0) & (a["x2"] <= 1) & (a["y2"] <= 1) & (a["x1"] < a["x2"]) & (a["y1"] < a["y2"]))
    return rows.unionByName(df.where(~F.coalesce(fine, F.lit(False)) | (F.size("actors") == 0)).select(key.alias("key"), F.lit("invalid_actor").alias("code")))
