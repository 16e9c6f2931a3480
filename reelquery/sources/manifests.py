"""Manifests and annotation files: strict schemas, guards that raise, and writers that never overwrite."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from reelquery.functions.lineage import checkpoint

#: A video manifest row. temporal_annotations null means unknown, an empty list means annotated as empty.
RECORD = (
    "dataset string, video_id string, source_video_id string, path string, split string, label int, anomaly_type string, duration_sec double, fps double, num_frames long, "
    "temporal_annotations array<array<double>>, feature_path string, feature_sha256 string"
)
SPLITS = ("train", "val", "test")


class ManifestError(ValueError):
    """A file or table breaks its contract."""


def require_none(rows: DataFrame, message: str) -> None:
    """Raise with up to five of the rows if there are any."""
    found = rows.limit(5).collect()
    if found:
        raise ManifestError(f"{message}: {[r.asDict() for r in found]}")


def record_violations(df: DataFrame) -> DataFrame:
    """dataset, video_id, code for every broken rule of a manifest."""
    intervals = F.coalesce("temporal_annotations", F.array().cast("array<array<double>>"))
    fine = F.forall(intervals, lambda x: (F.size(x) == 2) & (x[0] >= 0) & (x[0] < x[1]) & (x[1] <= F.coalesce(F.col("duration_sec"), F.lit(float("inf"))) + 1e-6))
    cases = [
        (F.col("dataset").isNull() | F.col("video_id").isNull() | F.col("source_video_id").isNull() | F.col("path").isNull(), "missing_identity"),
        (~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)), "unknown_split"),
        (~F.coalesce(F.col("label").isin(0, 1), F.lit(False)), "unknown_label"),
        (~F.coalesce(fine, F.lit(False)), "invalid_interval"),
        ((F.col("fps") <= 0) | (F.col("num_frames") <= 0) | (F.col("duration_sec") <= 0), "nonpositive_clock"),
    ]
    own = df.select("dataset", "video_id", F.explode(F.array_compact(F.array(*[F.when(when, code) for when, code in cases]))).alias("code"))
    twice = df.groupBy("dataset", "video_id").agg(F.count("*").alias("n")).where("n > 1").select("dataset", "video_id", F.lit("duplicate_video").alias("code"))
    crossing = df.groupBy("source_video_id").agg(F.count_distinct("split").alias("n")).where("n > 1").select(F.lit(None).cast("string").alias("dataset"), F.col("source_video_id").alias("video_id"), F.lit("source_crosses_splits").alias("code"))
    return reduce(DataFrame.unionByName, [own, twice, crossing])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON lines manifest; malformed lines, an empty file and broken rules raise."""
    df = spark.read.schema(RECORD).option("mode", "FAILFAST").option("allowNonNumericNumbers", False).json(path)
    if df.isEmpty():
        raise ManifestError("the manifest is empty")
    require_none(record_violations(df), "the manifest breaks rules")
    return df


def write_manifest(df: DataFrame, path: str) -> None:
    """JSON lines in the manifest's schema; an existing target is an error."""
    require_none(record_violations(df), "the manifest breaks rules")
    df.select(*[x.split()[0] for x in RECORD.split(", ")]).write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, broken): all-string rows of a CSV with a header of unique names, and records that do not fit it, as they are in
    the column line. Quoted fields may hold line breaks, so a file is the unit of work. Every file starts with the header,
    after a byte order mark or not; a data row that equals it is a row."""
    first = spark.read.text(path).head()
    if first is None:
        raise ManifestError("the file is empty")
    names = next(csv.reader([first["value"].lstrip("\ufeff")]))
    if any(not n.strip() for n in names) or len(set(names)) != len(names):
        raise ManifestError("the header needs unique names that are not blank")
    schema = ", ".join(f"`{n}` string" for n in names) + ", _broken string"
    options = {"header": True, "enforceSchema": False, "multiLine": True, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    parsed = spark.read.schema(schema).options(**options).csv(path)
    broken = checkpoint(parsed.where("_broken IS NOT NULL"))  # Spark reads no corrupt records alone
    return parsed.where("_broken IS NULL").drop("_broken"), broken.select(F.col("_broken").alias("line"))


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Columns in that order, quotes doubled as read_csv() expects them; an existing target is an error."""
    df.select(*columns).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def inventory(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, size, modified of all files below root; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


#: Suffixes of video files, in any case.
VIDEO_SUFFIXES = (".mp4", ".avi", ".mov", ".mkv")


def discover(spark: SparkSession, root: str, suffixes: tuple[str, ...] = VIDEO_SUFFIXES) -> DataFrame:
    """name (the path below root), size of all files with one of the suffixes. Raises if there are none; nothing is read but names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        raise ManifestError(f"no such folder: {root}")
    lower = F.lower("path")
    files = inventory(spark, root).where(reduce(lambda a, b: a | b, [lower.endswith(x) for x in suffixes]))
    if files.isEmpty():
        raise ManifestError(f"no files with {', '.join(suffixes)} below {root}")
    top = f"/{root.rstrip('/').rsplit('/', 1)[-1]}/"
    return files.select(F.substring_index("path", top, -1).alias("name"), "size")


def source_map(text: DataFrame) -> DataFrame:
    """name, source of a JSON object (in a column value, one whole text) that maps file names to recordings. Raises unless it
    is an object of non-empty strings."""
    kind = F.schema_of_variant(F.try_parse_json("value"))
    require_none(text.where(~F.coalesce(kind.startswith("OBJECT"), F.lit(False))).select(F.substring("value", 1, 40).alias("value")), "a source map is a JSON object")
    node = F.parse_json("value").alias("node")
    rows = text.select(node)
    pairs = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("node").outer())).select(F.col("key").alias("name"), F.expr("CASE WHEN schema_of_variant(value) = 'STRING' THEN CAST(value AS STRING) END").alias("source"))
    require_none(pairs.where("source IS NULL OR source = ''").select("name"), "source ids are non-empty strings")
    return pairs


def mapped_sources(files: DataFrame, mapping: DataFrame) -> DataFrame:
    """name, source of files: the mapped recording, or else the name without its suffix."""
    own = F.regexp_replace("name", "[.][^./]*$", "")
    return files.select("name").join(mapping, "name", "left").select("name", F.coalesce("source", own).alias("source"))


def inventory_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change: added, removed or changed between two inventories."""
    old = before.select("path", F.struct("size", "modified").alias("_old"))
    new = after.select("path", F.struct("size", "modified").alias("_new"))
    rows = old.join(new, "path", "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return rows.select("path", change.alias("change")).where("change IS NOT NULL")


def settle_labels(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, quarantined) of rows clip, category, label (strings): clips with one valid (category, label) however often it
    is repeated; invalid rows and clips with conflicting ones are quarantined with a reason."""
    valid = rows.withColumn("_valid", (F.trim("clip") != "") & F.col("label").isin("0", "1"))
    valid = valid.withColumn("_valid", F.coalesce("_valid", F.lit(False)))
    good = valid.where("_valid").groupBy("clip").agg(F.min(F.struct("category", "label")).alias("low"), F.max(F.struct("category", "label")).alias("high"), F.count("*").alias("copies"))
    labels = good.where("low = high").select("clip", "low.category", F.col("low.label").cast("int").alias("label"), "copies")
    bad = valid.where("NOT _valid").select("clip", "category", "label", F.lit("invalid").alias("reason"))
    conflicts = valid.where("_valid").join(good.where("low <> high").select("clip"), "clip", "left_semi").select("clip", "category", "label", F.lit("conflict").alias("reason"))
    return labels, bad.unionByName(conflicts)


def official_splits(records: DataFrame, train: DataFrame, test: DataFrame, name: str = "name") -> DataFrame:
    """records and split from two lists of names, which must part the records exactly."""
    require_none(train.select(name).intersect(test.select(name)), "names are in both lists")
    lists = train.select(name).distinct().withColumn("split", F.lit("train")).unionByName(test.select(name).distinct().withColumn("split", F.lit("test")))
    rows = records.drop("split").join(lists, name, "full_outer")
    require_none(rows.where("split IS NULL").select(name), "records are in no list")
    listed = lists.join(records, name, "left_anti")
    require_none(listed, "listed names have no record")
    return rows


def frame_annotations(lines: DataFrame, records: DataFrame, tolerance: int = 0) -> DataFrame:
    """video_id, start_s, end_s from lines `file category start end [start end ..]` of 1-based inclusive frames (-1 -1: none).
    Ends beyond the last frame by at most tolerance frames are clipped. Pairs that are broken, reversed or further beyond
    it, and files without a record, raise. records: video_id, file (lower case), fps, num_frames."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.trim("value") != "").select(F.lower(parts[0]).alias("file"), F.slice(parts, 3, F.size(parts)).alias("_n"))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.expr("(size(_n) + 1) div 2") - 1, F.lit(0))), lambda i: F.struct(F.get("_n", 2 * i).try_cast("long").alias("start"), F.get("_n", 2 * i + 1).try_cast("long").alias("end")))
    each = rows.select("file", F.explode(pairs).alias("_p")).join(records, "file", "left")
    none = F.coalesce((F.col("_p.start") == -1) & (F.col("_p.end") == -1), F.lit(False))
    fits = (F.col("_p.start") >= 1) & (F.col("_p.start") <= F.col("_p.end")) & (F.col("_p.start") <= F.col("num_frames")) & (F.col("_p.end") <= F.col("num_frames") + tolerance)
    require_none(each.where(F.col("video_id").isNull() | ~(none | F.coalesce(fits, F.lit(False)))).select("file", "_p"), "annotations that fit no record")
    end = F.least(F.col("_p.end"), F.col("num_frames"))
    return each.where(~none).select("video_id", ((F.col("_p.start") - 1) / F.col("fps")).alias("start_s"), (end / F.col("fps")).alias("end_s"))


def scenes(rows: DataFrame, width: int, height: int, every: int = 10) -> DataFrame:
    """sequence, frame, group_label, actors (boxes in unit coordinates with their labels) of rows sequence, frame, x, y, w, h,
    action, for every `every`-th frame. The group's label is the most frequent action, on ties the smallest."""
    kept = rows.where((F.col("frame") % every == 1) & (F.col("w") > 0) & (F.col("h") > 0))
    box = F.struct((F.col("x") / width).alias("x1"), (F.col("y") / height).alias("y1"), ((F.col("x") + F.col("w")) / width).alias("x2"), ((F.col("y") + F.col("h")) / height).alias("y2"), F.col("action").alias("label"))
    votes = kept.groupBy("sequence", "frame", "action").agg(F.count("*").alias("n"))
    first = F.row_number().over(W.partitionBy("sequence", "frame").orderBy(F.col("n").desc(), "action"))
    label = votes.withColumn("_first", first).where("_first = 1").select("sequence", "frame", F.col("action").alias("group_label"))
    actors = kept.groupBy("sequence", "frame").agg(F.array_sort(F.collect_list(box)).alias("actors"))
    return actors.join(label, ["sequence", "frame"]).select("sequence", "frame", "group_label", "actors")
