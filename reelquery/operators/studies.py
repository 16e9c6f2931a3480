"""Experiment-level operators: populations, sweeps, selections, comparisons and bounded samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from reelquery.functions.lineage import checkpoint
from reelquery.functions.prefix import ratio
from reelquery.operators.geometry import matched_by_level
from reelquery.operators.intervals import evenly
from reelquery.operators.metrics import count_if, rates


def behavior_class(category: Column, binary: Column, classes: list[str], excluded: list[str]) -> Column:
    """Class number of a category: 0 for a negative label, null for excluded categories and contradictions."""
    position = F.array_position(F.array(*map(F.lit, classes)), category) - 1
    return F.when(category.isin(*excluded) | ~binary.isin(0, 1) | (position < 0) | ((position == 0) & (binary == 1)), F.lit(None)).when(binary == 0, 0).otherwise(position).cast("int")


def guard_group(dataset: Column, supplied: Column, verified: Column, tour: Column) -> Column:
    """The group that must not be split: the verified recording, else the tour it is known to belong to, else the whole
    collection."""
    return (  # fixed values: names of collections and groups
        F.when(F.lower(verified).eqNullSafe("true") & supplied.isNotNull(), F.concat(F.lit("recording:"), supplied))
        .when((dataset == "WalkIndia-50") & tour.contains("tour-"), tour)
        .when(dataset == "WalkIndia-50", "walkindia-entire-release-unresolved")
        .otherwise(F.concat(F.lower(dataset), F.lit("-entire-collection-unresolved")))
    )


def family_hint(dataset: Column, verified: Column, stem: Column) -> Column:
    """The family that a clip's file name suggests, in collections that number their clips; null for verified recordings and
    names without one. A hint is no proof of one incident."""
    numbered = stem.rlike(r"^(?:s_)?\d+(?:_\d+)?$")
    snatch = F.when(numbered, F.when(stem.startswith("s_"), stem).otherwise(F.regexp_replace(stem, r"_\d+$", "")))
    series = F.when(stem.rlike(r"^krishna-clip-\d+$"), "krishna-clip-series")
    return F.when(F.lower(verified).eqNullSafe("true"), F.lit(None)).when(dataset == "Snatch-1.0", snatch).when(dataset == "HCI-User-Collection", series)


def recording_key(collection: Column, stem: Column) -> Column:
    """A key that clips of one recording share by the naming of their collection; null without one."""
    scene = F.regexp_extract(stem, r"^(.+-Scene-\d+)-", 1)
    return F.when((collection == "WalkIndia-50") & (scene != ""), F.concat(F.lit("walkindia-"), scene)).when((collection != "WalkIndia-50") & stem.startswith("krishna-clip-"), "hci-krishna")


def capture_time(name: Column, pattern: str = r"(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})(\d{2})") -> Column:
    """The timestamp in a file name; null without one or where it is no date."""
    parts = F.concat_ws("", *[F.regexp_extract(name, pattern, i) for i in range(1, 7)])
    return F.try_to_timestamp(F.when(parts != "", parts), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def subset_metrics(df: DataFrame, subsets: dict[str, Column], threshold: float, label: str = "label", score: str = "score") -> DataFrame:
    """A row of counts and rates per named, possibly overlapping subset, in one pass."""
    named = F.array_compact(F.array(*[F.when(when, name) for name, when in subsets.items()]))
    hit, truth = F.col(score) >= threshold, F.col(label) == 1
    rows = df.withColumn("subset", F.explode(named)).groupBy("subset")
    return rates(rows.agg(count_if(~truth & ~hit).alias("tn"), count_if(~truth & hit).alias("fp"), count_if(truth & ~hit).alias("fn"), count_if(truth & hit).alias("tp")))


def spanning_sample(df: DataFrame, most: int, split: str = "split", label: str = "label", key: str = "clip_id") -> DataFrame:
    """At most `most` rows of train and val: first one of every (split, label), then by id."""
    rows = df.where(F.col(split).isin("train", "val"))
    first = rows.groupBy(split, label).agg(F.min(key).alias("_first"))
    rows = rows.join(first, [split, label])
    return rows.orderBy((F.col(key) != F.col("_first")).cast("int"), key).limit(most).select(*df.columns)


def confusion_by(df: DataFrame, by: list[str], classes: int, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """by, truth, and a count per predicted class plus abstained: the rows of a confusion matrix per group."""
    counts = [count_if(F.col(prediction) == i).alias(f"predicted_{i}") for i in range(classes)]
    return df.groupBy(*by, truth).agg(*counts, count_if(F.col(prediction).isNull()).alias("abstained"))


def best_arm(df: DataFrame, arm: str, seed: str, value: str) -> DataFrame:
    """The arm with the highest mean over seeds, ties to the first by name. Arms must have the same seeds; no row if not."""
    arms = df.groupBy(arm).agg(F.avg(value).alias("mean"), F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set(F.col(seed).cast("string"))), ",").alias("seeds"))
    same = arms.agg(F.count_distinct("seeds", "n").alias("kinds"))
    return arms.join(F.broadcast(same)).where("kinds = 1").orderBy(F.col("mean").desc(), arm).limit(1).select(arm, "mean", "n")


def controlled_choice(runs: DataFrame, field: str, baseline: str, value: str) -> DataFrame:
    """The run that a controlled comparison selects: the one with a strictly higher value than all others and the baseline, which
    is kept on a tie. runs: a row per run with the varied field, config (a map of all settings) and value. Raises unless
    the runs have different values of the field, one of them the baseline, and agree in every other setting."""
    others = F.to_json(F.array_sort(F.map_entries(F.map_filter("config", lambda k, v: k != field))))
    facts = runs.agg(F.count("*").alias("n"), F.count_distinct(field).alias("kinds"), F.count_if(F.col(field) == baseline).alias("base"), F.count_distinct(F.coalesce(others, F.lit(""))).alias("configs")).first()
    if facts["kinds"] != facts["n"] or facts["base"] != 1 or facts["configs"] != 1:
        raise ValueError("controlled runs must differ in one setting only, and one of them must be the baseline")
    return runs.orderBy(F.col(value).desc_nulls_last(), (F.col(field) != baseline).cast("int"), field).limit(1)


def dense_counts(df: DataFrame, dims: dict[str, list]) -> DataFrame:
    """Counts of all combinations of the given values, also those that do not occur."""
    grid = df.sparkSession.range(1)
    for name, values in dims.items():
        grid = grid.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return grid.drop("id").join(df.groupBy(*dims).agg(F.count("*").alias("n")), list(dims), "left").fillna(0, ["n"])


def learning_curve(df: DataFrame, fraction: str, value: str) -> DataFrame:
    """fraction, mean, population std and number of seeds."""
    return df.groupBy(fraction).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("seeds"))


def demo_examples(df: DataFrame, classes: int, key: str = "clip_id", least_seconds: float = 2.0) -> DataFrame:
    """key, role: the first covered clip of each class by id that is long enough to read, and the most confident mistake that
    is none of them. df has truth, prediction, confidence, covered and seconds. A class without such a clip raises, as does a
    table without a further mistake."""
    readable = df.where(F.col("covered") & (F.col("seconds") >= least_seconds) & F.col("truth").between(0, classes - 1))
    first = readable.groupBy("truth").agg(F.min(key).alias(key))
    chosen = checkpoint(first.select(key, F.lit("first_covered_example_for_label").alias("role")))
    wrong = df.where((F.col("truth") != F.col("prediction")) & F.col("confidence").isNotNull()).join(chosen.select(key), key, "left_anti")
    mistake = checkpoint(wrong.orderBy(F.col("confidence").desc(), key).limit(1).select(key, F.lit("known_behavior_baseline_mistake").alias("role")))
    if chosen.count() < classes or mistake.isEmpty():
        raise ValueError("a class has no covered clip of readable length, or there is no further mistake")
    return chosen.unionByName(mistake)


def common_length(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Length of the longest common subsequence, a row of the table at a time: a cell is the best of its upper neighbour,
    its upper left one plus a match, and all cells left of it in the row, which is a running maximum."""
    if not len(a) or not len(b):
        return 0
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (np.bitwise_count(b ^ x) <= most)))
    return int(row[-1])


def ordered_matches(a: Column, b: Column, most: int) -> Column:
    """Length of the longest common subsequence of two arrays of hashes, where hashes within `most` bits are equal."""

    @F.pandas_udf("int")
    def length(left: pd.Series, right: pd.Series) -> pd.Series:
        words = lambda x: np.asarray(x, np.int64).view(np.uint64)
        return pd.Series([common_length(words(x), words(y), most) for x, y in zip(left, right, strict=True)], dtype="int32")

    return length(a, b)


def fingerprint_evidence(pairs: DataFrame, most: int = 4) -> DataFrame:
    """a, b, matching (i, j and distance of every pair of samples within `most` bits, as an array), ordered (their longest
    common subsequence), distinct (the lesser number of distinct hashes), observation. pairs: a, b, ha, hb (arrays of 64-bit
    hashes). Three ordered matches of three distinct hashes make a temporal candidate; neither proves one source."""
    distance = lambda i, j: F.bit_count(F.get("ha", i).bitwiseXOR(F.get("hb", j)))
    places = lambda h: F.when(F.size(h) > 0, F.sequence(F.lit(0), F.size(h) - 1)).otherwise(F.array().cast("array<int>"))
    grid = F.flatten(F.transform(places("ha"), lambda i: F.transform(places("hb"), lambda j: F.struct(i.alias("i"), j.alias("j"), distance(i, j).alias("distance")))))
    rows = pairs.withColumn("matching", F.filter(grid, lambda e: e["distance"] <= most)).withColumn("ordered", ordered_matches(F.col("ha"), F.col("hb"), most))
    rows = rows.withColumn("distinct", F.least(F.size(F.array_distinct("ha")), F.size(F.array_distinct("hb"))))
    temporal = (F.col("ordered") >= 3) & (F.col("distinct") >= 3)
    return rows.select("a", "b", "matching", "ordered", "distinct", F.when(temporal, "temporal_visual_candidate").otherwise("ambiguous_visual_similarity").alias("observation"))


def frame_range(start: Column, end: Column, fps: Column, frames: Column) -> Column:
    """struct(first, last): the frames of an interval, first inclusive, last exclusive, within [0, frames]."""
    return F.struct(F.greatest(F.floor(start * fps + F.lit(1e-8)), F.lit(0)).cast("long").alias("first"), F.least(F.ceil(end * fps - F.lit(1e-8)), frames).cast("long").alias("last"))


def window_frames(fps: Column, seconds: float) -> Column:
    """Frames of a window: seconds * fps rounded half to even."""
    return F.rint(fps * seconds).cast("int")


def clock_text(seconds: Column) -> Column:
    """M:SS of whole seconds."""
    whole = F.floor(seconds).cast("long")
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def plan_clips(windows: DataFrame, caps: dict[str, int], key: str = "video_id") -> DataFrame:
    """key, start, kind, label: of each video's windows (start, kind) at most caps[kind] evenly spaced ones."""
    most = F.coalesce(*[F.when(F.col("kind") == kind, F.lit(n)) for kind, n in caps.items()])
    chosen = evenly(windows.where(F.col("kind").isin(*caps)).select(key, "start", "kind"), most, [key, "kind"], "start")
    return chosen.withColumn("label", (F.col("kind") == "violent").cast("int"))


def masked_max(actors: DataFrame, key: str = "scene_id") -> DataFrame:
    """key, dim, x: the largest value of each dimension over a scene's valid actors (rows: key, valid, vector)."""
    return actors.where("valid").select(key, F.posexplode("vector").alias("dim", "x")).groupBy(key, "dim").agg(F.max("x").alias("x"))


def coverage_by_class(df: DataFrame, label: str = "label", actors: str = "actors") -> DataFrame:
    """label, total, covered, no_actor_rate."""
    return df.groupBy(label).agg(F.count("*").alias("total"), count_if(F.col(actors) > 0).alias("covered"), ratio(count_if(F.col(actors) == 0), F.count("*")).alias("no_actor_rate"))


def tune_threshold(boxes: DataFrame, candidates: list[float], min_recall: float, iou: float, key: str = "scene_id") -> DataFrame:
    """The confidence with the best f1 among those that reach min_recall; ties go to higher recall, then confidence. boxes:
    scene_id, box_id, side, x1 .. y2, score.

    Every candidate has its own optimal matching of what it keeps. Boxes are counted where they are, and shuffled once, with
    their scene, for all candidates (see matched_by_level)."""
    levels = sorted({float(t) for t in candidates})
    kept = F.size(F.filter(F.array(*map(F.lit, levels)), lambda t: t <= F.col("score")))
    det = F.array(*[F.count_if((F.col("side") == "det") & (kept > i)) for i in range(len(levels))])
    counts = boxes.agg(count_if(F.col("side") == "gt").alias("gt"), det.alias("_det")).select("gt", F.posexplode("_det").alias("level", "det"))
    rows = counts.join(matched_by_level(boxes, iou, kept, len(levels), key), "level", "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    rows = rows.withColumn("threshold", F.element_at(F.array(*map(F.lit, levels)), F.col("level") + 1))
    rows = rates(rows.select("threshold", "tp", (F.col("det") - F.col("tp")).alias("fp"), (F.col("gt") - F.col("tp")).alias("fn"), F.lit(0).cast("long").alias("tn")))
    return rows.where(F.col("recall") >= min_recall).orderBy(F.col("f1").desc(), F.col("recall").desc(), F.col("threshold").desc()).limit(1).select("threshold", "tp", "fp", "fn", "precision", "recall", "f1")


def search(df: DataFrame, text: str, equal: dict[str, str]) -> DataFrame:
    """Rows whose JSON holds the text in any case, and whose columns equal what is given."""
    rows = df.where(F.lower(F.to_json(F.struct(*df.columns))).contains(text.lower()))
    for name, value in equal.items():
        rows = rows.where(F.col(name) == value)
    return rows
