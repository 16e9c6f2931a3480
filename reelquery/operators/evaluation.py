"""Evaluating whole outputs: bags and frames, groups and actors, paired predictions, and frozen splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelquery.functions.prefix import ratio
from reelquery.operators.intervals import frame_labels, project_scores
from reelquery.operators.metrics import binary_metrics, classification_summary, count_if
from reelquery.sources.manifests import require_none


def evaluate_bags(segments: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Binary metrics where a video's score is its highest segment. segments: video_id, score; labels: video_id, label."""
    return binary_metrics(segments.groupBy("video_id").agg(F.max("score").alias("score")).join(labels, "video_id"), threshold)


def evaluate_frames(videos: DataFrame, intervals: DataFrame, threshold: float = 0.5, mode: str = "repeat") -> DataFrame:
    """Binary metrics over all frames: painted labels against projected segment scores. videos: video_id, frames, fps,
    scores; intervals: video_id, start_s, end_s."""
    rows = frame_labels(videos, intervals, "frames", "fps").join(project_scores(videos, "frames", "scores", mode), ["video_id", "frame"])
    return binary_metrics(rows, threshold)


def group_and_actor_metrics(scenes: DataFrame, group_classes: int, actor_classes: int) -> DataFrame:
    """level (group, actor) with n, covered, accuracy, macro_f1. scenes: truth, prediction, actors (array of structs truth,
    prediction, valid). Actors that are masked, or have truth -100, are no population."""
    actors = scenes.select(F.explode("actors").alias("a")).select("a.*").where("valid AND truth <> -100").select("truth", "prediction")
    parts = [(scenes.select("truth", "prediction"), group_classes, "group"), (actors, actor_classes, "actor")]
    rows = [classification_summary(df, n).select(F.lit(level).alias("level"), "n", "covered", "accuracy", "macro_f1") for df, n, level in parts]
    return rows[0].unionByName(rows[1])


def paired_predictions(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """One row: pairs, both_right, only_first, only_second, both_wrong, agreement, unpaired. Sides: key, truth, prediction."""
    a = first.select(F.col(key).alias("_a"), F.col("truth").alias("_t"), F.col("prediction").alias("_p"))
    b = second.select(F.col(key).alias("_b"), F.col("prediction").alias("_q"))
    rows = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    p, q = F.coalesce(F.col("_p") == F.col("_t"), F.lit(False)), F.coalesce(F.col("_q") == F.col("_t"), F.lit(False))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return rows.agg(
        count_if(both).alias("pairs"), count_if(both & p & q).alias("both_right"), count_if(both & p & ~q).alias("only_first"), count_if(both & ~p & q).alias("only_second"), count_if(both & ~p & ~q).alias("both_wrong"),
        ratio(count_if(both & F.col("_p").eqNullSafe(F.col("_q"))), count_if(both)).alias("agreement"), count_if(~both).alias("unpaired"),
    )


def held_out(rows: DataFrame, other_protocol: DataFrame) -> DataFrame:
    """Test rows that are selected, whose source is test or excluded in another protocol (source_video_id, assignment)."""
    other = other_protocol.select("source_video_id", F.col("assignment").alias("_other"))
    joined = rows.where((F.col("split") == "test") & F.col("selected")).join(other, "source_video_id", "left")
    return joined.where(F.col("_other").isNull() | F.col("_other").isin("test", "excluded")).select(*rows.columns)


def merge_splits(parts: dict[str, DataFrame]) -> DataFrame:
    """Frozen splits under one roof: sources and ids are prefixed by their data set, nothing is assigned anew."""
    out = None
    for name, df in parts.items():
        rows = df.withColumn("dataset", F.lit(name)).withColumns({c: F.concat(F.lit(f"{name}:"), F.col(c)) for c in ("video_id", "source_video_id")})
        out = rows if out is None else out.unionByName(rows)
    return out


def split_violations(frozen: DataFrame, current: DataFrame) -> DataFrame:
    """video_id, code of what differs from a frozen split (video_id, source_video_id, split, sha256): missing, added, moved or
    changed videos, and sources in several splits."""
    old, new = (df.select("video_id", F.struct("split", "sha256").alias(name)) for df, name in ((frozen, "_old"), (current, "_new")))
    rows = old.join(new, "video_id", "full_outer")
    code = F.when(F.col("_new").isNull(), "missing").when(F.col("_old").isNull(), "added").when(F.col("_old.split") != F.col("_new.split"), "moved").when(~F.col("_old.sha256").eqNullSafe(F.col("_new.sha256")), "changed")
    crossing = current.groupBy("source_video_id").agg(F.count_distinct("split").alias("n")).where("n > 1").select(F.col("source_video_id").alias("video_id"), F.lit("source_crosses_splits").alias("code"))
    return rows.select("video_id", code.alias("code")).where("code IS NOT NULL").unionByName(crossing)


def historical_inventory(parts: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(sources, digests): the distinct source_video_id and sha256 of historical manifests, without nulls."""
    out = parts[0].select("source_video_id", "sha256")
    for df in parts[1:]:
        out = out.unionByName(df.select("source_video_id", "sha256"))
    return out.select("source_video_id").where("source_video_id IS NOT NULL").distinct(), out.select("sha256").where("sha256 IS NOT NULL").distinct()


def mean_std_text(mean: str, std: str, n: str):
    """`mean ± std (n=..)` with four digits."""
    return F.format_string("%.4f ± %.4f (n=%d)", F.col(mean), F.col(std), F.col(n))


def paired_audit(scenes: DataFrame, high: float = 0.8, low: float = 0.5) -> DataFrame:
    """clip_id, categories, coverage, mean_iou of scenes that were classified once with annotated and once with detected actors.

    scenes: clip_id, truth, gt_prediction, gt_confidence, gt_actors, det_prediction, det_confidence, det_status, det_actors, ious (of
    matched actors; null if the scene was not matched). Categories describe what was predicted, not why: a detection without
    a partner may be a person whom nobody annotated. Missing predictions are wrong but never confident. Repeated scenes, and a
    no_actors_detected status beside actors or a prediction, raise."""
    require_none(scenes.groupBy("clip_id").count().where("count > 1"), "repeated scenes")
    none = F.coalesce(F.col("det_status") == "no_actors_detected", F.lit(False))
    require_none(scenes.where(none & ((F.col("det_actors") > 0) | F.col("det_prediction").isNotNull())).select("clip_id"), "no-actor scenes have no actors and no prediction")
    right = lambda name: F.coalesce(F.col(name) == F.col("truth"), F.lit(False))
    sure = lambda name: F.coalesce(F.col(name) >= high, F.lit(False))
    gt, det = right("gt_prediction"), right("det_prediction")
    coverage = F.when(F.col("gt_actors") > 0, F.size("ious") / F.col("gt_actors"))
    rows = scenes.withColumn("coverage", F.when(F.col("ious").isNotNull(), coverage))
    cases = [  # fixed values: the names of the categories
        (gt, "GT_correct"),
        (~gt, "GT_group_wrong"),
        (~gt & sure("gt_confidence"), "GT_high_confidence_wrong"),
        (gt & ~det, "GT_correct_detected_failed"),
        (~gt & ~det, "both_failed"),
        (det, "detected_correct"),
        (none, "no_actors_detected"),
        (~none & ~det, "detected_group_wrong"),
        (~det & sure("det_confidence"), "detected_high_confidence_wrong"),
        (F.coalesce(F.col("coverage") < low, F.lit(False)), "low_coverage"),
    ]
    categories = F.array_compact(F.array(*[F.when(when, name) for when, name in cases]))
    mean = F.when(F.size("ious") > 0, F.aggregate("ious", F.lit(0.0), lambda a, x: a + x) / F.size("ious"))
    return rows.select("clip_id", categories.alias("categories"), "coverage", mean.alias("mean_iou"))


def category_counts(audited: DataFrame) -> DataFrame:
    """category, n: how many scenes are in each category of a paired audit."""
    return audited.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def actor_histogram(scenes: DataFrame, boxes: DataFrame, key: str = "scene_id") -> DataFrame:
    """actors, scenes: how many scenes have so many boxes; scenes without any count as 0."""
    per = scenes.select(key).distinct().join(boxes.groupBy(key).agg(F.count("*").alias("actors")), key, "left").fillna(0, ["actors"])
    return per.groupBy("actors").agg(F.count("*").alias("scenes"))


def validation_violations(rows: DataFrame, assigned: DataFrame, anomaly: DataFrame) -> DataFrame:
    """code, subject of what forbids evaluating on the validation clips: rows has clip_id, source_video_id, sha256, split, selected;
    assigned and anomaly (source_video_id, assigned) are the assignments of the two models that are compared."""
    own = rows.where("selected")
    of = lambda df, code, column: df.select(F.lit(code).alias("code"), F.col(column).cast("string").alias("subject"))
    moved = own.join(assigned, "source_video_id", "left").where("NOT (assigned <=> split)")
    crossing = own.groupBy("sha256").agg(F.min("split").alias("_low"), F.max("split").alias("_high")).where("_low <> _high")
    foreign = own.where("split = 'val'").join(anomaly, "source_video_id", "left").where("NOT (assigned <=> 'val')")
    repeated = rows.groupBy("clip_id").count().where("count > 1")
    found = of(repeated, "repeated_clip", "clip_id").unionByName(of(moved, "source_moved", "source_video_id")).unionByName(of(crossing, "content_crosses_splits", "sha256"))
    return found.unionByName(of(foreign, "not_validation_of_both", "source_video_id")).distinct()


def eligible_validation(rows: DataFrame, assigned: DataFrame, anomaly: DataFrame) -> DataFrame:
    """The selected validation clips; raises on validation_violations, and if there are none."""
    require_none(validation_violations(rows, assigned, anomaly), "validation clips are not independent of both models")
    found = rows.where("selected AND split = 'val'")
    if found.isEmpty():
        raise ValueError("there are no validation clips")
    return found
