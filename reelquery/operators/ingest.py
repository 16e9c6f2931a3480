"""Annotation rows: normalizing, validating, quarantining and reconciling them. Raw values are always kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The label vocabulary and the binary class of each label.
LABELS = {"violence": 1, "non_violence": 0, "not_sure": None}


def normalize_label(raw: Column) -> Column:
    """Lower case, with runs of white space and hyphens as one underscore; null outside the vocabulary."""
    label = F.regexp_replace(F.lower(F.trim(raw)), r"[\s-]+", "_")
    return F.when(label.isin(*LABELS), label)


def binary_label(normalized: Column) -> Column:
    return F.when(normalized == "violence", 1).when(normalized == "non_violence", 0)


def annotation_seconds(raw: Column) -> Column:
    """Decimal seconds, or minutes:seconds with seconds below 60, as seconds; null for anything else."""
    text = F.trim(raw)
    minutes = F.regexp_extract(text, r"^(\d+):([0-5]\d(?:\.\d+)?)$", 1)
    rest = F.regexp_extract(text, r"^(\d+):([0-5]\d(?:\.\d+)?)$", 2)
    plain = F.when(text.rlike(r"^(?:\d+(?:\.\d*)?|\.\d+)$"), text)
    return F.when(minutes != "", minutes.try_cast("double") * 60 + rest.try_cast("double")).otherwise(plain.try_cast("double"))


def assess(df: DataFrame) -> DataFrame:
    """df with normalized_label, duration_s, start_s, end_s, issues (in a fixed order) and end_excess (null unless both
    times and the duration are known). df has label, playback_status, duration, start_text, end_text; nulls count as ''."""
    text = lambda name: F.trim(F.coalesce(F.col(name), F.lit("")))
    label, start, end = normalize_label(text("label")), text("start_text"), text("end_text")
    duration = F.when(annotation_seconds(text("duration")) > 0, annotation_seconds(text("duration")))
    a, b = annotation_seconds(start), annotation_seconds(end)
    given = (start != "") | (end != "")
    known = a.isNotNull() & b.isNotNull()
    cases = [  # fixed values: the issue codes, in their order
        (label == "not_sure", "uncertain_label"),
        (text("label") == "", "missing_label"),
        (label.isNull() & (text("label") != ""), "unsupported_label"),
        (F.lower(text("playback_status")) != "ok", "playback_not_ok"),
        (duration.isNull(), "invalid_duration"),
        (given & known & (a >= b), "invalid_interval_order"),
        (given & known & (b > duration), "interval_end_after_video"),
        (given & known & (a >= duration), "interval_start_after_video"),
        (given & known & ~label.eqNullSafe("violence"), "interval_on_uncertain_or_nonviolent_label"),
        (given & ~known, "invalid_or_partial_time"),
    ]
    rows = df.withColumn("normalized_label", label).withColumn("duration_s", duration)
    rows = rows.withColumn("start_s", F.when(given & known, a)).withColumn("end_s", F.when(given & known, b))
    rows = rows.withColumn("issues", F.array_compact(F.array(*[F.when(when, issue) for when, issue in cases])))
    return rows.withColumn("end_excess", F.when(F.col("end_s").isNotNull(), F.greatest(F.col("end_s") - F.col("duration_s"), F.lit(0.0))))


def accepted(assessed: DataFrame) -> DataFrame:
    """Rows without issues."""
    return assessed.where(F.size("issues") == 0)


def quarantined(assessed: DataFrame) -> DataFrame:
    """Rows with issues."""
    return assessed.where(F.size("issues") > 0)


def issue_counts(assessed: DataFrame) -> DataFrame:
    return assessed.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def reconcile(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, state, conflicts: both sides of a reconciliation; state is left_only, right_only, equal or conflict, and
    conflicts names the fields that differ (nulls are equal)."""
    l = left.select(F.col(key).alias("_l"), *[F.col(f).alias(f"_l_{f}") for f in fields])  # noqa: E741
    r = right.select(F.col(key).alias("_r"), *[F.col(f).alias(f"_r_{f}") for f in fields])
    rows = l.join(r, F.col("_l") == F.col("_r"), "full_outer")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    conflicts = F.array_compact(F.array(*[F.when(both & ~F.col(f"_l_{f}").eqNullSafe(F.col(f"_r_{f}")), f) for f in fields]))
    state = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").when(F.size(conflicts) > 0, "conflict").otherwise("equal")
    return rows.select(F.coalesce("_l", "_r").alias(key), state.alias("state"), conflicts.alias("conflicts"))


def exclude_historical(df: DataFrame, sources: DataFrame, digests: DataFrame) -> DataFrame:
    """Rows whose source and content are in no historical inventory (source_video_id; sha256)."""
    return df.join(sources.select("source_video_id").distinct(), "source_video_id", "left_anti").join(digests.select("sha256").distinct(), "sha256", "left_anti").select(*df.columns)


def source_identity(name: Column) -> Column:
    """The recording's name before an encoder suffix, in lower case; the whole name without one."""
    found = F.regexp_extract(name, r"(?i)^(.+\d+)_x264(?:[_-].*)?$", 1)
    return F.lower(F.when(found != "", found).otherwise(name))


def timing_observations(df: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """df with frame_clock (frames / fps), difference (presentation minus frame clock) and flagged (beyond one frame and the
    tolerance). Rows without fps or frames are left out. df has presentation, frames, fps."""
    rows = df.where((F.col("fps") > 0) & (F.col("frames") > 0)).withColumn("frame_clock", F.col("frames") / F.col("fps"))
    rows = rows.withColumn("difference", F.col("presentation") - F.col("frame_clock"))
    return rows.withColumn("flagged", F.abs("difference") > 1 / F.col("fps") + tolerance)


#: Label codes of clip names that count as violent.
VIOLENT_CODES = ("B1", "B4", "B5")


def clip_kind(name: Column) -> Column:
    """violent, normal or excluded by the codes after _label_ in a clip's name: A alone is normal, violent codes alone are
    violent, everything else is excluded. A code 0 says nothing."""
    codes = F.array_except(F.array_distinct(F.split(F.element_at(F.split(name, "_label_"), -1), "-")), F.array(F.lit("0")))
    violent = F.array(*map(F.lit, VIOLENT_CODES))
    return F.when(codes == F.array(F.lit("A")), "normal").when((F.size(codes) == 0) | (F.size(F.array_except(codes, violent)) == 0), "violent").otherwise("excluded")


def clip_source(name: Column) -> Column:
    """What stands before the first __# of a clip's name."""
    return F.substring_index(name, "__#", 1)


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_.-]", "_")


def scoped_path(path: Column) -> Column:
    """Whether a path is relative, without backslashes or parent folders."""
    return (path != "") & ~path.rlike(r"^/|\\|^[A-Za-z]:|(^|/)\.\.(/|$)")


def valid_intervals(intervals: Column, duration: Column, most: int = 1000) -> Column:
    """Whether an array of (start, end) structs has at most `most` finite intervals with 0 <= start < end <= duration."""
    fine = F.forall(intervals, lambda x: ~F.isnan(x["start"]) & ~F.isnan(x["end"]) & (x["start"] >= 0) & (x["start"] < x["end"]) & (x["end"] <= duration))
    return (F.size(intervals) <= most) & F.coalesce(fine, F.lit(False))
