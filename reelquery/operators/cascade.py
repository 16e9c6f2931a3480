"""Cascade routing and review: top windows, alerts, abstention-preserving review policies, coverage and failure tags.

Scores are uncalibrated and everything is for human review; an abstention never becomes a class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelquery.functions.prefix import ratio
from reelquery.operators.intervals import top_windows
from reelquery.operators.metrics import count_if

#: Names of states, of the suggestion and (in outcomes) of tags.
REVIEW, GENERIC, NONE = "behavior_review", "generic_anomaly", "no_anomaly"
SUGGESTED = "covered_suggestion_requires_human_review"


def route(segments: DataFrame, threshold: float, k: int = 3, key: str = "video_id") -> DataFrame:
    """The k best distinct windows per key, with status (available if actors were found) and the alert each raises.
    segments has seg, start_s, end_s, score, actors, behavior (null without actors)."""
    rows = top_windows(segments, threshold, k, key)
    rows = rows.withColumn("status", F.when(F.col("actors") > 0, "available").otherwise("no_actors"))
    rows = rows.withColumn("behavior", F.when(F.col("actors") > 0, F.col("behavior")))
    return rows.withColumn("state", F.when(F.coalesce(F.col("behavior") != 0, F.lit(False)), REVIEW).otherwise(GENERIC))


def results(segments: DataFrame, threshold: float, k: int = 3, key: str = "video_id") -> DataFrame:
    """A row per key: overall_score (highest segment), windows in routing order, and the final alert (state, behavior,
    alert_start, alert_end, alert_score): a behavior alert before others, then the higher score, then the earlier window."""
    window = F.struct("rank", "seg", "start_s", "end_s", "score", "actors", "status", "behavior", "state")
    routed = route(segments, threshold, k, key).groupBy(key).agg(F.array_sort(F.collect_list(window)).alias("windows"))
    top = segments.groupBy(key).agg(F.max("score").alias("overall_score"))
    rows = top.join(routed, key, "left").withColumn("windows", F.coalesce("windows", F.array().cast(routed.schema["windows"].dataType)))
    order = F.transform("windows", lambda w: F.struct((w["state"] != REVIEW).cast("int").alias("later"), (-w["score"]).alias("low"), w["rank"].alias("rank"), w.alias("window")))
    final = F.when(F.size("windows") > 0, F.array_min(order)["window"])
    rows = rows.withColumn("final", final)
    return rows.select(
        key, "overall_score", "windows", F.coalesce(F.col("final.state"), F.lit(NONE)).alias("state"), F.col("final.behavior").alias("behavior"),
        F.col("final.start_s").alias("alert_start"), F.col("final.end_s").alias("alert_end"), F.coalesce(F.col("final.score"), F.col("overall_score")).alias("alert_score"),
    )


def available() -> Column:
    return F.filter("windows", lambda w: w["status"] == "available")


def representative() -> Column:
    """The available window of the final alert's interval, else the first available one; null without any."""
    own = F.filter(available(), lambda w: (w["start_s"] == F.col("alert_start")) & (w["end_s"] == F.col("alert_end")))
    return F.coalesce(F.get(own, F.lit(0)), F.get(available(), F.lit(0)))


def assess_review(rows: DataFrame, mode: str) -> DataFrame:
    """rows and reason, suggested (a class or null), abstained, needs_review under mode coverage or coverage_consistency."""
    if mode not in ("coverage", "coverage_consistency"):
        raise ValueError("mode must be coverage or coverage_consistency")
    covered, routed = F.size(available()), F.size("windows")
    votes = F.size(F.array_distinct(F.transform(available(), lambda w: w["behavior"])))
    reason = F.when(routed == 0, "not_routed_actors_unexamined").when(covered == 0, "no_actors").when(covered < routed, "partial_actor_coverage")
    if mode == "coverage_consistency":
        reason = reason.when(votes > 1, "cross_window_class_disagreement")
    rows = rows.withColumn("reason", reason.otherwise(SUGGESTED))
    suggested = F.when(F.col("reason") == SUGGESTED, representative()["behavior"])
    return rows.withColumn("suggested", suggested).withColumn("abstained", F.col("suggested").isNull()).withColumn("needs_review", routed > 0)


def coverage(rows: DataFrame, source: str = "source_video_id") -> DataFrame:
    """One row of counts: total, sources, routed, bypassed, covered, no_actor_routed, abstained, windows, no_actor_windows,
    coverage_overall and coverage_among_routed (null where nothing is routed)."""
    routed, covered = F.size("windows") > 0, F.size(available()) > 0
    counts = rows.agg(
        F.count("*").alias("total"), F.countDistinct(source).alias("sources"), count_if(routed).alias("routed"), count_if(~routed).alias("bypassed"), count_if(covered).alias("covered"),
        count_if(routed & ~covered).alias("no_actor_routed"), count_if(~covered).alias("abstained"), F.sum(F.size("windows")).alias("windows"), F.sum(F.size("windows") - F.size(available())).alias("no_actor_windows"),
    )
    return counts.withColumn("coverage_overall", ratio(F.col("covered"), F.col("total"))).withColumn("coverage_among_routed", ratio(F.col("covered"), F.col("routed")))


def outcomes(rows: DataFrame, label: str = "group_label") -> DataFrame:
    """rows and outcomes: the tags of each clip; class 0 is the normal class."""
    routed, n, covered = F.size("windows") > 0, F.size("windows"), F.size(available())
    prediction, truth = representative()["behavior"], F.col(label)
    votes = F.size(F.array_distinct(F.transform(available(), lambda w: w["behavior"])))
    cases = [
        (F.lit(True), "clips"),
        (routed, "routed"),
        (~routed, "bypassed"),
        ((truth == 0) & routed, "normal_false_alert"),
        ((truth != 0) & ~routed, "abnormal_bypassed"),
        (routed & (covered == 0), "routed_no_actors"),
        (covered > 0, "covered"),
        ((covered > 0) & (prediction == truth), "behavior_correct"),
        ((covered > 0) & (prediction != truth), "behavior_incorrect"),
        ((covered > 0) & (covered < n), "mixed_actor_coverage"),
        ((covered > 0) & (votes > 1), "cross_window_behavior_disagreement"),
    ]
    return rows.withColumn("outcomes", F.array_compact(F.array(*[F.when(when, tag) for when, tag in cases])))


def failure_counts(tagged: DataFrame, by: list[str] = [], key: str = "video_id", first: int = 5) -> DataFrame:  # noqa: B006
    """by, outcome, n and the first ids. A task keeps its own smallest ids, so no group of ids is collected."""
    from pyspark.sql.window import Window as W

    rows = tagged.select(*by, key, F.explode("outcomes").alias("outcome"))
    ranked = rows.withColumn("_rank", F.row_number().over(W.partitionBy(*by, "outcome").orderBy(key))).where(F.col("_rank") <= first)
    ids = ranked.groupBy(*by, "outcome").agg(F.array_sort(F.collect_list(key)).alias("examples"))
    return rows.groupBy(*by, "outcome").agg(F.count("*").alias("n")).join(ids, [*by, "outcome"])


def linear_head(vector: Column, weights: list[float], bias: float) -> Column:
    """Sigmoid of a dot product with fixed weights."""
    pairs = F.zip_with(vector, F.array(*map(F.lit, weights)), lambda x, w: x * w)
    return 1 / (1 + F.exp(-(F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) + bias)))


def layered_head(vector: Column, layers: list[tuple[list[list[float]], list[float], bool]]) -> Column:
    """Sigmoid of the single output of stacked layers (weights by output, biases, whether its outputs pass through a ReLU)."""
    out = vector
    for weights, biases, relu in layers:
        units = F.array(*[F.struct(F.array(*map(F.lit, w)).alias("w"), F.lit(b).alias("b")) for w, b in zip(weights, biases, strict=True)])
        below = out
        out = F.transform(units, lambda u: F.aggregate(F.zip_with(below, u["w"], lambda x, w: x * w), u["b"], lambda a, x: a + x))  # noqa: B023
        out = F.transform(out, lambda x: F.greatest(x, F.lit(0.0))) if relu else out
    return 1 / (1 + F.exp(-out[0]))


def softmax(values: list[Column]) -> list[Column]:
    top = F.greatest(*values)
    parts = [F.exp(v - top) for v in values]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def fused_log_probabilities(first: list[Column], second: list[Column], weight: float) -> list[Column]:
    """log((weight * softmax(first) + softmax(second)) / (weight + 1)) per class."""
    return [F.log((weight * p + q) / (weight + 1)) for p, q in zip(softmax(first), softmax(second), strict=True)]
