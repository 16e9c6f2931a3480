"""Evaluation metrics over (label, score) and (truth, prediction) rows: counts are aggregated before any order is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelquery.functions.prefix import exact_quantiles, ratio, running_totals


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def curve(df: DataFrame, by: list[str] = [], label: str = "label", score: str = "score") -> DataFrame:  # noqa: B006
    """A row per distinct score (within by): pos and neg at the score, tp and fp at or above it, all_pos and all_neg."""
    counts = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("score")).agg(count_if(F.col(label) == 1).alias("pos"), count_if(F.col(label) == 0).alias("neg"))
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    rows = running_totals(counts, "score", ["pos", "neg"], by, descending=True).withColumnsRenamed({"cum_pos": "tp", "cum_neg": "fp"})
    return rows.join(totals, by) if by else rows.join(F.broadcast(totals))


def roc_auc(df: DataFrame, by: list[str] = [], label: str = "label", score: str = "score") -> DataFrame:  # noqa: B006
    """by, roc_auc: the Mann-Whitney form with ties counted half; null where a class is missing."""
    rows = curve(df, by, label, score)
    beaten = F.col("pos") * (F.col("all_neg") - F.col("fp") + F.col("neg") / F.lit(2.0))
    pairs = F.first("all_pos").cast("double") * F.first("all_neg")
    return rows.groupBy(*by).agg(ratio(F.sum(beaten), pairs).alias("roc_auc"))


def confusion_at(threshold: Column | float, label: str = "label", score: str = "score") -> dict[str, Column]:
    """tn, fp, fn, tp with an inclusive threshold."""
    hit, truth = F.col(score) >= threshold, F.col(label) == 1
    return {"tn": count_if(~truth & ~hit), "fp": count_if(~truth & hit), "fn": count_if(truth & ~hit), "tp": count_if(truth & hit)}


def rates(rows: DataFrame) -> DataFrame:
    """precision, recall and f1 (0 where undefined) and fpr (null without negatives) from tn, fp, fn, tp."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    return (
        rows.withColumn("precision", F.coalesce(ratio(tp, tp + fp), zero))
        .withColumn("recall", F.coalesce(ratio(tp, tp + fn), zero))
        .withColumn("f1", F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), zero))
        .withColumn("fpr", ratio(fp, fp + tn))
    )


def binary_metrics(df: DataFrame, threshold: float = 0.5, label: str = "label", score: str = "score") -> DataFrame:
    """One row: confusion counts, precision, recall, f1, fpr, accuracy, fnr and roc_auc."""
    counts = df.agg(*[c.alias(k) for k, c in confusion_at(F.lit(threshold), label, score).items()])
    rows = rates(counts).withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))
    rows = rows.withColumn("fnr", ratio(F.col("fn"), F.col("fn") + F.col("tp")))
    return rows.join(F.broadcast(roc_auc(df, [], label, score)))


def pr_curve_areas(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """pr_auc (trapezoids between the distinct thresholds, from recall 0 at precision 1) and average_precision."""
    rows = curve(df, [], label, score)
    tp, fp, pos, neg, every = (F.col(x) for x in ("tp", "fp", "pos", "neg", "all_pos"))
    precision, before = ratio(tp, tp + fp), F.coalesce(ratio(tp - pos, tp + fp - pos - neg), F.lit(1.0))
    step = ratio(pos, every)
    return rows.agg(F.sum(step * (precision + before) / 2).alias("pr_auc"), F.sum(step * precision).alias("average_precision"))


def recall_at_fpr(df: DataFrame, most: float = 0.05, label: str = "label", score: str = "score") -> DataFrame:
    """recall_at_fpr: the highest recall of any threshold whose false positive rate is at most `most`, on the full curve."""
    rows = curve(df, [], label, score)
    good = ratio(F.col("fp"), F.col("all_neg")) <= most
    return rows.agg(F.coalesce(F.max(F.when(good, ratio(F.col("tp"), F.col("all_pos")))), F.lit(0.0)).alias("recall_at_fpr"))


def threshold_sweep(df: DataFrame, candidates: list[float], label: str = "label", score: str = "score") -> DataFrame:
    """A row per candidate threshold with its counts and rates. Rows are first counted by how many candidates they reach,
    so the sweep works on as many rows as there are candidates."""
    levels = sorted(set(candidates))
    reached = F.size(F.filter(F.array(*[F.lit(float(t)) for t in levels]), lambda t: t <= F.col(score)))
    counts = df.where(F.col(score).isNotNull()).groupBy(reached.alias("reached")).agg(count_if(F.col(label) == 1).alias("p"), count_if(F.col(label) == 0).alias("n"))
    each = counts.select("p", "n", "reached", F.posexplode(F.array(*[F.lit(float(t)) for t in levels])).alias("at", "threshold"))
    hit = F.col("reached") > F.col("at")
    total = lambda side, when: F.sum(F.when(when, F.col(side)).otherwise(0)).cast("long")
    return rates(each.groupBy("threshold").agg(total("n", ~hit).alias("tn"), total("n", hit).alias("fp"), total("p", ~hit).alias("fn"), total("p", hit).alias("tp")))


def calibrate_threshold(df: DataFrame, candidates: list[float], min_recall: float, label: str = "label", score: str = "score") -> DataFrame:
    """The candidate with the highest f1 among those that reach min_recall; ties go to higher recall, then threshold. No row
    where none reaches it or a class is missing."""
    rows = threshold_sweep(df, candidates, label, score).where((F.col("recall") >= min_recall) & (F.col("tp") + F.col("fn") > 0) & (F.col("tn") + F.col("fp") > 0))
    return rows.orderBy(F.col("f1").desc(), F.col("recall").desc(), F.col("threshold").desc()).limit(1)


def abstention_matrix(df: DataFrame, min_confidence: float, threshold: float = 0.5, label: str = "label", score: str = "score") -> DataFrame:
    """A row per label: predicted_0, predicted_1, abstained. A null score, or confidence below the limit, abstains."""
    s = F.col(score)
    out = s.isNull() | (F.greatest(s, 1 - s) < min_confidence)
    return df.groupBy(label).agg(count_if(~out & (s < threshold)).alias("predicted_0"), count_if(~out & (s >= threshold)).alias("predicted_1"), count_if(out).alias("abstained"))


def class_metrics(df: DataFrame, classes: int, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """A row per class, also absent ones: support, predicted, correct, precision, recall, f1 (0 where undefined) and
    accuracy (null without support). Abstentions (null predictions) are no class."""
    pairs = df.groupBy(truth, prediction).agg(F.count("*").alias("n"))
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    all_classes = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("class"))
    named = pairs.select(F.col(truth).alias("t"), F.col(prediction).alias("p"), "n", F.explode(F.array_distinct(F.array(truth, prediction))).alias("class"))
    c = F.col("class")
    own = named.where(c.isNotNull()).groupBy("class").agg(n(F.col("t") == c).alias("support"), n(F.col("p") == c).alias("predicted"), n((F.col("t") == c) & (F.col("p") == c)).alias("correct"))
    rows = all_classes.join(own, "class", "left").fillna(0)
    tp, predicted, support = F.col("correct"), F.col("predicted"), F.col("support")
    zero = F.lit(0.0)
    return (
        rows.withColumn("precision", F.coalesce(ratio(tp, predicted), zero))
        .withColumn("recall", F.coalesce(ratio(tp, support), zero))
        .withColumn("f1", F.coalesce(ratio(2 * tp, predicted + support), zero))
        .withColumn("accuracy", ratio(tp, support))
    )


def classification_summary(df: DataFrame, classes: int, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """One row: n, covered, accuracy over all rows, macro_f1 over all classes, balanced_accuracy over supported ones."""
    per = class_metrics(df, classes, truth, prediction).agg(F.avg("f1").alias("macro_f1"), F.avg("accuracy").alias("balanced_accuracy"))
    every = df.agg(F.count("*").alias("n"), F.count(prediction).alias("covered"), ratio(count_if(F.col(truth) == F.col(prediction)), F.count("*")).alias("accuracy"))
    return every.join(F.broadcast(per))


def confusion_pairs(df: DataFrame, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """Wrong (truth, prediction) pairs with their count and rank, most frequent first."""
    from pyspark.sql.window import Window as W

    pairs = df.where(F.col(prediction).isNotNull() & (F.col(truth) != F.col(prediction))).groupBy(truth, prediction).agg(F.count("*").alias("n"))
    return pairs.withColumn("rank", F.row_number().over(W.orderBy(F.col("n").desc(), truth, prediction)))


def within_source_auc(df: DataFrame, source: str = "source_video_id", label: str = "label", score: str = "score") -> DataFrame:
    """sources with both classes, and the mean of their AUCs (null without any)."""
    return roc_auc(df, [source], label, score).agg(F.count("roc_auc").alias("sources"), F.avg("roc_auc").alias("within_source_auc"))


def confidence_summary(df: DataFrame, value: str) -> DataFrame:
    """count, unknown (null), mean, population std, and the exact quartiles of a column."""
    base = df.agg(F.count(value).alias("count"), count_if(F.col(value).isNull()).alias("unknown"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    quartiles = exact_quantiles(df, value, {"minimum": 0, "q25": 0.25, "median": 0.5, "q75": 0.75, "maximum": 1}).drop("n")
    return base.join(F.broadcast(quartiles), how="left")


def seed_aggregate(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key: mean and sample std over seeds, number of values, number of nulls (never counted as zero)."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"), count_if(F.col(value).isNull()).alias("missing"))


def class_weights(df: DataFrame, label: str, classes: int) -> DataFrame:
    """label, n, weight: N / (classes * n)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(label, "n", ratio(F.col("total"), classes * F.col("n")).alias("weight"))


def source_label_pivot(df: DataFrame, source: str, label: str, labels: list) -> DataFrame:
    """Per source: a count per label, clips, and the positive share of binary labels (null without any)."""
    counts = [count_if(F.col(label) == x).alias(f"label_{x}") for x in labels]
    return df.groupBy(source).agg(*counts, F.count("*").alias("clips"), ratio(count_if(F.col(label) == 1), count_if(F.col(label).isin(0, 1))).alias("positive_share"))
