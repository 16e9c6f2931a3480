"""Metric queries over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelquery.functions.prefix import exact_quantiles
from reelquery.operators import metrics as m
from reelquery.plans.views import oracle, view

CANDIDATES = [i / 20 for i in range(1, 20)]


def with_gaps(df):
    """Scores of which every seventh clip has none."""
    return df.withColumn("score", F.when(F.col("clip_id") % 7 != 0, F.col("score")))


QUERIES = {
    "binary_metrics": lambda s, d: m.binary_metrics(view(s, d, "v_scored")),
    "roc_auc_rank": lambda s, d: m.roc_auc(view(s, d, "v_scored")),
    "roc_auc_by_collection": lambda s, d: m.roc_auc(view(s, d, "v_scored"), ["collection"]),
    "pr_auc_trapezoid": lambda s, d: m.pr_curve_areas(view(s, d, "v_scored")).select("pr_auc"),
    "average_precision": lambda s, d: m.pr_curve_areas(view(s, d, "v_scored")).select("average_precision"),
    "recall_at_fpr": lambda s, d: m.recall_at_fpr(view(s, d, "v_scored")),
    "threshold_sweep": lambda s, d: m.threshold_sweep(view(s, d, "v_scored"), CANDIDATES),
    "calibrate_threshold": lambda s, d: m.calibrate_threshold(view(s, d, "v_scored"), CANDIDATES, 0.5),
    "abstention_matrix": lambda s, d: m.abstention_matrix(with_gaps(view(s, d, "v_scored")), 0.6),
    "classification_metrics": lambda s, d: m.class_metrics(view(s, d, "v_multiclass"), 6),
    "classification_summary": lambda s, d: m.classification_summary(view(s, d, "v_multiclass"), 6),
    "confusion_pairs_ranked": lambda s, d: m.confusion_pairs(view(s, d, "v_multiclass")),
    "within_source_auc": lambda s, d: m.within_source_auc(view(s, d, "v_scored")),
    "confidence_summary": lambda s, d: m.confidence_summary(with_gaps(view(s, d, "v_scored")), "score"),
    "latency_quantiles": lambda s, d: exact_quantiles(view(s, d, "v_segments"), "score", {"median": 0.5, "p95": 0.95}, ["video_id"]),
    "seed_aggregate": lambda s, d: m.seed_aggregate(with_gaps(view(s, d, "v_scored")), ["source_video_id"], "score"),
    "class_weights": lambda s, d: m.class_weights(view(s, d, "v_multiclass"), "truth", 5),
    "source_label_pivot": lambda s, d: m.source_label_pivot(view(s, d, "v_multiclass").withColumnRenamed("truth", "label"), "source_video_id", "label", [0, 1, 2, 3, 4]),
}

RANKED = "r AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY score) + (count(*) OVER (PARTITION BY {by}, score) - 1) / CAST(2 AS DOUBLE) AS rk FROM v_scored)"
AUC = "(sum(CASE WHEN label = 1 THEN rk END) - CAST(sum(label) AS DOUBLE) * (sum(label) + 1) / 2) / nullif(CAST(sum(label) AS DOUBLE) * sum(1 - label), 0)"
POINTS = """c AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM v_scored GROUP BY score),
    k AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM c WINDOW w AS (ORDER BY score DESC)),
    g AS (SELECT *, tp / CAST(tp + fp AS DOUBLE) AS prec, coalesce((tp - pos) / CAST(nullif(tp + fp - pos - neg, 0) AS DOUBLE), 1) AS before, pos / CAST(p AS DOUBLE) AS step FROM k)"""
COUNTS = """CAST(sum(CASE WHEN label = 0 AND score < t THEN 1 ELSE 0 END) AS BIGINT) AS tn, CAST(sum(CASE WHEN label = 0 AND score >= t THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN label = 1 AND score < t THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN label = 1 AND score >= t THEN 1 ELSE 0 END) AS BIGINT) AS tp"""
RATES = """coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) AS precision, coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0) AS recall,
    coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0) AS f1, fp / CAST(nullif(fp + tn, 0) AS DOUBLE) AS fpr"""
SWEEP = f"""t AS (SELECT i / CAST(20 AS DOUBLE) AS t FROM range(1, 20) r(i)),
    w AS (SELECT t AS threshold, {COUNTS} FROM v_scored, t GROUP BY t), x AS (SELECT *, {RATES} FROM w)"""
GAPS = "g AS (SELECT clip_id, source_video_id, label, CASE WHEN clip_id % 7 <> 0 THEN score END AS score FROM v_scored)"
CLASSES = """k AS (SELECT CAST(i AS INTEGER) AS class FROM range(0, 6) r(i)),
    q AS (SELECT class, (SELECT count(*) FROM v_multiclass WHERE truth = class) AS support, (SELECT count(*) FROM v_multiclass WHERE prediction = class) AS predicted,
        (SELECT count(*) FROM v_multiclass WHERE truth = class AND prediction = class) AS correct FROM k),
    z AS (SELECT *, coalesce(correct / CAST(nullif(predicted, 0) AS DOUBLE), 0) AS precision, coalesce(correct / CAST(nullif(support, 0) AS DOUBLE), 0) AS recall,
        coalesce(2 * correct / CAST(nullif(predicted + support, 0) AS DOUBLE), 0) AS f1, correct / CAST(nullif(support, 0) AS DOUBLE) AS accuracy FROM q)"""

ORACLES = {
    "binary_metrics": oracle(f""", {RANKED.format(by='1')}, a AS (SELECT {AUC} AS roc_auc FROM r), w AS (SELECT {COUNTS} FROM v_scored, (SELECT CAST(0.5 AS DOUBLE) AS t))
        SELECT *, {RATES}, (tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE) AS accuracy, fn / CAST(nullif(fn + tp, 0) AS DOUBLE) AS fnr FROM w, a"""),
    "roc_auc_rank": oracle(f", {RANKED.format(by='1')} SELECT {AUC} AS roc_auc FROM r"),
    "roc_auc_by_collection": oracle(f", {RANKED.format(by='collection')} SELECT collection, {AUC} AS roc_auc FROM r GROUP BY collection"),
    "pr_auc_trapezoid": oracle(f", {POINTS} SELECT sum(step * (prec + before) / 2) AS pr_auc FROM g"),
    "average_precision": oracle(f", {POINTS} SELECT sum(step * prec) AS average_precision FROM g"),
    "recall_at_fpr": oracle(f", {POINTS} SELECT coalesce(max(CASE WHEN fp / CAST(n AS DOUBLE) <= CAST(0.05 AS DOUBLE) THEN tp / CAST(p AS DOUBLE) END), 0) AS recall_at_fpr FROM g"),
    "threshold_sweep": oracle(f", {SWEEP} SELECT * FROM x"),
    "calibrate_threshold": oracle(f", {SWEEP} SELECT * FROM x WHERE recall >= 0.5 ORDER BY f1 DESC, recall DESC, threshold DESC LIMIT 1"),
    "abstention_matrix": oracle(f""", {GAPS} SELECT label, CAST(sum(CASE WHEN score IS NOT NULL AND greatest(score, 1 - score) >= CAST(0.6 AS DOUBLE) AND score < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS predicted_0,
        CAST(sum(CASE WHEN score IS NOT NULL AND greatest(score, 1 - score) >= CAST(0.6 AS DOUBLE) AND score >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS predicted_1,
        CAST(sum(CASE WHEN score IS NULL OR greatest(score, 1 - score) < CAST(0.6 AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS abstained FROM g GROUP BY label"""),
    "classification_metrics": oracle(f", {CLASSES} SELECT * FROM z"),
    "classification_summary": oracle(f""", {CLASSES} SELECT (SELECT count(*) FROM v_multiclass) AS n, (SELECT count(prediction) FROM v_multiclass) AS covered,
        (SELECT count(*) FROM v_multiclass WHERE truth = prediction) / CAST((SELECT count(*) FROM v_multiclass) AS DOUBLE) AS accuracy, avg(f1) AS macro_f1, avg(accuracy) AS balanced_accuracy FROM z"""),
    "confusion_pairs_ranked": oracle(""", p AS (SELECT truth, prediction, count(*) AS n FROM v_multiclass WHERE prediction IS NOT NULL AND truth <> prediction GROUP BY ALL)
        SELECT *, CAST(row_number() OVER (ORDER BY n DESC, truth, prediction) AS INTEGER) AS rank FROM p"""),
    "within_source_auc": oracle(f", {RANKED.format(by='source_video_id')}, a AS (SELECT source_video_id, {AUC} AS auc FROM r GROUP BY source_video_id) SELECT count(auc) AS sources, avg(auc) AS within_source_auc FROM a"),
    "confidence_summary": oracle(f""", {GAPS} SELECT count(score) AS count, CAST(sum(CASE WHEN score IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unknown, avg(score) AS mean, stddev_pop(score) AS std, min(score) AS minimum,
        quantile_cont(score, 0.25) AS q25, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.75) AS q75, max(score) AS maximum FROM g"""),
    "latency_quantiles": oracle(" SELECT video_id, count(*) AS n, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.95) AS p95 FROM v_segments GROUP BY video_id"),
    "seed_aggregate": oracle(f", {GAPS} SELECT source_video_id, avg(score) AS mean, stddev_samp(score) AS std, count(score) AS n, CAST(sum(CASE WHEN score IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM g GROUP BY source_video_id"),
    "class_weights": oracle(" SELECT truth, count(*) AS n, CAST((SELECT count(*) FROM v_multiclass) AS DOUBLE) / CAST(5 * count(*) AS DOUBLE) AS weight FROM v_multiclass GROUP BY truth"),
    "source_label_pivot": oracle(" SELECT source_video_id, " + ", ".join(f"CAST(sum(CASE WHEN truth = {i} THEN 1 ELSE 0 END) AS BIGINT) AS label_{i}" for i in range(5)) + ", count(*) AS clips, sum(CASE WHEN truth = 1 THEN 1 ELSE 0 END) / CAST(nullif(sum(CASE WHEN truth IN (0, 1) THEN 1 ELSE 0 END), 0) AS DOUBLE) AS positive_share FROM v_multiclass GROUP BY source_video_id"),
}
