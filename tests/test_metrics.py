import itertools
import random

import pytest

from reelquery.functions.prefix import exact_quantiles, running_totals
from reelquery.operators import metrics as m


def scored(spark, labels, scores, source=None):
    rows = [(i, y, s, (source or ["s"] * len(labels))[i]) for i, (y, s) in enumerate(zip(labels, scores, strict=True))]
    return spark.createDataFrame(rows, "clip_id long, label int, score double, source_video_id string")


def test_golden_binary_metrics(spark):
    # of 3 x 2 pairs, 0.2 against 0.3 is out of order and 0.2 against 0.2 a tie
    row = m.binary_metrics(scored(spark, [0, 1, 0, 1, 1], [0.2, 0.2, 0.3, 0.8, 0.55])).first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (2, 0, 1, 2)
    assert row["roc_auc"] == 4.5 / 6 and row["precision"] == 1 and row["recall"] == 2 / 3 and row["f1"] == 0.8 and row["fpr"] == 0


def test_golden_calibration(spark):
    row = m.calibrate_threshold(scored(spark, [1, 0, 1, 0, 0], [0.35, 0.3, 0.75, 0.7, 0.2]), [0.3, 0.35, 0.6, 0.8], 1.0).first()
    assert row["threshold"] == 0.35 and row["recall"] == 1.0


def test_calibration_needs_both_classes_and_recall(spark):
    assert m.calibrate_threshold(scored(spark, [1, 1], [0.4, 0.9]), [0.5], 0.1).count() == 0
    assert m.calibrate_threshold(scored(spark, [0, 1], [0.4, 0.3]), [0.5], 0.9).count() == 0


def test_abstention_counts_nulls_and_low_confidence(spark):
    rows = m.abstention_matrix(scored(spark, [0, 0, 1, 1], [0.1, None, 0.55, 0.9]), 0.7).orderBy("label").collect()
    assert [tuple(r)[1:] for r in rows] == [(1, 0, 1), (0, 1, 1)]


def test_one_class_has_no_auc(spark):
    assert m.roc_auc(scored(spark, [1, 1], [0.2, 0.3])).first()["roc_auc"] is None
    row = m.binary_metrics(scored(spark, [1, 1], [0.2, 0.3])).first()
    assert row["fpr"] is None and row["recall"] == 0.0 and row["precision"] == 0.0


def test_auc_against_all_pairs(spark):
    rng = random.Random(1)
    labels, scores = [rng.randint(0, 1) for _ in range(60)], [rng.randint(0, 9) / 10 for _ in range(60)]
    sources = [f"s{rng.randint(0, 3)}" for _ in range(60)]

    def brute(rows):
        pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
        return sum((p > n) + (p == n) / 2 for p, n in itertools.product(pos, neg)) / (len(pos) * len(neg)) if pos and neg else None

    assert m.roc_auc(scored(spark, labels, scores)).first()["roc_auc"] == pytest.approx(brute(list(zip(labels, scores, strict=True))))
    each = [brute([(y, s) for y, s, o in zip(labels, scores, sources, strict=True) if o == x]) for x in set(sources)]
    each = [x for x in each if x is not None]
    assert m.within_source_auc(scored(spark, labels, scores, sources)).first()["within_source_auc"] == pytest.approx(sum(each) / len(each))


def test_order_of_rows_does_not_matter(spark):
    df = scored(spark, [0, 1, 0, 1, 1], [0.1, 0.2, 0.2, 0.8, 0.3])
    assert m.pr_curve_areas(df).collect() == m.pr_curve_areas(df.repartition(7)).collect()


def test_running_totals_and_quantiles(spark):
    values = [random.Random(2).randint(0, 500) for _ in range(300)]
    df = spark.createDataFrame([(float(v), 1) for v in sorted(set(values))], "v double, n long")
    totals = {r["v"]: r["cum_n"] for r in running_totals(df, "v", ["n"]).collect()}
    assert totals == {float(v): i + 1 for i, v in enumerate(sorted(set(values)))}
    q = exact_quantiles(spark.createDataFrame([(v,) for v in values], "v int"), "v", {"a": 0.25, "b": 0.95}).first()
    import numpy as np

    assert [q["a"], q["b"]] == pytest.approx(np.quantile(values, [0.25, 0.95]).tolist())


def test_class_metrics_keep_absent_classes(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, None)], "truth int, prediction int")
    rows = {r["class"]: r for r in m.class_metrics(df, 3).collect()}
    assert rows[2]["support"] == 0 and rows[2]["f1"] == 0.0 and rows[2]["accuracy"] is None
    assert rows[0]["precision"] == 0.5 and rows[1]["recall"] == 0.0
    assert m.classification_summary(df, 3).first()["covered"] == 2


def test_empty_tables(spark):
    df = scored(spark, [], [])
    assert m.roc_auc(df).first()["roc_auc"] is None
    assert m.binary_metrics(df).first()["tp"] == 0
    assert m.confidence_summary(df, "score").first()["count"] == 0
