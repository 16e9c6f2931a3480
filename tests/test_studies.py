import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelquery.operators import geometry
from reelquery.operators import studies as e


def lcs(a, b, most):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + ((x ^ y).bit_count() <= most))
    return table[-1][-1]


def test_ordered_matches_against_the_program(spark):
    rng = random.Random(0)
    rows = [(i, [rng.randrange(64) for _ in range(rng.randint(0, 8))], [rng.randrange(64) for _ in range(rng.randint(0, 8))]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, a array<long>, b array<long>").select("id", e.ordered_matches(F.col("a"), F.col("b"), 1).alias("n"))
    assert {r["id"]: r["n"] for r in df.collect()} == {i: lcs(a, b, 1) for i, a, b in rows}


def test_capture_times(spark):
    df = spark.createDataFrame([("cam_20240131_235959.mp4",), ("cam_20240231_000000.mp4",), ("none",)], "n string")
    rows = [r["t"] for r in df.select(e.capture_time(F.col("n")).alias("t")).collect()]
    assert str(rows[0]) == "2024-01-31 23:59:59" and rows[1:] == [None, None]


def test_guard_groups(spark):
    rows = [("WalkIndia-50", "r1", "True", None), ("WalkIndia-50", None, "true", "a-tour-1"), ("WalkIndia-50", "r1", None, None), ("Snatch-1.0", "r1", "false", "x")]
    df = spark.createDataFrame(rows, "d string, s string, v string, t string")
    got = [r[0] for r in df.select(e.guard_group(F.col("d"), F.col("s"), F.col("v"), F.col("t"))).collect()]
    assert got == ["recording:r1", "a-tour-1", "walkindia-entire-release-unresolved", "snatch-1.0-entire-collection-unresolved"]


def test_best_arm_needs_equal_seeds(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.5), ("b", 2, 0.9)], "arm string, seed int, value double")
    assert e.best_arm(df, "arm", "seed", "value").count() == 0
    assert e.best_arm(df.where("seed = 1"), "arm", "seed", "value").first()["arm"] == "a"


@pytest.mark.parametrize("most", [3, 50])
def test_sample_spans_before_it_fills(spark, most):
    df = spark.createDataFrame([(i, ["train", "val", "test"][i % 3], i % 2) for i in range(30)], "clip_id long, split string, label int")
    rows = e.spanning_sample(df, most).collect()
    assert len(rows) == min(most, 20) and all(r["split"] != "test" for r in rows)
    assert len({(r["split"], r["label"]) for r in rows}) == min(most, 4)


def test_threshold_rematches_what_it_keeps(spark):
    """Detection 1 overlaps both truths, detection 2 only the one that 1 likes best: both can be matched all the same."""
    rows = [(1, 1, "gt", 0.0, 0.0, 10.0, 10.0, 0.0), (1, 2, "gt", 3.0, 0.0, 13.0, 10.0, 0.0), (1, 3, "det", 1.0, 0.0, 11.0, 10.0, 0.9), (1, 4, "det", -2.0, 0.0, 8.0, 10.0, 0.8), (2, 1, "det", 0.0, 0.0, 1.0, 1.0, 0.85)]
    df = spark.createDataFrame(rows, "scene_id long, box_id int, side string, x1 double, y1 double, x2 double, y2 double, score double")
    row = e.tune_threshold(df, [0.5, 0.87], 0.0, 0.5).first()
    assert (row["threshold"], row["tp"], row["fp"], row["fn"]) == (0.5, 2, 1, 0)
    assert e.tune_threshold(df, [0.87, 0.95], 0.4, 0.5).first()["threshold"] == 0.87
    assert e.tune_threshold(df, [0.95], 0.1, 0.5).count() == 0


def test_tuning_shuffles_boxes_once_and_matches_every_level(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(scene, i, rng.choice(["gt", "det"]), x, y, x + rng.randint(2, 6), y + 5.0, rng.choice([0.05, 0.3, 0.5, 0.9, None])) for scene in range(40) for i in range(rng.choice([1, 3, 9])) for x, y in [(float(rng.randint(0, 6)), float(rng.randint(0, 3)))]]
    rows += [(None, 0, "gt", 0.0, 0.0, 9.0, 9.0, 0.0), (None, 1, "det", 0.0, 0.0, 9.0, 9.0, 0.9), (40, 0, "gt", None, 0.0, 9.0, 9.0, 0.0), (40, 1, "det", 0.0, 0.0, 9.0, 9.0, 0.9)]
    levels = [0.1, 0.3, 0.4, 0.6, 0.95]

    def near(p, q):
        shared = max(min(p[5], q[5]) - max(p[3], q[3]), 0) * max(min(p[6], q[6]) - max(p[4], q[4]), 0)
        return shared / ((p[5] - p[3]) * (p[6] - p[4]) + (q[5] - q[3]) * (q[6] - q[4]) - shared) >= 0.3

    def matched(level):
        total = 0
        for scene in range(40):
            gt, det = ([r for r in rows if r[0] == scene and r[2] == side] for side in ("gt", "det"))
            owner = {}

            def place(d, tried):
                for g in gt:
                    if g[1] not in tried and near(g, d):
                        tried.add(g[1])
                        if g[1] not in owner or place(owner[g[1]], tried):
                            owner[g[1]] = d
                            return True
                return False

            total += sum(place(d, set()) for d in det if d[7] is not None and d[7] >= level)
        return total

    df = spark.createDataFrame(rows, "scene_id long, box_id int, side string, x1 double, y1 double, x2 double, y2 double, score double")
    kept = F.size(F.filter(F.array(*map(F.lit, levels)), lambda t: t <= F.col("score")))
    for together in (1, 17, geometry.ROWS_TOGETHER):
        monkeypatch.setattr(geometry, "ROWS_TOGETHER", together)
        found = dict(map(tuple, geometry.matched_by_level(df, 0.3, kept, len(levels)).collect()))
        assert found == {i: matched(t) for i, t in enumerate(levels)}
    tuned = e.tune_threshold(df, [0.4], 0.0, 0.3)
    row, gt, det = tuned.first(), sum(r[2] == "gt" for r in rows), sum(r[2] == "det" and (r[7] or 0) >= 0.4 for r in rows)
    assert (row["tp"], row["fp"], row["fn"]) == (matched(0.4), det - matched(0.4), gt - matched(0.4))
    assert tuned._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(scene_id") == 1


def test_near_pairs_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    scene, truth = np.sort(rng.integers(0, 6, 60)), rng.random(60) < 0.5
    low = rng.integers(0, 5, (60, 2))
    sides = np.hstack([low, low + 4]).astype(float)
    sides[5, 0] = np.nan
    found = []
    for most in (1, 7, 10**6):
        monkeypatch.setattr(geometry, "PAIRS_AT_ONCE", most)
        found.append(sorted(zip(*map(list, geometry.near_pairs(scene, truth, sides, 0.4)), strict=True)))
    assert found[0] == found[1] == found[2] and all(truth[a] and not truth[b] and scene[a] == scene[b] for a, b in found[0])
    none = geometry.near_pairs(scene, np.zeros(60, bool), sides, 0.4)
    assert len(none[0]) == len(none[1]) == 0
