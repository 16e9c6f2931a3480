import random

import pytest
from pyspark.sql import functions as F

from reelquery.operators import intervals as t
from reelquery.streaming.alerts import fold_segments


def spans(spark, rows):
    return spark.createDataFrame([(1, float(a), float(b)) for a, b in rows], "video_id long, start_s double, end_s double")


def scored(spark, rows):
    return spark.createDataFrame([(1, i, float(a), float(b), float(s)) for i, (a, b, s) in enumerate(rows)], "video_id long, seg long, start_s double, end_s double, score double")


def test_golden_frame_labels(spark):
    videos = spark.createDataFrame([(1, 6, 2.0)], "video_id long, frames long, fps double")
    rows = t.frame_labels(videos, spans(spark, [(0.5, 1.5)]), "frames", "fps").orderBy("frame").collect()
    assert [r["label"] for r in rows] == [0, 1, 1, 0, 0, 0]


def test_golden_segment_frames(spark):
    rows = t.unit_segment_frames(spark.createDataFrame([(1, 65)], "video_id long, frames long"), "frames", 2).orderBy("seg").collect()
    assert [(r["first"], r["last"]) for r in rows] == [(0, 32), (32, 65)]


def test_golden_grid_windows(spark):
    violent = set(range(20, 30))
    frames = spark.createDataFrame([(1, f, int(f in violent)) for f in range(40)], "video_id long, frame long, label int")
    rows = t.grid_windows(frames, 5, 5).collect()
    assert sorted(r["start"] for r in rows if r["kind"] == "violent") == [20, 25]
    assert sorted(r["start"] for r in rows if r["kind"] == "normal") == [0, 5, 10, 35]


def test_golden_evenly(spark):
    df = spark.createDataFrame([(1, i) for i in range(10)], "video_id long, i long")
    assert sorted(r["i"] for r in t.evenly(df, 2, "video_id", "i").collect()) == [2, 7]


def test_golden_alert(spark):
    rows = t.hysteresis_alerts(scored(spark, [(0, 1, 0.9), (1, 2, 0.9), (2, 3, 0.9), (3, 4, 0.1)]), 0.5, 0.5, 2.0, 1.0).collect()
    assert [tuple(r)[1:] for r in rows] == [(0.0, 3.0, 2.0)]


@pytest.mark.parametrize("seed", range(3))
def test_alerts_equal_the_stream_fold(spark, seed):
    rng, at, rows = random.Random(seed), 0, []
    for _ in range(40):
        at += rng.choice([0, 0, 0, 1])
        rows.append((at, at + 1, rng.random()))
        at += 1
    df = scored(spark, rows)
    closed, (_, start, decision, previous) = fold_segments(df.toPandas(), (None, None, None, None), 0.6, 0.4, 2.0, 0.5)
    closed += [(start, previous, decision)] if decision is not None else []
    assert sorted(tuple(r)[1:] for r in t.hysteresis_alerts(df, 0.6, 0.4, 2.0, 0.5).collect()) == sorted(closed)


def test_merge_touching_and_repeated(spark):
    rows = t.merge_intervals(spans(spark, [(3, 4), (0, 1), (1, 2), (0, 1), (6, 7), (6, 6.5)])).collect()
    assert sorted(tuple(r)[1:] for r in rows) == [(0.0, 2.0), (3.0, 4.0), (6.0, 7.0)]


def test_overlap_join_against_pairs(spark):
    rng = random.Random(4)
    a = [(x := rng.uniform(0, 300), x + rng.uniform(0.1, 150)) for _ in range(30)]
    b = [(x := rng.uniform(0, 300), x + rng.uniform(0.1, 150)) for _ in range(30)]
    want = sorted(min(q, s) - max(p, r) for p, q in a for r, s in b if p < s and r < q)
    got = sorted(r["overlap"] for r in t.overlap_join(spans(spark, a), spans(spark, b)).collect())
    assert got == pytest.approx(want)


def test_false_alert_without_events(spark):
    videos = spark.createDataFrame([(1, 10.0), (2, 5.0)], "video_id long, duration double")
    rows = {r["video_id"]: r for r in t.temporal_false_alert(spans(spark, [(0, 2), (1, 3)]), spans(spark, [(2, 4)]), videos).collect()}
    assert (rows[1]["false_seconds"], rows[1]["negative_seconds"]) == (2.0, 8.0)
    assert (rows[2]["false_seconds"], rows[2]["negative_seconds"]) == (0.0, 5.0)


def test_projection_with_fewer_frames_than_segments(spark):
    df = spark.createDataFrame([(1, 2, [0.0, 0.1, 0.2, 0.3])], "video_id long, frames long, scores array<double>")
    assert [r["score"] for r in t.project_scores(df, "frames", "scores").orderBy("frame").collect()] == [0.1, 0.3]
    rows = t.project_scores(df.withColumn("frames", F.lit(8)), "frames", "scores", "interpolate").orderBy("frame").collect()
    assert rows[0]["score"] == 0.0 and rows[-1]["score"] == pytest.approx(0.3)


def test_bad_settings(spark):
    with pytest.raises(ValueError):
        t.hysteresis_alerts(scored(spark, []), on=0.2, off=0.5)


def brute_merged(rows):
    out = []
    for low, high in sorted(rows):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


@pytest.mark.parametrize("chunk", [0.5, 7.0, 3_600.0])
def test_merged_intervals_do_not_depend_on_chunks(spark, chunk):
    rng = random.Random(int(chunk))
    rows = [(k, float(a), float(a + rng.choice([0, 1, 3, 40]))) for k in range(3) for a in (rng.randint(-20, 200) for _ in range(40))]
    found = t.merge_intervals(spark.createDataFrame(rows, "video_id long, start_s double, end_s double"), chunk_seconds=chunk).collect()
    assert sorted(map(tuple, found)) == sorted((k, a, b) for k in range(3) for a, b in brute_merged([r[1:] for r in rows if r[0] == k]))


@pytest.mark.parametrize("chunk", [1, 3, 4_096])
def test_suspicious_runs_do_not_depend_on_chunks(spark, chunk):
    rng = random.Random(chunk)
    rows = [(k, i, float(i), float(i + rng.choice([1, 1, 2])), rng.random()) for k in range(2) for i in range(60)]
    found = t.suspicious_runs(spark.createDataFrame(rows, "video_id long, seg long, start_s double, end_s double, score double"), 0.4, chunk_segments=chunk).collect()
    want = []
    for k in range(2):
        last = None
        for _, _, a, b, x in (r for r in rows if r[0] == k and r[4] >= 0.4):
            if last is None or a > last:
                want.append([k, a, b, x])
            else:
                want[-1][2:] = [max(want[-1][2], b), max(want[-1][3], x)]
            last = b
    assert sorted(map(tuple, found)) == sorted(map(tuple, want))


@pytest.mark.parametrize("cell", [0.5, 8.0, 1_000.0])
def test_overlaps_of_short_and_very_long_intervals(spark, cell):
    rng = random.Random(int(cell))
    make = lambda n: [(rng.randrange(2), float(a), a + rng.choice([0.0, 0.5, 3.0, 80.0])) for a in (rng.randint(-50, 300) for _ in range(n))]
    left, right = [*make(40), (0, -10.0, 31_536_000.0), (1, 5.0, 5.0)], [*make(40), (0, 20.0, 40_000_000.0), (1, -1.0, 900_000.0)]
    schema = "video_id long, start_s double, end_s double"
    found = t.overlap_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), cell_seconds=cell).collect()
    want = [(k, a, b, c, d, min(b, d) - max(a, c)) for k, a, b in left for q, c, d in right if k == q and a < d and c < b and a < b and c < d]
    assert sorted(map(tuple, found)) == sorted(want)


def test_an_interval_of_a_year_has_few_nodes(spark):
    row = spark.range(1).select(t.cover(F.lit(3), F.lit(31_536_003), 25).alias("nodes")).first()
    held = sorted((x["node"] << x["level"], (x["node"] + 1) << x["level"]) for x in row["nodes"])
    assert len(held) <= 50 and held[0][0] == 3 and held[-1][1] == 31_536_004 and all(a[1] == b[0] for a, b in zip(held, held[1:]))


@pytest.mark.parametrize(("width", "margin"), [(1, 0), (3, 0), (5, 7), (4, 40)])
def test_grid_windows_by_brute_force(spark, width, margin):
    rng = random.Random(width)
    videos = {v: [int(rng.random() < p) for _ in range(rng.randint(1, 90))] for v, p in enumerate((0.0, 0.02, 0.1, 0.9, 1.0))} | {9: [0] * 30 + [1] * 30 + [0] * 30}
    frames = spark.createDataFrame([(v, f, x) for v, labels in videos.items() for f, x in enumerate(labels)], "video_id long, frame long, label int")
    want = []
    for v, labels in videos.items():
        for s in range(0, len(labels) - width + 1, width):
            if all(labels[s : s + width]):
                want.append((v, s, "violent"))
            elif not any(labels[max(0, s - margin) : s + width + margin]):
                want.append((v, s, "normal"))
    assert sorted(tuple(r) for r in t.grid_windows(frames, width, margin).collect()) == want
    unknown = spark.createDataFrame([(1, f, None if f == 2 else 0) for f in range(8)], "video_id long, frame long, label int")
    assert sorted(tuple(r) for r in t.grid_windows(unknown, 4, 1).collect()) == [(1, 4, "normal")]
    assert t.grid_windows(frames.limit(0), width, margin).count() == 0


def test_even_spacing_by_brute_force(spark):
    rng = random.Random(3)
    sizes = {("a", "x"): 1, ("a", "y"): 4, ("b", "x"): 5, ("b", "y"): 6, (None, "x"): 90}
    rows = [(v, kind, at) for (v, kind), n in sizes.items() for at in rng.sample(range(1000), n)]
    df = spark.createDataFrame(rows, "v string, kind string, at long").where("v IS NOT NULL")
    got = t.evenly(df, F.when(F.col("kind") == "x", 2).otherwise(5), ["v", "kind"], "at").collect()
    want = []
    for (v, kind), n in sizes.items():
        k, order = 2 if kind == "x" else 5, sorted(a for x, y, a in rows if (x, y) == (v, kind))
        want += [(v, kind, a) for i, a in enumerate(order) if v and (n <= k or i in {int((j + 0.5) * n / k) for j in range(k)})]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert t.evenly(df.limit(0), 3, "v", "at").count() == 0
