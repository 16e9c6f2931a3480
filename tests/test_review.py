import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelquery.operators import cascade as c
from reelquery.operators import catalog as k
from reelquery.operators import geometry as g
from reelquery.operators import graph
from reelquery.operators import ingest as i
from reelquery.operators import integrity as n
from reelquery.operators import resampling as r
from reelquery.sources import manifests as s


def boxes(spark, rows):
    return spark.createDataFrame([(1, j, side, *map(float, b), 0.5) for j, (side, b) in enumerate(rows)], "scene_id long, box_id int, side string, x1 double, y1 double, x2 double, y2 double, score double")


@pytest.mark.parametrize("seed", range(4))
def test_assignment_is_optimal(seed):
    rng = np.random.default_rng(seed)
    gain = rng.random((rng.integers(1, 6), rng.integers(1, 6))) * (rng.random() > 0.3)
    rows, columns = gain.shape
    if rows <= columns:
        best = max(sum(gain[a, b] for a, b in enumerate(p)) for p in itertools.permutations(range(columns), rows))
    else:
        best = max(sum(gain[b, a] for a, b in enumerate(p)) for p in itertools.permutations(range(rows), columns))
    assert sum(gain[p] for p in g.assignment(gain)) == pytest.approx(best)


@pytest.mark.parametrize("seed", range(6))
def test_stacked_scenes_match_as_well_as_single_ones(seed):
    rng = np.random.default_rng(seed)
    rows, scenes = [], []
    for scene in range(60):
        gts, dets = rng.integers(1, 16 if scene % 7 == 0 else 6, 2)
        iou = np.where(rng.random((gts, dets)) < 0.5, np.round(rng.uniform(0.3, 1.0, (gts, dets)), 1), 0)
        iou[rng.integers(gts), rng.integers(dets)] = 0.5
        scenes.append(iou)
        rows += [(scene, 100 - a, b * 3, iou[a, b]) for a, b in zip(*np.nonzero(iou), strict=True)]
    scene, gt, det, iou = (np.array(x) for x in zip(*rows, strict=True))
    kept = g.kept_pairs(scene, gt, det, iou)
    for number, all_iou in enumerate(scenes):
        own = kept & (scene == number)
        assert len(set(gt[own])) == own.sum() == len(set(det[own]))
        gain = np.where(all_iou > 0, min(all_iou.shape) + 1 + all_iou, 0)
        best = [p for p in g.assignment(gain) if gain[p] > 0]
        assert own.sum() == len(best) and iou[own].sum() == pytest.approx(sum(all_iou[p] for p in best))


def test_matching_takes_most_pairs_first(spark):
    df = boxes(spark, [("gt", (0, 0, 10, 10)), ("gt", (0, 0, 10, 6)), ("det", (0, 0, 10, 9)), ("det", (0, 0, 10, 14))])
    found = {(x["gt_id"], x["det_id"]) for x in g.match_boxes(df, 0.5).collect()}
    assert found == {(0, 3), (1, 2)}
    row = g.detection_metrics(df, g.match_boxes(df, 0.5)).first()
    assert row["precision"] == row["recall"] == row["f1"] == 1.0


def test_no_match_is_undefined_or_zero(spark):
    df = boxes(spark, [("gt", (0, 0, 1, 1)), ("det", (5, 5, 6, 6))])
    row = g.detection_metrics(df, g.match_boxes(df)).first()
    assert (row["matched"], row["missed"], row["extra"], row["precision"], row["mean_iou"]) == (0, 1, 1, 0.0, None)
    assert g.detection_metrics(df.limit(0), g.match_boxes(df.limit(0))).first()["precision"] is None


def test_suppression_against_a_loop(spark):
    rng = random.Random(3)
    rows = [("det", (x := rng.uniform(0, 20), y := rng.uniform(0, 20), x + rng.uniform(1, 15), y + rng.uniform(1, 15))) for _ in range(40)]
    df = boxes(spark, rows).withColumn("score", F.round(F.rand(1) * 5) / 5)
    plain = sorted(df.collect(), key=lambda b: (-b["score"], b["x1"], b["y1"], b["x2"], b["y2"], b["box_id"]))

    def iou(a, b):
        w, h = max(0, min(a["x2"], b["x2"]) - max(a["x1"], b["x1"])), max(0, min(a["y2"], b["y2"]) - max(a["y1"], b["y1"]))
        area = lambda z: (z["x2"] - z["x1"]) * (z["y2"] - z["y1"])
        return w * h / (area(a) + area(b) - w * h)

    kept = []
    for b in plain:
        if all(iou(a, b) <= 0.3 for a in kept):
            kept.append(b)
    found = g.suppress(df, 0.3, 6).orderBy("keep_rank").collect()
    assert [b["box_id"] for b in found] == [b["box_id"] for b in kept[:6]]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + j) for j in range(1, 20)]
    df = spark.createDataFrame(edges, "a long, b long")
    nodes = spark.createDataFrame([(j,) for j in [*range(31), *range(100, 120), 500]], "id long")
    roots = {x["id"]: x["root"] for x in graph.connected_components(nodes, df).collect()}
    assert all(roots[j] == 0 for j in range(31)) and all(roots[j] == 100 for j in range(100, 120)) and roots[500] == 500
    assert {(x["id"], x["root"]) for x in graph.linked_roots(df, at_once=0).collect()} == {(x["id"], x["root"]) for x in graph.linked_roots(df).collect()} == {(j, roots[j]) for j in roots if j != 500}
    assert graph.linked_roots(df.limit(0)).count() == 0


def test_hamming_pairs_against_all_pairs(spark):
    rng = random.Random(5)
    rows = [(j, rng.getrandbits(64) - 2**63) for j in range(60)]
    rows += [(100 + j, h ^ (1 << rng.randrange(64)) if (h ^ (1 << 3)) else h) for j, h in rows[:20]]
    rows = [(j, h if h < 2**63 else h - 2**64) for j, h in rows]
    df = spark.createDataFrame(rows, "id long, h long")
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if ((x ^ y) & (2**64 - 1)).bit_count() <= 4}
    got = [(x["a"], x["b"]) for x in graph.hamming_pairs(df, df, 4).where("a < b").collect()]
    assert set(got) == want and len(got) == len(want)


def test_split_is_whole_and_reproducible(spark):
    df = spark.createDataFrame([(f"s{j}",) for j in range(20)], "source string")
    rows = graph.split_groups(df, "source", 7, {"train": 0.7, "val": 0.15, "test": 0.15}).collect()
    counts = {x: sum(q["split"] == x for q in rows) for x in ("train", "val", "test")}
    assert counts == {"train": 14, "val": 3, "test": 3}
    again = graph.split_groups(df.repartition(5), "source", 7, {"train": 0.7, "val": 0.15, "test": 0.15}).collect()
    assert {tuple(x) for x in rows} == {tuple(x) for x in again}


def test_annotation_times_and_labels(spark):
    df = spark.createDataFrame([("1:05.5", " Non-Violence"), ("75", "VIOLENCE"), ("0:75", "fight"), ("", ""), (None, None), (".5", "not   sure"), ("3.", "not-sure")], "t string, l string")
    rows = df.select(i.annotation_seconds(F.col("t")).alias("s"), i.normalize_label(F.col("l")).alias("l")).collect()
    assert [x["s"] for x in rows] == [65.5, 75.0, None, None, None, 0.5, 3.0]
    assert [x["l"] for x in rows] == ["non_violence", "violence", None, None, None, "not_sure", "not_sure"]


def test_clip_names(spark):
    names = ["v__#1_label_A", "v__#2_label_B1-0-0", "v__#3_label_B1-G-0", "w__#1_label_B2-0-0", "w__#9_label_B4-B5-0"]
    df = spark.createDataFrame([(x,) for x in names], "n string").select(i.clip_kind(F.col("n")).alias("k"), i.clip_source(F.col("n")).alias("s"), i.safe_name(F.col("n")).alias("safe"))
    assert [x["k"] for x in df.collect()] == ["normal", "violent", "excluded", "excluded", "violent"]
    assert df.first()["s"] == "v" and df.first()["safe"] == "v___1_label_A"


def test_unsafe_cells_and_paths(spark):
    df = spark.createDataFrame([("=1",), (" -x",), ("a-b",), ("../x",), ("a/b",), ("/a",)], "t string")
    rows = df.select(k.csv_safe(F.col("t")).alias("c"), i.scoped_path(F.col("t")).alias("p")).collect()
    assert [x["c"] for x in rows[:3]] == ["'=1", "' -x", "a-b"]
    assert [x["p"] for x in rows[3:]] == [False, True, False]


def test_cascade_keeps_abstention(spark):
    rows = [(1, 0, 0.0, 1.0, 0.9, 0, None), (1, 1, 1.0, 2.0, 0.8, 2, 3), (2, 0, 0.0, 1.0, 0.2, 1, 1), (3, 0, 0.0, 1.0, 0.95, 0, 4)]
    df = spark.createDataFrame(rows, "video_id long, seg long, start_s double, end_s double, score double, actors int, behavior int")
    found = {x["video_id"]: x for x in c.assess_review(c.results(df, 0.5), "coverage").collect()}
    assert found[1]["state"] == "behavior_review" and found[1]["behavior"] == 3 and found[1]["reason"] == "partial_actor_coverage" and found[1]["suggested"] is None
    assert found[2]["state"] == "no_anomaly" and found[2]["reason"] == "not_routed_actors_unexamined" and not found[2]["needs_review"]
    assert found[3]["state"] == "generic_anomaly" and found[3]["behavior"] is None and found[3]["reason"] == "no_actors"


def test_queue_transitions(spark):
    items = spark.createDataFrame([(1, 1, "running", 0), (1, 2, "running", 3), (2, 1, "queued", 0), (2, 2, "completed", 1)], "job_id long, item_seq int, status string, attempts int")
    jobs = spark.createDataFrame([(1, 0), (2, 1)], "job_id long, cancel_requested int")
    states = {(x["job_id"], x["item_seq"]): x["status"] for x in k.recover(items, jobs, 1).collect()}
    assert states == {(1, 1): "queued", (1, 2): "failed", (2, 1): "cancelled", (2, 2): "completed"}
    assert {x["job_id"]: x["state"] for x in k.job_states(items).collect()} == {1: "running", 2: "queued"}


def test_manifest_guards(spark, tmp_path):
    base = dict.fromkeys([x.split()[0] for x in s.RECORD.split(", ")])
    good = base | {"dataset": "d", "video_id": "v", "source_video_id": "s", "path": "p", "split": "train", "label": 0, "temporal_annotations": [[0.0, 1.0]]}
    df = spark.createDataFrame([good], s.RECORD)
    s.write_manifest(df, str(tmp_path / "m"))
    assert s.read_manifest(spark, str(tmp_path / "m")).count() == 1
    with pytest.raises(Exception, match="exists"):
        s.write_manifest(df, str(tmp_path / "m"))
    bad = spark.createDataFrame([good, good | {"split": "test"}, good | {"video_id": "w", "temporal_annotations": [[2.0, 1.0]]}], s.RECORD)
    codes = {x["code"] for x in s.record_violations(bad).collect()}
    assert codes == {"duplicate_video", "source_crosses_splits", "invalid_interval"}
    with pytest.raises(s.ManifestError):
        s.write_manifest(bad, str(tmp_path / "n"))


def test_strict_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("clip,label\nx,1\ny,0,extra\nz,0\n")
    rows, broken = s.read_csv(spark, str(tmp_path / "a.csv"))
    assert sorted(x["clip"] for x in rows.collect()) == ["x", "z"] and [x["line"] for x in broken.collect()] == ["y,0,extra"]
    (tmp_path / "b.csv").write_text('\ufeffclip,label\n"a\nb",1\n"say ""hi""",0\nclip,label\n')
    rows, broken = s.read_csv(spark, str(tmp_path / "b.csv"))
    assert sorted((x["clip"], x["label"]) for x in rows.collect()) == [("a\nb", "1"), ("clip", "label"), ('say "hi"', "0")] and broken.count() == 0
    for text in ("clip,clip\n", "clip,\nx,1\n", ""):
        (tmp_path / "c.csv").write_text(text)
        with pytest.raises(s.ManifestError):
            s.read_csv(spark, str(tmp_path / "c.csv"))


def test_settled_labels(spark):
    df = spark.createDataFrame([("a", "x", "1"), ("a", "x", "1"), ("b", "x", "1"), ("b", "x", "0"), ("c", "x", "7"), (None, "x", "1")], "clip string, category string, label string")
    labels, bad = s.settle_labels(df)
    assert [(x["clip"], x["copies"]) for x in labels.collect()] == [("a", 2)]
    assert sorted((x["clip"] or "", x["reason"]) for x in bad.collect()) == [("", "invalid"), ("b", "conflict"), ("b", "conflict"), ("c", "invalid")]


def test_frame_annotation_lines(spark):
    lines = spark.createDataFrame([("Abuse01.mp4  Abuse  11  20  -1  -1",), ("Normal.mp4 Normal -1 -1 -1 -1",), ("b.mp4 Fight 1 10 21 33",)], "value string")
    records = spark.createDataFrame([("v1", "abuse01.mp4", 10.0, 100), ("v2", "normal.mp4", 10.0, 100), ("v3", "b.mp4", 10.0, 30)], "video_id string, file string, fps double, num_frames long")
    rows = sorted(tuple(x) for x in s.frame_annotations(lines, records, 3).collect())
    assert rows == [("v1", 1.0, 2.0), ("v3", 0.0, 1.0), ("v3", 2.0, 3.0)]
    for bad in ("b.mp4 Fight 21 40", "b.mp4 Fight 5 4", "b.mp4 Fight 5", "b.mp4 Fight x 9", "other.mp4 Fight 1 2"):
        with pytest.raises(s.ManifestError):
            s.frame_annotations(spark.createDataFrame([(bad,)], "value string"), records, 3)


def test_receipts(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, sha256 string")
    frozen = n.receipt({"seed": 7}, df)
    assert n.receipt_violations(frozen, df) == []
    assert n.receipt_violations(frozen, spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], df.schema)) == ["b", "c"]
    assert n.receipt_violations(frozen | {"identity": {"seed": 8}}, df) == ["receipt"]


def test_population_hash_ignores_order_not_copies(spark):
    df = spark.createDataFrame([(f"{j:064x}",) for j in range(50)], "h string")
    one = n.population_hash(df, "h").first()
    assert n.population_hash(df.repartition(9), "h").first() == one
    assert n.population_hash(df.unionByName(df.limit(1)), "h").first() != one


def test_bootstrap_contains_the_estimate_and_repeats(spark):
    df = spark.createDataFrame([(f"c{j % 12}", j % 3 == 0) for j in range(200)], "cluster string, hit boolean")
    args = (df, "cluster", F.col("hit").cast("int"), F.lit(1), 100, 3)
    row = r.cluster_bootstrap(*args).first()
    assert row["low"] <= row["estimate"] <= row["high"] and row == r.cluster_bootstrap(*args).first()
