import pytest

from reelquery.operators import catalog as k
from reelquery.operators import evaluation as e
from reelquery.sources import detections as d
from reelquery.sources.manifests import ManifestError

ROW = {"version": 1, "coordinates": "absolute_xyxy", "dataset": "d", "clip_id": "a", "image_size": [10, 10], "detections": [], "metadata": {}}


def found(boxes):
    return [{"box": [float(x) for x in b], "score": s, "class_id": 1} for b, s in boxes]


def test_detections_round_trip(spark, tmp_path):
    rows = [ROW, ROW | {"clip_id": "b", "detections": found([((5, 5, 9, 9), 0.5), ((0, 0, 2, 2), 0.4), ((0, 0, 2, 2), 0.9)])}]
    d.write_detections(spark.createDataFrame(rows, d.DETECTIONS), str(tmp_path / "x"))
    back = {r["clip_id"]: r["detections"] for r in d.read_detections(spark, str(tmp_path / "x")).collect()}
    assert back["a"] == [] and [x["score"] for x in back["b"]] == [0.9, 0.4, 0.5]
    bad = spark.createDataFrame([ROW, ROW, ROW | {"clip_id": "c", "detections": found([((2, 0, 1, 1), 0.5)])}, ROW | {"clip_id": "e", "version": 2}], d.DETECTIONS)
    assert sorted((r["clip_id"], r["code"]) for r in d.detection_violations(bad).collect()) == [("a", "duplicate_clip"), ("c", "invalid_detection"), ("e", "unsupported_format")]
    with pytest.raises(ManifestError):
        d.write_detections(bad, str(tmp_path / "y"))


def test_bags(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0]]), (2, [[1.0]]), (3, [[1.0, float("nan")]]), (4, None)], "video_id long, bag array<array<double>>")
    assert {r["video_id"]: r["code"] for r in d.bag_violations(df, "bag", 1, 2).collect()} == {2: "shape", 3: "not_finite", 4: "shape"}


def test_scene_rules(spark):
    actor = [(0.0, 0.0, 0.5, 0.5)]
    rows = [("s", "v", 1, "train", ["p1"], actor), ("s", "v", 1, "train", ["p2"], actor), ("t", "w", 1, "train", ["p3"], actor), ("t", "w", 2, "test", ["p3"], [(0.5, 0.0, 0.4, 1.0)])]
    df = spark.createDataFrame(rows, "source_id string, video_id string, center_frame long, split string, frame_paths array<string>, actors array<struct<x1: double, y1: double, x2: double, y2: double>>")
    assert {r["code"] for r in d.scene_violations(df).collect()} == {"duplicate_scene", "source_id_crosses_splits", "video_id_crosses_splits", "path_crosses_splits", "invalid_actor"}


def test_bags_and_frames(spark):
    segments = spark.createDataFrame([(1, 0.2), (1, 0.9), (2, 0.1)], "video_id long, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "video_id long, label int")
    row = e.evaluate_bags(segments, labels).first()
    assert (row["tp"], row["tn"], row["roc_auc"]) == (1, 1, 1.0)
    videos = spark.createDataFrame([(1, 4, 1.0, [0.1, 0.9])], "video_id long, frames long, fps double, scores array<double>")
    row = e.evaluate_frames(videos, spark.createDataFrame([(1, 2.0, 4.0)], "video_id long, start_s double, end_s double")).first()
    assert (row["tp"], row["tn"], row["fp"], row["fn"]) == (2, 2, 0, 0)


def test_groups_and_actors(spark):
    rows = [(0, 0, [(1, 1, True), (0, 1, True), (-100, 0, True), (1, 0, False)]), (1, None, [])]
    df = spark.createDataFrame(rows, "truth int, prediction int, actors array<struct<truth: int, prediction: int, valid: boolean>>")
    got = {r["level"]: r for r in e.group_and_actor_metrics(df, 2, 2).collect()}
    assert (got["group"]["n"], got["group"]["covered"], got["group"]["accuracy"]) == (2, 1, 0.5) and (got["actor"]["n"], got["actor"]["accuracy"]) == (2, 0.5)


def test_pairs_of_predictions(spark):
    a = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (3, 1, None)], "id int, truth int, prediction int")
    b = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (4, 1, 1)], "id int, truth int, prediction int")
    row = e.paired_predictions(a, b, "id").first()
    assert (row["pairs"], row["both_right"], row["only_first"], row["agreement"], row["unpaired"]) == (2, 1, 1, 0.5, 2)


def test_frozen_splits(spark):
    schema = "video_id string, source_video_id string, split string, sha256 string"
    old = spark.createDataFrame([("a", "s", "train", "1"), ("b", "t", "val", "2"), ("c", "u", "test", "3")], schema)
    new = spark.createDataFrame([("a", "s", "test", "1"), ("b", "t", "val", "9"), ("d", "t", "test", "4")], schema)
    assert e.split_violations(old, old).count() == 0
    got = {(r["video_id"], r["code"]) for r in e.split_violations(old, new).collect()}
    assert got == {("a", "moved"), ("b", "changed"), ("c", "missing"), ("d", "added"), ("t", "source_crosses_splits")}
    merged = e.merge_splits({"x": old, "y": old})
    assert merged.count() == 6 and merged.select("video_id").distinct().count() == 6


def test_reviews_and_deletion(spark):
    items = spark.createDataFrame([(1, 1, 7, "completed", 1), (1, 2, 8, "queued", 0)], "job_id long, item_seq int, clip_id long, status string, attempts int")
    reviews = spark.createDataFrame([(1, 1, 1, "ok")], "job_id long, item_seq int, seq int, decision string")
    rows = k.new_reviews(reviews, spark.createDataFrame([(1, 1, "no"), (1, 2, "ok")], "job_id long, item_seq int, decision string"), items).collect()
    assert [(r["item_seq"], r["seq"]) for r in rows] == [(1, 2)]
    uploads = spark.createDataFrame([(7, True, "ready"), (8, True, "ready"), (9, False, "ready")], "clip_id long, owned boolean, status string")
    states = {r["clip_id"]: r["status"] for r in k.delete_uploads(uploads, uploads.select("clip_id"), items).collect()}
    assert states == {7: "deleted", 8: "ready", 9: "ready"}
    jobs = spark.createDataFrame([(1, 0)], "job_id long, cancel_requested int")
    assert [x["item_seq"] for x in k.job_details(items, jobs).first()["item_list"]] == [1, 2]
