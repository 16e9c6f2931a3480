"""Reuse of prior work, registration of experiments, and reports."""

import pytest
from pyspark.sql import functions as F

from reelquery.operators import registration as r
from reelquery.operators import report
from reelquery.operators.evaluation import paired_audit

CACHE = (
    "clip_id string, source_video_id string, group_label int, split string, schema_version int, video_sha256 string, coordinates string, frame_indices array<int>, reference_frame int, checkpoint_sha256 string, "
    "filter_config string, boxes array<array<double>>, scores array<double>, person_labels array<int>, image_size array<int>, fingerprint string"
)


def test_only_fresh_caches_of_their_clips_are_used(spark):
    clips = spark.createDataFrame([("a", "s", 1, "train", "h1", 20), ("b", "s", 1, "train", "h2", 3), ("c", "s", 1, "train", "h3", 20)], "clip_id string, source_video_id string, group_label int, split string, sha256 string, num_frames int")
    rows = [
        ("a", "s", 1, "train", 1, "h1", "zero_based_clip_local", list(range(5, 15)), 10, "d", "f", [[0.0, 0.0, 1.5, 2.0]], [0.9], [1], [10, 20], None),
        ("b", "s", 1, "train", 1, "h2", "zero_based_clip_local", [0, 0, 0, 0, 0, 1, 2, 2, 2, 2], 1, "d", "f", [], [], [], [10, 20], None),
        ("z", "s", 1, "train", 1, "h3", "zero_based_clip_local", None, None, None, None, None, None, None, None, None),
    ]
    caches = spark.createDataFrame(rows, CACHE).withColumn("fingerprint", r.cache_fingerprint())
    listed = lambda df: {x["clip_id"]: x["codes"] for x in r.stale_caches(df, clips, "d", "f").collect()}
    assert listed(caches) == {"c": ["missing_cache"], "z": ["unknown_clip"]}  # empty detections of a short clip are fine
    assert listed(caches.withColumn("scores", F.transform("scores", lambda x: x / 2)))["a"] == ["changed:fingerprint"]
    assert listed(caches.withColumn("split", F.lit(None).cast("string")).withColumn("person_labels", F.lit(None).cast("array<int>")))["b"] == ["identity:split", "changed:person_labels", "changed:fingerprint"]
    assert listed(caches.union(caches.where("clip_id = 'a'")))["a"] == ["repeated_cache"]
    assert listed(caches.where("clip_id = ''")) == {x: ["missing_cache"] for x in "abc"}


def test_durations_are_compared_as_decimals(spark):
    table = lambda rows, columns: spark.createDataFrame(rows, columns)
    records = table([("a", "x", "h", "p", "h"), ("b", "x", "h", "p", None), ("c", None, "h", "p", "h")], "clip_id string, annotation string, sha256 string, path string, file_sha256 string")
    current = table([("a", "x", "1.50"), ("b", "x", "0.1"), ("c", None, "NaN")], "clip_id string, annotation string, duration string")
    catalog = table([("a", "h", "p", "1.5"), ("b", "h", "p", "0.1000000001"), ("c", "h", None, "NaN"), ("d", "h", "p", "1")], "clip_id string, sha256 string, path string, duration string")
    none = table([], "clip_id string")
    got = {x["clip_id"]: x["codes"] for x in r.reuse_violations(records, current, catalog, none).collect()}
    # digits beyond the ninth are rounded
    assert got == {"b": ["media_changed"], "c": ["catalog_changed", "duration_conflict"], "d": ["exclusion_added"]}
    assert r.reuse_violations(records.limit(0), current.limit(0), catalog.limit(0), none).count() == 0
    held = table([(0, True, "v", "0.1"), (0, True, "v", "0.2"), (1, True, None, "1e2"), (0, None, "v", "?")], "issues int, readable boolean, label string, duration string")
    assert {(x["state"], x["label"]): (x["clips"], str(x["seconds"])) for x in r.reuse_summary(held).collect()} == {("candidate", "v"): (2, "0.300000"), ("quarantine", "missing"): (1, "100.000000"), ("quarantine", "v"): (1, "0.000000")}


def test_pins_and_policies(spark):
    pins = spark.createDataFrame([(1, "a", "0" * 64), (1, "b", "0" * 64), (2, "a", "0" * 63), (2, "c", "0" * 64), (3, "a", None), (3, "b", "F" * 64), (3, "b", "F" * 64)], "run int, model string, sha256 string")
    assert sorted(tuple(x) for x in r.pin_violations(pins, ["a", "b"]).collect()) == [(2, "a", "invalid"), (2, "b", "missing"), (2, "c", "unknown"), (3, "a", "invalid"), (3, "b", "repeated")]
    selected = spark.createDataFrame([(1, "frame", "interpolate"), (2, None, None)], "run int, evaluation_mode string, frame_projection string")
    asked = spark.createDataFrame([(1, "frame", None), (1, "frame", "repeat"), (1, "bag", None), (2, "bag", "interpolate"), (3, "bag", None), (3, None, None)], "run int, mode string, projection string")
    assert {(x["run"], x["mode"], x["projection"]): x["changed"] for x in r.resolved_policies(selected, asked).collect()} == {
        (1, "frame", "interpolate"): False, (1, "frame", "repeat"): True, (1, "bag", "interpolate"): True, (2, "bag", "interpolate"): False, (3, "bag", "repeat"): False, (3, None, "repeat"): True,
    }


def test_an_experiment_is_registered_once(spark, tmp_path):
    folder, identity = f"{tmp_path}/pass", {"models": {"head": "h"}, "protocol": "p"}
    assert r.register(spark, folder, identity) == identity
    with pytest.raises(FileExistsError):
        r.register(spark, folder, identity)
    assert r.register(spark, folder, {"protocol": "p", "models": {"head": "h"}}, resume=True)["protocol"] == "p"
    with pytest.raises(ValueError, match="another identity"):
        r.register(spark, folder, {"protocol": "q"}, resume=True)
    r.complete(spark, folder, {"clips": 3})
    with pytest.raises(FileExistsError):
        r.register(spark, folder, identity, resume=True)
    with pytest.raises(FileExistsError):
        r.complete(spark, folder, {"clips": 3})


def test_a_report_is_written_in_order(spark, tmp_path):
    scenes = spark.createDataFrame([
        ("b|1", 0, 0, 0.9, 2, 1, 0.75, "ok", 2, [0.5]), ("a\nx", 1, 0, None, 1, None, None, "no_actors_detected", 0, None), ("c", 1, 0, 0.5, 1, 1, 0.25, "ok", 1, [0.5]),
    ], "clip_id string, truth int, gt_prediction int, gt_confidence double, gt_actors int, det_prediction int, det_confidence double, det_status string, det_actors int, ious array<double>")
    actors = spark.createDataFrame([("Detected", 1, 4, 0.5, None)], "side string, class int, support int, accuracy double, f1 double")
    lines = report.error_report(scenes, paired_audit(scenes), "Title", ["zero", "one"], actors)
    report.write_report(lines, f"{tmp_path}/report")
    text = [x["value"] for x in sorted(spark.read.text(f"{tmp_path}/report").selectExpr("value", "input_file_name() AS f", "monotonically_increasing_id() AS i").collect(), key=lambda x: (x["f"], x["i"]))]
    assert text[:6] == ["# Title", "", "Scenes: 3", "", "| Category | Scenes |", "| --- | ---: |"]
    assert "| b\\|1 | zero | zero | one | 0.5000 | GT_correct, GT_correct_detected_failed, detected_group_wrong |" in text
    assert "| a x | one | zero | unknown | unknown | GT_group_wrong, both_failed, no_actors_detected |" in text
    assert "| wrong | 1 | 0.5000 | 0.0000 | 1 |" in text and "| one | zero | 2 |" in text and text[-1] == "| one | 4 | 0.5000 | unknown |"
    empty = scenes.limit(0)
    assert report.error_report(empty, paired_audit(empty), "Title", ["zero"]).where("line = 'Scenes: 0'").count() == 1
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        report.write_report(lines, f"{tmp_path}/report")
