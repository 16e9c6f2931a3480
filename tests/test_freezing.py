"""Provisional groups, freezing a split once, feature bags, controlled choices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelquery.operators import evaluation, freezing, review, studies
from reelquery.sources import bags, manifests

RECORDS = "clip_id long, collection string, label string, issues array<string>, readable boolean, reserved boolean, sha256 string, guard_group string, family_hint string"


def record(i, label="violence", collection="a", sha=None, guard=None, hint="", issues=(), readable=True, reserved=False):
    return (i, collection, label, list(issues), readable, reserved, sha or f"h{i}", guard or f"g{i}", hint)


def test_provisional_groups_keep_links_and_reasons(spark):
    rows = [record(1, sha="x"), record(2, sha="x"), record(3, "non_violence", guard="g"), record(4, "non_violence", guard="g"), record(5, guard="g"), record(6, hint="f"), record(7, hint="f"), record(8, collection="b", hint="f")]
    rows += [record(9, issues=["bad"]), record(10, readable=False), record(11, reserved=True, sha="x"), record(12, "non_violence", "Snatch-1.0"), record(13)]
    records = spark.createDataFrame(rows, RECORDS)
    candidates = spark.createDataFrame([(7, 13), (13, 11)], "a long, b long")
    found = {r["clip_id"]: (r["group_id"], r["excluded"], r["reasons"]) for r in freezing.provisional_groups(records, candidates).collect()}
    assert {i: x[0] for i, x in found.items()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 6, 8: 8, 11: None, 12: None, 13: 6}
    assert found[7][2] == ["candidate", freezing.FAMILY] and found[5][2] == [] and found[11][1] == freezing.RESERVED and found[12][1] == freezing.UNRESOLVED
    for bad, message in (([record(1), record(1)], "repeated"), ([record(1, "maybe"), record(2)], "quarantine"), ([record(1)], "unknown")):
        with pytest.raises(ValueError, match=message):
            pairs = candidates.limit(0) if message != "unknown" else spark.createDataFrame([(1, 99)], "a long, b long")
            freezing.provisional_groups(spark.createDataFrame(bad, RECORDS), pairs).collect()


def test_development_split_screens_history(spark):
    rows = [record(i, "violence" if i % 2 else "non_violence") for i in range(40)] + [record(90, reserved=True)]
    records, none = spark.createDataFrame(rows, RECORDS), spark.createDataFrame([], "a long, b long")
    history = spark.createDataFrame([("other",)], "sha256 string")
    split = freezing.development_split(records, none, history, trials=20)
    counts = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert counts == {"train": 28, "val": 6, "test": 6, None: 1}
    table = {(r["collection"], r["split"]): (r["violence"], r["non_violence"]) for r in freezing.collection_table(split, ["a", "b"]).collect()}
    assert table["b", "val"] == (0, 0) and sum(sum(x) for x in table.values()) == 40
    with pytest.raises(ValueError, match="historical"):
        freezing.development_split(records, none, spark.createDataFrame([("h3",)], "sha256 string"), trials=5)


def inputs(spark, **changes):
    clips = [(i, f"h{i}", f"s{i // 2}", i // 2 % 2) for i in range(40)]
    own = {
        "clips": (clips, "clip_id long, sha256 string, source_video_id string, label int"),
        "exclusions": ([(38, "dark"), (39, "dark")], "clip_id long, reason string"),
        "reviews": ([(i, True, True, True, "seen") for i in range(38)], "clip_id long, annotation_approved boolean, provenance_approved boolean, benchmark_independent boolean, evidence string"),
        "candidates": ([(0, 4, "exact"), (9, 5, "near"), (1, 39, "near")], "a long, b long, kind string"),
        "decisions": ([(4, 0, "same_footage", "seen"), (5, 9, "independent", "seen")], "a long, b long, relation string, evidence string"),
        "historical": ([("s99", None), (None, "h99")], "source_video_id string, sha256 string"),
    }
    for name, rows in changes.items():
        own[name] = (rows(own[name][0]), own[name][1])
    return [spark.createDataFrame(rows, schema) for rows, schema in own.values()]


@pytest.mark.parametrize(("changes", "want"), [
    ({}, set()),
    ({"exclusions": lambda x: [*x, (77, "gone")]}, {("unknown_exclusion", "77")}),
    ({"exclusions": lambda x: [x[0], (39, " ")]}, {("exclusion_without_reason", "39")}),
    ({"reviews": lambda x: x[1:]}, {("unreviewed", "0")}),
    ({"reviews": lambda x: [*x, (38, True, True, True, "seen")]}, {("foreign_review", "38")}),
    ({"reviews": lambda x: [(0, True, None, True, "seen"), (1, True, True, True, ""), *x[2:]]}, {("unresolved_review", "0"), ("unresolved_review", "1")}),
    ({"historical": lambda x: [("s3", None), (None, "h0")]}, {("historical_source", "6"), ("historical_source", "7"), ("historical_content", "0")}),
    ({"clips": lambda x: [(0, "h2", "s0", 0), *x[1:]]}, {("conflicting_labels", "h2")}),
    ({"decisions": lambda x: [x[0], (5, 9, "unsure", "seen")]}, {("invalid_decision", "5~9")}),
    ({"decisions": lambda x: [*x, (9, 5, "independent", "seen"), (1, 39, "independent", "seen")]}, {("invalid_decision", "5~9"), ("invalid_decision", "1~39")}),
    ({"decisions": lambda x: [(4, 0, "independent", "seen"), x[1]]}, {("exact_declared_independent", "0~4")}),
    ({"decisions": lambda x: x[:1]}, {("undecided_candidate", "5~9")}),
])
def test_what_forbids_freezing(spark, changes, want):
    assert set(map(tuple, freezing.freeze_violations(*inputs(spark, **changes)).collect())) == want


def test_a_split_is_frozen_once(spark, tmp_path):
    folder = str(tmp_path / "frozen")
    with pytest.raises(ValueError, match="undecided"):
        freezing.freeze(spark, folder, *inputs(spark, decisions=lambda x: x[:1]), trials=20)
    receipt = freezing.freeze(spark, folder, *inputs(spark), trials=20)
    assert sum(receipt["clip_counts"].values()) == 38
    rows = {r["clip_id"]: r for r in freezing.verify(spark, folder).collect()}
    assert rows[0]["split"] == rows[4]["split"] == rows[5]["split"] and rows[0]["group_id"] == 0
    assert all(rows[i]["split"] == rows[i + 1]["split"] for i in range(0, 38, 2))
    with pytest.raises(FileExistsError):
        freezing.freeze(spark, folder, *inputs(spark), trials=20)
    spark.createDataFrame([tuple(rows[0])], freezing.verify(spark, folder).schema).write.mode("append").parquet(f"{folder}/{receipt['manifest']}")
    with pytest.raises(ValueError, match="changed"):
        freezing.verify(spark, folder)


def test_bags_round_trip_and_broken_ones_are_reported(spark, tmp_path):
    rng = np.random.default_rng(0)
    good = {f"clip{i}": rng.random((4, 3), np.float32) for i in range(5)}
    for name, bag in good.items():
        np.save(tmp_path / f"{name}.npy", bag)
    np.savetxt(tmp_path / "text.txt", good["clip0"])
    np.save(tmp_path / "wide.npy", np.zeros((4, 5)))
    np.save(tmp_path / "infinite.npy", np.full((4, 3), np.inf))
    np.save(tmp_path / "pickled.npy", np.array([{"a": 1}], object), allow_pickle=True)
    (tmp_path / "word.txt").write_text("a b c\n" * 4)
    (tmp_path / "empty.npy").write_bytes(b"")
    (tmp_path / "other.pt").write_bytes(b"x")
    df = bags.read_bags(spark, str(tmp_path), 4, 3)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in df.collect()}
    assert len(rows) == 10 and {n for n, r in rows.items() if r["error"]} == {"wide.npy", "infinite.npy", "pickled.npy", "word.txt"}
    for name, bag in good.items():
        assert np.array_equal(np.array(rows[f"{name}.npy"]["vectors"], np.float32), bag)
    assert np.allclose(rows["text.txt"]["vectors"], good["clip0"]) and "expected finite [4,3], got [4, 5]" in rows["wide.npy"]["error"]
    at = {n: r["path"] for n, r in rows.items()}
    records = [("a", at["clip0.npy"], rows["clip0.npy"]["sha256"]), ("b", at["clip1.npy"], "old"), ("c", at["wide.npy"], None), ("d", "file:/none.npy", None)]
    found = bags.registered_bags(spark.createDataFrame(records, "video_id string, feature_path string, feature_sha256 string"), df)
    assert dict(map(tuple, found.collect())) == {"a": "ready", "b": "changed", "c": "broken", "d": "missing"}


def test_a_controlled_choice_keeps_the_baseline_on_ties(spark):
    make = lambda *runs: spark.createDataFrame([(init, {"initialization": init, "steps": steps}, f1) for init, steps, f1 in runs], "initialization string, config map<string,string>, macro_f1 double")
    pick = lambda df: studies.controlled_choice(df, "initialization", "transfer", "macro_f1").first()["initialization"]
    assert pick(make(("random", "9", 0.5), ("transfer", "9", 0.5))) == "transfer"
    assert pick(make(("random", "9", 0.6), ("transfer", "9", 0.5))) == "random"
    for bad in (make(("random", "8", 0.6), ("transfer", "9", 0.5)), make(("random", "9", 0.6), ("random", "9", 0.5)), make(("random", "9", 0.6), ("other", "9", 0.5))):
        with pytest.raises(ValueError, match="controlled"):
            pick(bad)


def test_repeated_records_are_no_queue(spark):
    rows = [(1, "a", "violence", [], True, False, False, "x")] * 2
    records = spark.createDataFrame(rows, "clip_id long, collection string, normalized_label string, issues array<string>, readable boolean, conflict boolean, reserved boolean, reviewed_at string")
    with pytest.raises(ValueError, match="several records"):
        review.review_queue(records, spark.createDataFrame([], "a long, b long"))


def test_every_missed_positive_has_its_turn(spark):
    rows = [(i, 1, i % 5 / 10) for i in range(30)] + [(100 + i, 0, i / 10) for i in range(4)] + [(200, 1, 0.9)]
    found = review.ranked_examples(spark.createDataFrame(rows, "clip_id long, label int, score double"), 0.8, each=3)
    by = {role: [r["clip_id"] for r in found.where(F.col("role") == role).orderBy("turn").collect()] for role in ("correct", "failure")}
    assert by["correct"] == [200, 100, 101]
    assert by["failure"] == [i for i, _, _ in sorted(rows[:30], key=lambda r: (-r[2], r[0]))]


def test_files_are_discovered_and_mapped(spark, tmp_path):
    root = tmp_path / "clips"
    for name in ("a/one.mp4", "a/two.MKV", "b.mov", "b.txt", "a/three.mp4.part"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x" * 3)
    files = manifests.discover(spark, str(root))
    assert sorted(map(tuple, files.collect())) == [("a/one.mp4", 3), ("a/two.MKV", 3), ("b.mov", 3)]
    text = lambda x: spark.createDataFrame([(x,)], "value string")
    mapping = manifests.source_map(text('{"a/one.mp4": "cam 1", "other.mp4": "cam 2"}'))
    assert dict(map(tuple, manifests.mapped_sources(files, mapping).collect())) == {"a/one.mp4": "cam 1", "a/two.MKV": "a/two", "b.mov": "b"}
    for bad in ('["a"]', '{"a": 1}', '{"a": ""}', "no json"):
        with pytest.raises(manifests.ManifestError):
            manifests.source_map(text(bad)).collect()
    for missing in (str(tmp_path / "none"), str(tmp_path)):
        with pytest.raises(manifests.ManifestError):
            manifests.discover(spark, missing, (".none",))


def test_validation_must_be_of_both_models(spark):
    rows = spark.createDataFrame([(1, "s1", "h1", "val", True), (2, "s2", "h2", "train", True), (3, "s3", "h1", "test", False)], "clip_id long, source_video_id string, sha256 string, split string, selected boolean")
    own = spark.createDataFrame([("s1", "val"), ("s2", "train")], "source_video_id string, assigned string")
    assert [r["clip_id"] for r in evaluation.eligible_validation(rows, own, own).collect()] == [1]
    with pytest.raises(ValueError, match="not_validation_of_both"):
        evaluation.eligible_validation(rows, own, own.where("assigned = 'train'"))
    with pytest.raises(ValueError, match="source_moved"):
        evaluation.eligible_validation(rows, own.where("assigned = 'val'"), own)
    with pytest.raises(ValueError, match="content_crosses"):
        evaluation.eligible_validation(rows.withColumn("selected", F.lit(True)), own, own)
    with pytest.raises(ValueError, match="no validation clips"):
        evaluation.eligible_validation(rows.where("clip_id = 2"), own, own)


def test_categories_of_a_paired_audit(spark):
    schema = "clip_id long, truth int, gt_prediction int, gt_confidence double, gt_actors int, det_prediction int, det_confidence double, det_status string, det_actors int, ious array<double>"
    rows = [(1, 0, 0, 0.9, 4, 1, 0.9, "ok", 4, [0.6]), (2, 0, 1, 0.9, 2, None, None, "no_actors_detected", 0, []), (3, 0, None, None, 0, 0, 0.1, "ok", 1, []), (4, 0, 0, 0.5, 1, 0, 0.5, "ok", 1, None)]
    found = {r["clip_id"]: r for r in evaluation.paired_audit(spark.createDataFrame(rows, schema)).collect()}
    assert found[1]["categories"] == ["GT_correct", "GT_correct_detected_failed", "detected_group_wrong", "detected_high_confidence_wrong", "low_coverage"] and found[1]["mean_iou"] == 0.6
    assert found[2]["categories"] == ["GT_group_wrong", "GT_high_confidence_wrong", "both_failed", "no_actors_detected", "low_coverage"]
    assert (found[3]["categories"], found[3]["coverage"]) == (["GT_group_wrong", "detected_correct"], None)
    assert (found[4]["categories"], found[4]["coverage"], found[4]["mean_iou"]) == (["GT_correct", "detected_correct"], None, None)
    for bad in ([rows[0], rows[0]], [(5, 0, 0, 0.5, 1, 0, 0.5, "no_actors_detected", 0, [])]):
        with pytest.raises(ValueError):
            evaluation.paired_audit(spark.createDataFrame(bad, schema))
