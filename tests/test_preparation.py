"""Preparation of whole data sets: what becomes a record, what raises, and audits on odd tables."""

import pytest

from reelquery.operators import preparation as p
from reelquery.sources.manifests import ManifestError

BOX = "sequence int, line int, frame int, x int, y int, w int, h int, action int"


def found(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_folders_name_categories_and_recordings(spark):
    files = spark.createDataFrame([("Abuse/Abuse001_x264.mp4",), ("x/NORMAL/My.Clip003_x264_12.avi",), ("normal_videos_event/a.mp4",), ("Abuse/odd.mp4",), ("top.mp4",), ("x/Abuse/normal/b1_x264.mp4",), ("Abuse/.hidden",)], "name string")
    mapping = spark.createDataFrame([("Abuse/odd.mp4", "SRC-9")], "name string, source string")
    got = found(p.folder_records(files, mapping), "name", "video_id", "source", "category", "label", "code")
    assert got == sorted([
        ("Abuse/Abuse001_x264.mp4", "Abuse/Abuse001_x264", "abuse001", "Abuse", 1, None), ("x/NORMAL/My.Clip003_x264_12.avi", "x/NORMAL/My.Clip003_x264_12", "my.clip003", "NORMAL", 0, None),
        ("Abuse/odd.mp4", "Abuse/odd", "src-9", "Abuse", 1, None), ("top.mp4", "top", None, None, None, "unknown_category"), ("x/Abuse/normal/b1_x264.mp4", "x/Abuse/normal/b1_x264", "b1", "Abuse", 1, None),
        ("Abuse/.hidden", "Abuse/.hidden", None, "Abuse", 1, "unknown_source"),
    ])
    with pytest.raises(ManifestError, match="unknown_category"):
        p.prepared(p.folder_records(files, mapping))
    assert p.prepared(p.folder_records(files.where("name LIKE '%001%'"))).columns == ["name", "video_id", "source", "category", "label"]


def test_labels_and_files_are_complete_both_ways(spark):
    files = spark.createDataFrame([("A/a1_x264.mp4",), ("A/b.mp4",), ("B/c2_x264.mp4",), ("B/d3_x264.mp4",), ("B/e.mp4",)], "name string")
    labels = spark.createDataFrame([("A/a1_x264.mp4", 1, None, None), ("A/b.mp4", 0, "Kind", "REC"), ("B/c2_x264.mp4", 3, "", ""), ("B/d3_x264.mp4", 1, " ", None), ("B/d3_x264.mp4", 1, " ", None), ("gone.mp4", 1, "x", "y")], "name string, label int, category string, source string")
    records = p.labelled_records(files, labels)
    assert found(records, "name", "source", "category", "label", "code") == [
        ("A/a1_x264.mp4", "a1", "A", 1, None), ("A/b.mp4", "rec", "Kind", 0, None), ("B/c2_x264.mp4", "c2", "B", 3, "unknown_label"), ("B/d3_x264.mp4", "d3", "B", 1, "repeated_label"),
        ("B/e.mp4", None, "B", None, "missing_label"), ("gone.mp4", "y", "x", 1, "missing_file"),
    ]
    with pytest.raises(ManifestError, match="can't be prepared"):
        p.prepared(records)


def sequence(spark, boxes, frames=12, splits=((1, "train"),)):
    files = spark.createDataFrame([(1, f) for f in range(1, frames + 1)], "sequence int, frame int")
    return files, spark.createDataFrame(boxes, BOX), spark.createDataFrame(list(splits), "sequence int, split string")


def test_scenes_have_labels_votes_and_frames_within_the_sequence(spark):
    boxes = [(1, 1, 1, 0, 0, 10, 10, 3), (1, 2, 1, 5, 5, 10, 10, 6), (1, 3, 1, 30, 0, 10, 10, 1), (1, 4, 2, 0, 0, 10, 10, 5), (1, 5, 11, -5, 0, 10, 10, 2), (1, 6, 11, 50, 50, 10, 10, 2), (2, 1, 1, 0, 0, 5, 5, 2)]
    given = sequence(spark, boxes)
    rows = {r["frame"]: r for r in p.prepare_sequences(*given, 100, 100, strict=False).collect()}
    assert sorted(rows) == [1, 11]
    assert rows[1]["group_label"] == 1 and [a["label"] for a in rows[1]["actors"]] == [1, 4]  # a tie goes to the smaller label
    assert rows[1]["frame_indices"] == [1, 1, 1, 1, 1, 1, 2, 3, 4, 5] and rows[11]["frame_indices"] == [6, 7, 8, 9, 10, 11, 12, 12, 12, 12]
    assert rows[11]["clip_id"] == "1:0011" and rows[11]["actors"][0]["x1"] == 0.0 and rows[11]["actors"][0]["x2"] == 0.05
    with pytest.raises(ManifestError, match="outside_image"):
        p.prepare_sequences(*given, 100, 100)
    assert found(p.box_corrections(given[1], 100, 100), "line", "x", "left", "right", "selected") == [(5, -5, 0, 5, True)]
    counts = {(r["split"], r["kind"], r["value"]): r["n"] for r in p.scene_counts(p.sequence_scenes(*given, 100, 100)).collect()}
    assert len(counts) == 39 and counts["train", "scenes", ""] == 2 and counts["train", "actors", ""] == 4 and counts["train", "actor_class", "crossing"] == 2
    assert counts["val", "scenes", ""] == 0 and counts["train", "group_class", "waiting"] == 1


@pytest.mark.parametrize(("boxes", "change", "code"), [
    ([(1, 1, 1, 0, 0, 5, 5, 2)], lambda f, s: (f.where("frame <> 4"), s), (None, "missing_frames")),
    ([(1, 1, 1, 0, 0, 5, 5, 2)], lambda f, s: (f.where("frame > 1"), s), (None, "missing_frames")),
    ([(1, 1, 1, 0, 0, 5, 5, 2)], lambda f, s: (f.union(f.where("frame = 3")), s), (None, "repeated_frame")),
    ([(1, 1, 1, 0, 0, 5, 5, 2)], lambda f, s: (f.where("frame < 0"), s), (None, "no_frames")),
    ([(1, 1, 1, 0, 0, 5, 5, 2)], lambda f, s: (f, s.union(s.selectExpr("sequence", "'test'"))), (None, "crosses_splits")),
    ([(1, 1, 1, 0, 0, 5, 5, 2)], lambda f, s: (f, s.union(s)), (None, "repeated_sequence")),
    ([(1, 1, 2, 0, 0, 5, 5, 2)], lambda f, s: (f, s), (None, "no_scenes")),
    ([], lambda f, s: (f, s), (None, "no_scenes")),
    ([(1, 1, 21, 0, 0, 5, 5, 2)], lambda f, s: (f, s), (None, "center_beyond_frames")),
    ([(1, 1, 1, 0, 0, 5, 5, 1)], lambda f, s: (f, s), (1, "no_actors")),
    ([(1, 1, 1, 0, 0, 5, 5, 7)], lambda f, s: (f, s), (1, "unknown_action")),
    ([(1, 1, 1, 0, 0, 5, 0, 2)], lambda f, s: (f, s), (1, "empty_box")),
    ([(1, 1, 1, 200, 0, 5, 5, 2)], lambda f, s: (f, s), (1, "invisible_box")),
    ([(1, 1, 1, 98, 0, 5, 5, 2)], lambda f, s: (f, s), (1, "outside_image")),
    ([(1, 1, 1, 0, 0, 5, 5, 2), (1, 2, 1, 0, 0, 5, 5, 3)], lambda f, s: (f, s), (1, "duplicate_box")),
    ([(1, 1, 1, 0, 0, 5, 5, 2), (1, 2, 0, 0, 0, 5, 5, 3)], lambda f, s: (f, s), (0, "invalid_frame")),
    ([(1, 1, 1, 0, 0, 5, 5, 2), (1, 2, 2, None, 0, 5, 5, 3)], lambda f, s: (f, s), (2, "broken_line")),
])
def test_each_broken_rule_is_listed(spark, boxes, change, code):
    files, lines, splits = sequence(spark, boxes)
    files, splits = change(files, splits)
    assert code in found(p.sequence_violations(files, lines, splits, 100, 100), "frame", "code")
    with pytest.raises(ManifestError, match=code[1]):
        p.prepare_sequences(files, lines, splits, 100, 100)


def test_audit_of_clips(spark):
    clips = spark.createDataFrame([
        ("Abuse/Abuse1_x264/Abuse1_x264_0.mp4", "h1", True), ("Abuse/Abuse1_x264/Abuse1_x264_1.mp4", "h1", None), ("Arson/Arson2_x264/Arson2_x264_0.mp4", "h2", True), ("Normal/Normal3_x264/Other4_x264_0.mp4", "h3", True),
        ("Normal/Normal3_x264/Normal3_x264_0.mp4", "h4", True), ("Abuse/Abuse5_x264/Abuse5_x264_0.mp4", "h5", True), ("Dance/Dance6_x264/Dance6_x264_0.mp4", "h6", True),
    ], "name string, sha256 string, readable boolean").selectExpr("*", "320 AS width", "240 AS height", "'25' AS fps")
    labels = spark.createDataFrame([("Abuse1_x264_0", "Abuse", 1), ("Abuse1_x264_1", "Abuse", 0), ("Arson2_x264_0", "Arson", 1), ("Normal3_x264_0", "Normal", 1), ("Abuse5_x264_0", "Assault", 1), ("Dance6_x264_0", "Dance", 0), ("Lost", "Abuse", 1)], "clip_id string, category string, label int")
    audited = p.clip_audit(clips, labels)
    got = {r["clip_id"]: (r["group_label"], r["reason"], r["code"]) for r in audited.collect()}
    assert got == {
        "Abuse1_x264_0": (1, None, None), "Abuse1_x264_1": (0, "unreadable_video", None), "Arson2_x264_0": (None, "excluded_category", None), "Other4_x264_0": (None, "missing_or_invalid_annotation", "source_disagreement"),
        "Normal3_x264_0": (None, "excluded_category", "abnormal_normal"), "Abuse5_x264_0": (1, None, "category_disagreement"), "Dance6_x264_0": (None, "excluded_category", "unknown_category"),
    }
    assert found(p.labels_without_clips(clips, labels), "clip_id") == [("Lost",)]
    counts = {(r["kind"], r["value"]): r["n"] for r in p.audit_counts(audited).collect()}
    assert counts["total", ""] == 7 and counts["readable", "no"] == 1 and counts["selected_class", "Abuse"] == 2 and counts["exclusion", "excluded_category"] == 3 and counts["resolution", "320x240"] == 6
    assert p.audit_counts(audited.where("name = ''")).collect()[0]["n"] == 0  # no clips: no sources, and nothing else
