"""Sources, sinks, names, receipts and whole-output evaluation over the fixture views. What is written goes to the shared folder,
is read back, and is deleted."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelquery.functions.lineage import checkpoint, checkpoint_dir, remove
from reelquery.operators import catalog as k
from reelquery.operators import evaluation as e
from reelquery.operators import geometry as g
from reelquery.operators import ingest as i
from reelquery.operators import integrity as n
from reelquery.operators import studies as u
from reelquery.plans.graph_queries import ASSESS, assessed
from reelquery.plans.interval_queries import EVENTS, arrays, events_of
from reelquery.plans.metric_queries import COUNTS, RATES
from reelquery.plans.views import oracle, view
from reelquery.sources import detections as d
from reelquery.sources import manifests as m


def through(spark, write: Callable[[str], None], read: Callable[[str], DataFrame]) -> DataFrame:
    """What read() gives after write(), both on a new folder that is deleted afterwards."""
    folder = f"{checkpoint_dir(spark)}/through-{uuid.uuid4().hex}"
    try:
        write(folder)
        return checkpoint(read(folder))
    finally:
        remove(spark, folder)


def manifest(s, sf):
    clips = view(s, sf, "v_clips").where("source_video_id IS NOT NULL AND duration > 1")
    text = F.col("clip_id").cast("string")
    marks = F.when(F.col("clip_id") % 3 == 0, F.array(F.array(F.lit(0.0), F.col("duration") / 2))).when(F.col("clip_id") % 3 == 1, F.array().cast("array<array<double>>"))
    return clips.select(
        F.lit("clips").alias("dataset"), text.alias("video_id"), "source_video_id", F.concat(F.lit("v/"), text, F.lit(".mp4")).alias("path"), "split", (F.col("clip_id") % 2).cast("int").alias("label"),
        F.lit(None).cast("string").alias("anomaly_type"), F.col("duration").alias("duration_sec"), F.lit(25.0).alias("fps"), F.floor(F.col("duration") * 25).alias("num_frames"), marks.alias("temporal_annotations"),
        F.lit(None).cast("string").alias("feature_path"), F.lit(None).cast("string").alias("feature_sha256"),
    )


def manifest_round_trip(s, sf):
    rows = through(s, lambda f: m.write_manifest(manifest(s, sf), f), lambda f: m.read_manifest(s, f))
    return rows.select("video_id", "source_video_id", "path", "split", "label", "duration_sec", "num_frames", F.when(F.col("temporal_annotations").isNotNull(), F.size("temporal_annotations")).alias("intervals"))


def manifest_violations(s, sf):
    at = F.col("video_id").cast("long")
    rows = manifest(s, sf).withColumn("split", F.when(at % 17 == 0, "holdout").otherwise(F.col("split"))).withColumn("label", F.when(at % 19 == 0, 2).otherwise(F.col("label")))
    rows = rows.withColumn("temporal_annotations", F.when(at % 23 == 0, F.array(F.array(F.lit(1.0), F.lit(0.5)))).otherwise(F.col("temporal_annotations"))).withColumn("fps", F.when(at % 31 == 0, F.lit(0.0)).otherwise(F.col("fps")))
    return m.record_violations(rows.unionByName(rows.where(at % 29 == 0))).select("video_id", "code")


def detections(s, sf):
    boxes = view(s, sf, "v_boxes")
    own = F.struct(F.array("x1", "y1", "x2", "y2").alias("box"), F.least(F.col("score"), F.lit(1.0)).alias("score"), (F.col("box_id") % 3).cast("long").alias("class_id"))
    rows = boxes.groupBy(F.col("scene_id").cast("string").alias("clip_id")).agg(F.collect_list(F.when(F.col("side") == "det", own)).alias("detections"))
    return rows.select(F.lit(1).alias("version"), F.lit(d.COORDINATES).alias("coordinates"), F.lit("boxes").alias("dataset"), "clip_id", F.array(F.lit(90), F.lit(90)).alias("image_size"), "detections", F.create_map(F.lit("from"), F.lit("v_boxes")).alias("metadata"))


def detections_round_trip(s, sf):
    rows = through(s, lambda f: d.write_detections(detections(s, sf), f), lambda f: d.read_detections(s, f))
    rows = rows.select("clip_id", F.posexplode_outer("detections").alias("rank", "_d"))
    return rows.select("clip_id", "rank", F.col("_d.box")[0].alias("x1"), F.col("_d.box")[1].alias("y1"), F.col("_d.box")[3].alias("y2"), F.col("_d.score").alias("score"))


def csv_round_trip(s, sf):
    rows = view(s, sf, "v_scored").withColumn("note", F.concat(F.lit('say "'), F.col("collection"), F.lit('",\nthen go')))
    back = through(s, lambda f: m.write_csv(rows.withColumn("note", F.col("note")), f, ["clip_id", "collection", "score", "note"]), lambda f: m.read_csv(s, f)[0])
    return back.select(F.col("clip_id").cast("long").alias("clip_id"), "collection", F.col("score").cast("double").alias("score"), "note")


def labels_of(s, sf):
    text = F.when(F.col("clip_id") % 11 == 0, "7").otherwise((F.col("clip_id") % 2).cast("string"))
    return view(s, sf, "v_clips").select(F.concat(F.lit("c"), (F.col("clip_id") % 97).cast("string")).alias("clip"), F.when(F.col("clip_id") % 97 < 40, "x").otherwise(F.col("collection")).alias("category"), text.alias("label"))


def settled_labels(s, sf):
    good, bad = m.settle_labels(labels_of(s, sf))
    return good.select("clip", "category", F.col("label").cast("string").alias("label"), F.lit("settled").alias("reason")).unionByName(bad)


def inventories(s, sf):
    clips = view(s, sf, "v_clips").select(F.concat(F.lit("/v/"), F.col("clip_id").cast("string")).alias("path"), "clip_id", F.floor("duration").alias("size"), F.lit("2024-01-01").cast("timestamp").alias("modified"))
    after = clips.where("clip_id % 7 <> 3").withColumn("size", F.when(F.col("clip_id") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return m.inventory_changes(clips.where("clip_id % 11 <> 4"), after)


def official(s, sf):
    clips = view(s, sf, "v_clips").select(F.col("clip_id").alias("name"), "collection", F.lit("?").alias("split"))
    return m.official_splits(clips, clips.where("name % 4 <> 1").select("name"), clips.where("name % 4 = 1").select("name")).select("name", "collection", "split")


def frame_lines(s, sf):
    videos = view(s, sf, "v_clips").where("duration > 2").select(F.col("clip_id").cast("string").alias("video_id"), F.concat(F.lit("clip"), F.col("clip_id").cast("string"), F.lit(".mp4")).alias("file"), F.lit(25.0).alias("fps"), F.floor(F.col("duration") * 25).alias("num_frames"))
    frames = F.col("num_frames")
    pairs = F.when(F.col("video_id").cast("long") % 3 == 0, F.lit("-1 -1 -1 -1")).otherwise(F.concat(F.lit("3 20 "), frames - 9, F.lit(" "), frames + 2))
    return m.frame_annotations(videos.select(F.concat(F.lit("Clip"), F.substring("file", 5, 99), F.lit("  Kind  "), pairs).alias("value")), videos, 2)


def scene_rows(s, sf):
    boxes = view(s, sf, "v_boxes")
    return boxes.select(F.expr("scene_id div 10").alias("sequence"), F.expr("scene_id % 10 * 5 + 1").alias("frame"), F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), F.expr("CAST(box_id % 3 AS INT)").alias("action"))


def scene_manifest(s, sf):
    rows = m.scenes(scene_rows(s, sf), 90, 90)
    return rows.select("sequence", "frame", "group_label", F.size("actors").alias("n_actors"), F.aggregate("actors", F.lit(0.0), lambda a, x: a + x["x2"] - x["x1"]).alias("widths"))


def scene_rules(s, sf):
    rows = m.scenes(scene_rows(s, sf), 90, 90).select(
        F.concat(F.lit("s"), F.col("sequence").cast("string")).alias("source_id"), F.concat(F.lit("v"), F.expr("sequence div 2").cast("string")).alias("video_id"), F.expr("CASE WHEN sequence % 9 = 0 THEN 1 ELSE frame END").alias("center_frame"),
        F.expr("CASE WHEN sequence % 5 = 0 THEN 'val' WHEN sequence % 7 = 0 AND frame > 20 THEN 'test' ELSE 'train' END").alias("split"), F.array(F.concat(F.lit("p"), F.expr("CAST(sequence div 4 AS STRING)"))).alias("frame_paths"), "actors",
    )
    return d.scene_violations(rows).select("code", "key")


def bag_rules(s, sf):
    rows = view(s, sf, "v_segments").where("seg < 6").groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("seg", "score"))).alias("own"))
    vector = lambda x: F.array(x["score"], F.when(F.expr("video_id % 5 = 0"), F.lit(float("nan"))).otherwise(F.lit(1.0)))
    return d.bag_violations(rows.select("video_id", F.transform(F.slice("own", 1, F.expr("CAST(CASE WHEN video_id % 7 = 0 THEN 2 ELSE 4 END AS INT)")), vector).alias("bag")), "bag", 4, 2)


NAMES = """SELECT clip_id, concat('Ab', CASE clip_id % 3 WHEN 0 THEN 'use' ELSE 'X' END, lpad(CAST(clip_id % 100 AS VARCHAR(9)), 3, '0'), CASE clip_id % 4 WHEN 0 THEN '_x264' WHEN 1 THEN '_X264_part' WHEN 2 THEN '_x264-1' ELSE '' END) AS video,
    concat('v ', CAST(clip_id % 50 AS VARCHAR(9)), '__#', CAST(clip_id AS VARCHAR(9)), '_label_', CASE clip_id % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B1-0-0' WHEN 2 THEN 'B1-G-0' WHEN 3 THEN 'B4-B5-0' WHEN 4 THEN 'A-B2-0' ELSE 'B5' END) AS clip,
    CASE clip_id % 7 WHEN 0 THEN '' WHEN 1 THEN '../x' WHEN 2 THEN '/a' WHEN 3 THEN 'a/../b' WHEN 4 THEN 'C:x' WHEN 5 THEN 'a..b/c' ELSE concat('p/', CAST(clip_id AS VARCHAR(9))) END AS path,
    CASE clip_id % 2 WHEN 0 THEN 'WalkIndia-50' ELSE 'Other-1' END AS dataset, CASE clip_id % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'no' END AS verified, CASE clip_id % 5 WHEN 0 THEN 'x-tour-2' WHEN 1 THEN 'none' END AS tour,
    CASE clip_id % 4 WHEN 0 THEN concat('delhi-Scene-', CAST(clip_id % 9 AS VARCHAR(9)), '-a') WHEN 1 THEN 'krishna-clip-7' ELSE 'walk' END AS stem,
    CASE clip_id % 3 WHEN 0 THEN concat('cam_202402', lpad(CAST(clip_id % 40 AS VARCHAR(9)), 2, '0'), '_0102', lpad(CAST(clip_id % 60 AS VARCHAR(9)), 2, '0')) ELSE 'cam' END AS stamp FROM v_clips"""


def names(s, sf):
    return s.sql(NAMES.replace("v_clips", "{clips}"), clips=view(s, sf, "v_clips"))


def intervals_valid(s, sf):
    pair = lambda a, b: F.struct(F.lit(a).alias("start"), b.alias("end"))
    rows = view(s, sf, "v_clips").select("clip_id", F.array(pair(0.0, F.col("duration") - F.col("clip_id") % 2), pair(1.0, F.lit(2.0))).alias("own"), "duration")
    return rows.select("clip_id", i.valid_intervals(F.col("own"), F.col("duration"), 2).alias("valid"))


def second_opinion(s, sf):
    return view(s, sf, "v_multiclass").where("clip_id % 8 <> 5").select("clip_id", "truth", F.expr("CASE WHEN clip_id % 10 = 0 THEN NULL WHEN clip_id % 4 = 0 THEN truth ELSE prediction END").alias("prediction"))


def group_scenes(s, sf):
    actor = lambda a, b, c: F.struct(F.expr(a).alias("truth"), F.expr(b).alias("prediction"), F.expr(c).alias("valid"))
    rows = view(s, sf, "v_multiclass")
    return rows.select("truth", "prediction", F.array(actor("truth", "prediction", "clip_id % 3 <> 0"), actor("CASE WHEN clip_id % 5 = 0 THEN -100 ELSE 1 END", "CAST(clip_id % 3 AS INT)", "TRUE")).alias("actors"))


def frames_evaluated(s, sf):
    return e.evaluate_frames(arrays(s, sf).withColumn("fps", F.lit(2.0)), events_of(s, sf))


def frozen_and_now(s, sf):
    old = view(s, sf, "v_clips").select(F.col("clip_id").cast("string").alias("video_id"), "source_video_id", "split", "sha256")
    at = F.col("video_id").cast("long")
    new = old.where(at % 13 != 0).withColumn("split", F.when(at % 37 == 1, "moved").otherwise(F.col("split"))).withColumn("sha256", F.when(at % 11 == 2, "new").otherwise(F.col("sha256")))
    return old.where(at % 17 != 5), new


def artifacts(df):
    return df.select(F.col("video_id").alias("name"), "sha256")


def merged(s, sf):
    old, new = frozen_and_now(s, sf)
    return e.merge_splits({"old": old, "new": new}).select("dataset", "video_id", "source_video_id", "split")


def historical(s, sf):
    clips = view(s, sf, "v_clips")
    sources, digests = e.historical_inventory([clips.where("collection = 'en'"), clips.where("clip_id % 5 = 0").withColumn("sha256", F.when(F.col("clip_id") % 2 == 0, F.col("sha256")))])
    return sources.select(F.lit("source").alias("kind"), F.col("source_video_id").alias("value")).unionByName(digests.select(F.lit("digest").alias("kind"), F.col("sha256").alias("value")))


def held(s, sf):
    rows = view(s, sf, "v_clips").select("clip_id", "source_video_id", "split", (F.col("clip_id") % 2 == 0).alias("selected"))
    other = view(s, sf, "v_clips").select("source_video_id").distinct().where("source_video_id < 'src5'").withColumn("assignment", F.expr("CASE WHEN source_video_id < 'src1' THEN 'train' WHEN source_video_id < 'src2' THEN 'excluded' ELSE 'test' END"))
    return e.held_out(rows, other).select("clip_id", "source_video_id")


def reviews_appended(s, sf):
    items = view(s, sf, "v_items")
    existing = items.where("item_seq = 1").select("job_id", "item_seq", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"), F.lit("ok").alias("decision")).where("job_id % 2 = 0 OR seq = 1")
    proposals = items.select("job_id", "item_seq", F.explode(F.array(F.lit("accept"), F.lit("reject"))).alias("decision")).where("job_id % 3 = 0 OR decision = 'accept'")
    return k.new_reviews(existing, proposals, items)


def revisions(s, sf):
    rows = s.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("session"), F.col("event_id").alias("revision"), F.col("event_type").alias("result"))
    return k.current_revisions(rows)


def uploads_deleted(s, sf):
    uploads = view(s, sf, "v_items").select("clip_id").distinct().select("clip_id", (F.col("clip_id") % 3 != 0).alias("owned"), F.lit("ready").alias("status"))
    return k.delete_uploads(uploads, uploads.where("clip_id % 2 = 0").select("clip_id"), view(s, sf, "v_items").where("item_seq < 3")).select("clip_id", "owned", "status")


def details(s, sf):
    rows = k.job_details(view(s, sf, "v_items"), view(s, sf, "v_jobs"))
    return rows.select("job_id", "state", "progress", F.array_join(F.transform("item_list", lambda x: F.concat(x["item_seq"].cast("string"), F.lit(":"), x["status"])), ",").alias("item_list"))


def backup(s, sf):
    tables = {x: view(s, sf, x) for x in ("v_jobs", "v_truth")}

    def read(folder):
        return s.read.parquet(f"{folder}/v_jobs").select(F.lit("jobs").alias("name"), F.col("job_id").alias("id")).unionByName(s.read.parquet(f"{folder}/v_truth").select(F.lit("truth").alias("name"), F.col("video_id").alias("id")))

    return through(s, lambda f: k.snapshot(tables, f), read)


def report(s, sf):
    rows = u.learning_curve(view(s, sf, "v_scored").withColumn("fraction", F.col("clip_id") % 4), "fraction", "score")
    return rows.select(F.concat(F.lit("| "), F.col("fraction").cast("string"), F.lit(" | "), e.mean_std_text("mean", "std", "seeds"), F.lit(" |")).alias("line"))


def box_prints(s, sf):
    return n.content_hash(view(s, sf, "v_boxes").withColumn("score", F.rint(F.col("score") * 100).cast("int")), ["scene_id", "box_id", "side", "score"], "fingerprint").select("scene_id", "box_id", "fingerprint")


QUERIES = {
    "manifest_round_trip": manifest_round_trip,
    "manifest_violations": manifest_violations,
    "detections_round_trip": detections_round_trip,
    "csv_round_trip": csv_round_trip,
    "settled_labels": settled_labels,
    "inventory_changes": inventories,
    "official_splits": official,
    "frame_annotations": frame_lines,
    "scene_manifest": scene_manifest,
    "scene_violations": scene_rules,
    "bag_violations": bag_rules,
    "clip_names": lambda s, sf: names(s, sf).select("clip_id", i.source_identity(F.col("video")).alias("source"), i.clip_kind(F.col("clip")).alias("kind"), i.clip_source(F.col("clip")).alias("clip_source"), i.safe_name(F.col("clip")).alias("safe")),
    "scoped_paths": lambda s, sf: names(s, sf).select("clip_id", i.scoped_path(F.col("path")).alias("scoped")),
    "guard_groups": lambda s, sf: names(s, sf).select("clip_id", u.guard_group(F.col("dataset"), F.col("clip_id").cast("string"), F.col("verified"), F.col("tour")).alias("guard"), u.recording_key(F.col("dataset"), F.col("stem")).alias("recording"), u.capture_time(F.col("stamp")).alias("captured")),
    "valid_intervals": intervals_valid,
    "quarantined_annotations": lambda s, sf: i.quarantined(assessed(s, sf)).select("clip_id", F.array_join("issues", ",").alias("issues")),
    "paired_predictions": lambda s, sf: e.paired_predictions(view(s, sf, "v_multiclass").where("clip_id % 9 <> 4"), second_opinion(s, sf), "clip_id"),
    "group_and_actor_metrics": lambda s, sf: e.group_and_actor_metrics(group_scenes(s, sf), 6, 6),
    "bag_evaluation": lambda s, sf: e.evaluate_bags(view(s, sf, "v_segments"), view(s, sf, "v_truth").select("video_id", F.expr("CAST(group_label % 2 AS INT)").alias("label")), 0.95),
    "frame_evaluation": frames_evaluated,
    "frozen_split_changes": lambda s, sf: e.split_violations(*frozen_and_now(s, sf)),
    "artifact_changes": lambda s, sf: n.artifact_changes(*map(artifacts, frozen_and_now(s, sf))),
    "merged_splits": merged,
    "historical_inventory": historical,
    "held_out_rows": held,
    "appended_reviews": reviews_appended,
    "current_revisions": revisions,
    "deleted_uploads": uploads_deleted,
    "job_details": details,
    "table_backup": backup,
    "report_lines": report,
    "box_fingerprints": box_prints,
    "clipped_boxes": lambda s, sf: g.staged_filter(view(s, sf, "v_boxes"), 40.0, 40.0, 0.0, 1.0).groupBy("side", "reason").agg(F.count("*").alias("n"), F.sum(F.col("x2") - F.col("x1")).alias("width")),
}

NAMED = f"nm AS ({NAMES})"
MANIFEST = "mf AS (SELECT *, CAST(clip_id AS VARCHAR) AS video_id FROM v_clips WHERE source_video_id IS NOT NULL AND duration > 1)"
FROZEN = """old AS (SELECT * FROM v_clips WHERE clip_id % 17 <> 5),
    new AS (SELECT clip_id, source_video_id, CASE WHEN clip_id % 37 = 1 THEN 'moved' ELSE split END AS split, CASE WHEN clip_id % 11 = 2 THEN 'new' ELSE sha256 END AS sha256 FROM v_clips WHERE clip_id % 13 <> 0)"""
SCENES = """sr AS (SELECT scene_id // 10 AS sequence, scene_id % 10 * 5 + 1 AS frame, x1, x2, y1, y2, CAST(box_id % 3 AS INTEGER) AS action FROM v_boxes), sk AS (SELECT * FROM sr WHERE frame % 10 = 1),
    sv AS (SELECT sequence, frame, action, row_number() OVER (PARTITION BY sequence, frame ORDER BY count(*) DESC, action) AS i FROM sk GROUP BY sequence, frame, action),
    sc AS (SELECT sequence, frame, count(*) AS n, sum(x2 / 90 - x1 / 90) AS widths, max(CASE WHEN NOT (x1 / 90 >= 0 AND y1 / 90 >= 0 AND x2 / 90 <= 1 AND y2 / 90 <= 1 AND x1 < x2 AND y1 < y2) THEN 1 ELSE 0 END) AS bad FROM sk GROUP BY sequence, frame)"""
AUC = """rr AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / CAST(2 AS DOUBLE) AS rk FROM pop),
    au AS (SELECT (sum(CASE WHEN label = 1 THEN rk END) - CAST(sum(label) AS DOUBLE) * (sum(label) + 1) / 2) / nullif(CAST(sum(label) AS DOUBLE) * sum(1 - label), 0) AS roc_auc FROM rr)"""
BINARY = AUC + ", w AS (SELECT " + COUNTS + " FROM pop, (SELECT CAST({t} AS DOUBLE) AS t)) SELECT *, " + RATES + ", (tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE) AS accuracy, fn / CAST(nullif(fn + tp, 0) AS DOUBLE) AS fnr FROM w, au"
SUMMARY = """SELECT '{level}' AS level, (SELECT count(*) FROM {rows}) AS n, (SELECT count(prediction) FROM {rows}) AS covered, (SELECT sum(CASE WHEN truth = prediction THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) FROM {rows}) AS accuracy,
    (SELECT avg(coalesce(2 * (SELECT count(*) FROM {rows} WHERE truth = c AND prediction = c) / CAST(nullif((SELECT count(*) FROM {rows} WHERE truth = c) + (SELECT count(*) FROM {rows} WHERE prediction = c), 0) AS DOUBLE), 0)) FROM range(0, 6) r(c)) AS macro_f1"""

ORACLES = {
    "manifest_round_trip": oracle(f", {MANIFEST} SELECT video_id, source_video_id, 'v/' || video_id || '.mp4' AS path, split, CAST(clip_id % 2 AS INTEGER) AS label, duration AS duration_sec, CAST(floor(duration * 25) AS BIGINT) AS num_frames, CAST(CASE clip_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS INTEGER) AS intervals FROM mf"),
    "manifest_violations": oracle(f""", {MANIFEST}, x AS (SELECT *, CASE WHEN clip_id % 17 = 0 THEN 'holdout' ELSE split END AS s2 FROM mf), t AS (SELECT * FROM x UNION ALL SELECT * FROM x WHERE clip_id % 29 = 0)
        SELECT video_id, 'unknown_split' AS code FROM t WHERE clip_id % 17 = 0 UNION ALL SELECT video_id, 'unknown_label' FROM t WHERE clip_id % 19 = 0 UNION ALL SELECT video_id, 'invalid_interval' FROM t WHERE clip_id % 23 = 0
        UNION ALL SELECT video_id, 'nonpositive_clock' FROM t WHERE clip_id % 31 = 0 UNION ALL SELECT video_id, 'duplicate_video' FROM x WHERE clip_id % 29 = 0
        UNION ALL SELECT source_video_id, 'source_crosses_splits' FROM x GROUP BY 1 HAVING count(DISTINCT s2) > 1"""),
    "detections_round_trip": oracle(""", sn AS (SELECT DISTINCT scene_id FROM v_boxes), o AS (SELECT *, least(score, 1) AS sc FROM v_boxes WHERE side = 'det'),
        r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY (x1 + x2) / 2, (y1 + y2) / 2, x1, y1, x2, y2, -sc, box_id % 3) - 1 AS rank FROM o)
        SELECT CAST(sn.scene_id AS VARCHAR) AS clip_id, CAST(rank AS INTEGER) AS rank, x1, y1, y2, sc AS score FROM sn LEFT JOIN r ON r.scene_id = sn.scene_id"""),
    "csv_round_trip": oracle(""" SELECT clip_id, collection, score, 'say "' || collection || '",' || chr(10) || 'then go' AS note FROM v_scored"""),
    "settled_labels": oracle(""", r AS (SELECT 'c' || CAST(clip_id % 97 AS VARCHAR) AS clip, CASE WHEN clip_id % 97 < 40 THEN 'x' ELSE collection END AS category, CASE WHEN clip_id % 11 = 0 THEN '7' ELSE CAST(clip_id % 2 AS VARCHAR) END AS label FROM v_clips),
        c AS (SELECT clip, count(DISTINCT category || '/' || label) AS kinds FROM r WHERE label IN ('0', '1') GROUP BY clip)
        SELECT DISTINCT r.clip, category, label, 'settled' AS reason FROM r JOIN c ON c.clip = r.clip WHERE label IN ('0', '1') AND kinds = 1
        UNION ALL SELECT clip, category, label, 'invalid' FROM r WHERE label NOT IN ('0', '1')
        UNION ALL SELECT r.clip, category, label, 'conflict' FROM r JOIN c ON c.clip = r.clip WHERE label IN ('0', '1') AND kinds > 1"""),
    "inventory_changes": oracle(""" SELECT '/v/' || CAST(clip_id AS VARCHAR) AS path, CASE WHEN clip_id % 11 = 4 THEN 'added' WHEN clip_id % 7 = 3 THEN 'removed' ELSE 'changed' END AS change FROM v_clips
        WHERE (clip_id % 11 = 4 AND clip_id % 7 <> 3) OR (clip_id % 11 <> 4 AND clip_id % 7 = 3) OR (clip_id % 11 <> 4 AND clip_id % 7 <> 3 AND clip_id % 5 = 0)"""),
    "official_splits": oracle(" SELECT clip_id AS name, collection, CASE WHEN clip_id % 4 = 1 THEN 'test' ELSE 'train' END AS split FROM v_clips"),
    "frame_annotations": oracle(""", v AS (SELECT clip_id, CAST(floor(duration * 25) AS BIGINT) AS n FROM v_clips WHERE duration > 2 AND clip_id % 3 <> 0)
        SELECT CAST(clip_id AS VARCHAR) AS video_id, 2 / CAST(25 AS DOUBLE) AS start_s, 20 / CAST(25 AS DOUBLE) AS end_s FROM v UNION ALL SELECT CAST(clip_id AS VARCHAR), (n - 10) / CAST(25 AS DOUBLE), n / CAST(25 AS DOUBLE) FROM v"""),
    "scene_manifest": oracle(f", {SCENES} SELECT sc.sequence, sc.frame, action AS group_label, CAST(n AS INTEGER) AS n_actors, widths FROM sc JOIN sv ON sv.sequence = sc.sequence AND sv.frame = sc.frame AND i = 1"),
    "scene_violations": oracle(f""", {SCENES}, z AS (SELECT *, 's' || CAST(sequence AS VARCHAR) AS source_id, 'v' || CAST(sequence // 2 AS VARCHAR) AS video_id, CASE WHEN sequence % 9 = 0 THEN 1 ELSE frame END AS center,
            CASE WHEN sequence % 5 = 0 THEN 'val' WHEN sequence % 7 = 0 AND frame > 20 THEN 'test' ELSE 'train' END AS split, 'p' || CAST(sequence // 4 AS VARCHAR) AS path FROM sc)
        SELECT 'duplicate_scene' AS code, source_id || '/' || min(video_id) || '/' || CAST(center AS VARCHAR) AS key FROM z GROUP BY source_id, center HAVING count(*) > 1
        UNION ALL SELECT 'source_id_crosses_splits', source_id FROM z GROUP BY source_id HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'video_id_crosses_splits', video_id FROM z GROUP BY video_id HAVING count(DISTINCT split) > 1
        UNION ALL SELECT 'path_crosses_splits', path FROM z GROUP BY path HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'invalid_actor', source_id || '/' || video_id || '/' || CAST(center AS VARCHAR) FROM z WHERE bad = 1"""),
    "bag_violations": oracle(""", c AS (SELECT video_id, least(count(*), CASE WHEN video_id % 7 = 0 THEN 2 ELSE 4 END) AS n FROM v_segments WHERE seg < 6 GROUP BY video_id)
        SELECT video_id, CASE WHEN n <> 4 THEN 'shape' ELSE 'not_finite' END AS code FROM c WHERE n <> 4 OR video_id % 5 = 0"""),
    "clip_names": oracle(f""", {NAMED} SELECT clip_id, lower(CASE WHEN regexp_full_match(video, '(?i).+\\d+_x264([_-].*)?') THEN regexp_extract(video, '(?i)^(.+\\d+)_x264', 1) ELSE video END) AS source,
        CASE split_part(clip, '_label_', 2) WHEN 'A' THEN 'normal' WHEN 'B1-0-0' THEN 'violent' WHEN 'B4-B5-0' THEN 'violent' WHEN 'B5' THEN 'violent' ELSE 'excluded' END AS kind, split_part(clip, '__#', 1) AS clip_source, regexp_replace(clip, '[^A-Za-z0-9_.-]', '_', 'g') AS safe FROM nm"""),
    "scoped_paths": oracle(f", {NAMED} SELECT clip_id, path = 'a..b/c' OR starts_with(path, 'p/') AS scoped FROM nm"),
    "guard_groups": oracle(f""", {NAMED} SELECT clip_id, CASE WHEN verified = 'True' THEN 'recording:' || CAST(clip_id AS VARCHAR) WHEN dataset = 'WalkIndia-50' AND tour = 'x-tour-2' THEN tour WHEN dataset = 'WalkIndia-50' THEN 'walkindia-entire-release-unresolved' ELSE 'other-1-entire-collection-unresolved' END AS guard,
        CASE WHEN dataset = 'WalkIndia-50' AND starts_with(stem, 'delhi') THEN 'walkindia-' || left(stem, -2) WHEN dataset <> 'WalkIndia-50' AND stem = 'krishna-clip-7' THEN 'hci-krishna' END AS recording,
        try_strptime(replace(substr(stamp, 5), '_', ''), '%Y%m%d%H%M%S') AS captured FROM nm"""),
    "valid_intervals": oracle(" SELECT clip_id, duration - clip_id % 2 > 0 AND duration >= 2 AS valid FROM v_clips"),
    "quarantined_annotations": oracle(f", {ASSESS} SELECT clip_id, array_to_string(issues, ',') AS issues FROM y WHERE len(issues) > 0"),
    "paired_predictions": oracle(""", a AS (SELECT * FROM v_multiclass WHERE clip_id % 9 <> 4), b AS (SELECT clip_id, CASE WHEN clip_id % 10 = 0 THEN NULL WHEN clip_id % 4 = 0 THEN truth ELSE prediction END AS q FROM v_multiclass WHERE clip_id % 8 <> 5),
        j AS (SELECT a.clip_id AS x, b.clip_id AS y, coalesce(prediction = truth, FALSE) AS p1, coalesce(q = truth, FALSE) AS p2, prediction IS NOT DISTINCT FROM q AS same FROM a FULL JOIN b ON a.clip_id = b.clip_id),
        k AS (SELECT *, x IS NOT NULL AND y IS NOT NULL AS met FROM j)
        SELECT count(*) FILTER (WHERE met) AS pairs, count(*) FILTER (WHERE met AND p1 AND p2) AS both_right, count(*) FILTER (WHERE met AND p1 AND NOT p2) AS only_first, count(*) FILTER (WHERE met AND NOT p1 AND p2) AS only_second, count(*) FILTER (WHERE met AND NOT p1 AND NOT p2) AS both_wrong,
            count(*) FILTER (WHERE met AND same) / CAST(count(*) FILTER (WHERE met) AS DOUBLE) AS agreement, count(*) FILTER (WHERE NOT met) AS unpaired FROM k"""),
    "group_and_actor_metrics": oracle(f""", ac AS (SELECT truth, prediction FROM v_multiclass WHERE clip_id % 3 <> 0 UNION ALL SELECT 1, CAST(clip_id % 3 AS INTEGER) FROM v_multiclass WHERE clip_id % 5 <> 0)
        {SUMMARY.format(level='group', rows='v_multiclass')} UNION ALL {SUMMARY.format(level='actor', rows='ac')}"""),
    "bag_evaluation": oracle(f", pop AS (SELECT video_id, max(score) AS score, video_id % 6 % 2 AS label FROM v_segments GROUP BY video_id), {BINARY.format(t='0.95')}"),
    "frame_evaluation": oracle(f""", vd AS (SELECT video_id, list(score ORDER BY seg) AS scores, video_id % 150 + 3 AS n, count(*) AS s FROM v_segments GROUP BY video_id), {EVENTS}, ff AS (SELECT vd.*, f AS frame FROM vd, unnest(range(0, n)) u(f)),
        pop AS (SELECT CASE WHEN n < s THEN scores[CAST(least(floor((frame + CAST(0.5 AS DOUBLE)) * s / n), s - 1) + 1 AS BIGINT)] ELSE scores[CAST(least((frame * s + s - 1) // n, s - 1) + 1 AS BIGINT)] END AS score,
            CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.video_id = ff.video_id AND frame / CAST(2 AS DOUBLE) >= e.start_s AND frame / CAST(2 AS DOUBLE) < e.end_s) THEN 1 ELSE 0 END AS label FROM ff), {BINARY.format(t='0.5')}"""),
    "frozen_split_changes": oracle(f""", {FROZEN}, j AS (SELECT coalesce(old.clip_id, new.clip_id) AS id, old.clip_id AS o, new.clip_id AS w, old.split AS s1, new.split AS s2, old.sha256 AS h1, new.sha256 AS h2 FROM old FULL JOIN new ON old.clip_id = new.clip_id)
        SELECT CAST(id AS VARCHAR) AS video_id, CASE WHEN w IS NULL THEN 'missing' WHEN o IS NULL THEN 'added' WHEN s1 <> s2 THEN 'moved' ELSE 'changed' END AS code FROM j WHERE w IS NULL OR o IS NULL OR s1 <> s2 OR h1 <> h2
        UNION ALL SELECT source_video_id, 'source_crosses_splits' FROM new GROUP BY 1 HAVING count(DISTINCT split) > 1"""),
    "artifact_changes": oracle(f""", {FROZEN} SELECT CAST(coalesce(old.clip_id, new.clip_id) AS VARCHAR) AS name, CASE WHEN new.clip_id IS NULL THEN 'missing' WHEN old.clip_id IS NULL THEN 'added' ELSE 'changed' END AS code
        FROM old FULL JOIN new ON old.clip_id = new.clip_id WHERE old.sha256 IS DISTINCT FROM new.sha256"""),
    "merged_splits": oracle(f", {FROZEN} " + " UNION ALL ".join(f"SELECT '{x}' AS dataset, '{x}:' || CAST(clip_id AS VARCHAR) AS video_id, '{x}:' || source_video_id AS source_video_id, split FROM {x}" for x in ("old", "new"))),
    "historical_inventory": oracle(""", h AS (SELECT source_video_id, sha256 FROM v_clips WHERE collection = 'en' UNION ALL SELECT source_video_id, CASE WHEN clip_id % 2 = 0 THEN sha256 END FROM v_clips WHERE clip_id % 5 = 0)
        SELECT DISTINCT 'source' AS kind, source_video_id AS value FROM h WHERE source_video_id IS NOT NULL UNION ALL SELECT DISTINCT 'digest', sha256 FROM h WHERE sha256 IS NOT NULL"""),
    "held_out_rows": oracle(" SELECT clip_id, source_video_id FROM v_clips WHERE split = 'test' AND clip_id % 2 = 0 AND NOT coalesce(source_video_id < 'src1', FALSE)"),
    "appended_reviews": oracle(""" SELECT i.job_id, i.item_seq, decision, CASE WHEN i.item_seq = 1 THEN CASE WHEN i.job_id % 2 = 0 THEN 2 ELSE 1 END ELSE 0 END + CAST(row_number() OVER (PARTITION BY i.job_id, i.item_seq ORDER BY decision) AS INTEGER) AS seq
        FROM v_items i, (SELECT unnest(['accept', 'reject']) AS decision) WHERE status = 'completed' AND (i.job_id % 3 = 0 OR decision = 'accept')"""),
    "current_revisions": "SELECT user_id AS session, max(event_id) AS revision, arg_max(event_type, event_id) AS result FROM events GROUP BY user_id",
    "deleted_uploads": oracle(""", a AS (SELECT DISTINCT clip_id FROM v_items WHERE item_seq < 3 AND status IN ('queued', 'running'))
        SELECT DISTINCT clip_id, clip_id % 3 <> 0 AS owned, CASE WHEN clip_id % 2 = 0 AND clip_id % 3 <> 0 AND clip_id NOT IN (SELECT clip_id FROM a) THEN 'deleted' ELSE 'ready' END AS status FROM v_items"""),
    "job_details": oracle(""" SELECT job_id, CASE WHEN bool_or(status = 'running') THEN 'running' WHEN bool_or(status = 'queued') THEN 'queued' WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'cancelled') THEN 'cancelled' ELSE 'completed' END AS state,
        count(*) FILTER (WHERE status NOT IN ('queued', 'running')) / CAST(count(*) AS DOUBLE) AS progress, string_agg(CAST(item_seq AS VARCHAR) || ':' || status, ',' ORDER BY item_seq) AS item_list FROM v_items WHERE job_id IN (SELECT job_id FROM v_jobs) GROUP BY job_id"""),
    "table_backup": oracle(" SELECT 'jobs' AS name, job_id AS id FROM v_jobs UNION ALL SELECT 'truth', video_id FROM v_truth"),
    "report_lines": oracle(" SELECT '| ' || CAST(clip_id % 4 AS VARCHAR) || ' | ' || printf('%.4f ± %.4f (n=%d)', avg(score), stddev_pop(score), count(score)) || ' |' AS line FROM v_scored GROUP BY clip_id % 4"),
    "box_fingerprints": oracle(""" SELECT scene_id, box_id, sha256('{"box_id":' || CAST(box_id AS VARCHAR) || ',"scene_id":' || CAST(scene_id AS VARCHAR) || ',"score":' || CAST(CAST(round_even(score * 100, 0) AS INTEGER) AS VARCHAR) || ',"side":"' || side || '"}') AS fingerprint FROM v_boxes"""),
    "clipped_boxes": oracle(""", c AS (SELECT side, greatest(least(x1, 40), 0) AS x1, greatest(least(y1, 40), 0) AS y1, greatest(least(x2, 40), 0) AS x2, greatest(least(y2, 40), 0) AS y2, x2 > x1 AND y2 > y1 AS valid FROM v_boxes)
        SELECT side, CASE WHEN NOT valid THEN 'invalid_geometry' WHEN x2 <= x1 OR y2 <= y1 THEN 'outside_image' WHEN x2 - x1 < 1 OR y2 - y1 < 1 THEN 'too_small' END AS reason, count(*) AS n, sum(x2 - x1) AS width FROM c GROUP BY 1, 2"""),
}
