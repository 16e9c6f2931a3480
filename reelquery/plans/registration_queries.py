"""Queries of reuse, registration and error reports over the fixture views, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelquery.operators import registration as r
from reelquery.operators import report
from reelquery.plans.freezing_queries import PAIRED, SCENES, paired
from reelquery.plans.protocol_queries import duck, made
from reelquery.plans.views import oracle

TEXT = "VARCHAR(20)"
ID = f"CAST(clip_id AS {TEXT})"
CLIPS = "SELECT clip_id, source_video_id, CAST(clip_id % 6 AS INT) AS group_label, split, sha256, CAST(6 + clip_id % 40 AS INT) AS num_frames FROM {v_clips} WHERE clip_id % 29 <> 3"
#: A prior audit, and the annotations and the catalog of today.
RECORDS = f"SELECT clip_id, concat('a', {ID}) AS annotation, sha256, concat('v/', {ID}) AS path, CASE WHEN clip_id % 37 = 4 THEN 'other' ELSE sha256 END AS file_sha256 FROM {{v_clips}} WHERE clip_id % 3 <> 0 AND clip_id % 41 <> 7"
CURRENT = f"SELECT clip_id, concat(CASE WHEN clip_id % 23 = 5 THEN 'b' ELSE 'a' END, {ID}) AS annotation, concat(CAST(clip_id % 90 AS {TEXT}), CASE WHEN clip_id % 2 = 0 THEN '.50' ELSE '.5' END) AS duration FROM {{v_clips}} WHERE clip_id % 3 <> 0 AND clip_id % 43 <> 8"
CATALOG = f"SELECT clip_id, CASE WHEN clip_id % 31 = 6 THEN 'new' ELSE sha256 END AS sha256, concat(CASE WHEN clip_id % 47 = 9 THEN 'w/' ELSE 'v/' END, {ID}) AS path, CASE WHEN clip_id % 53 = 10 THEN 'n/a' ELSE concat(CAST(clip_id % 90 AS {TEXT}), CASE WHEN clip_id % 59 = 11 THEN '.501' ELSE '.500' END) END AS duration FROM {{v_clips}} WHERE clip_id % 61 <> 12"
EXCLUDED = "SELECT clip_id FROM {v_clips} WHERE clip_id % 3 = 0 AND clip_id % 67 <> 13 UNION ALL SELECT clip_id FROM {v_clips} WHERE clip_id % 71 = 14"
HELD = f"SELECT clip_id, CAST(clip_id % 5 % 2 AS INT) AS issues, clip_id % 7 <> 0 AS readable, CASE WHEN clip_id % 4 = 1 THEN NULL ELSE collection END AS label, CASE WHEN clip_id % 9 = 2 THEN 'n/a' ELSE concat(CAST(clip_id % 90 AS {TEXT}), '.125') END AS duration FROM {{v_clips}}"
MODELS = "SELECT job_id AS run, model, CASE WHEN job_id % 13 = 3 AND model = 'head' THEN 'xyz' WHEN job_id % 17 = 4 AND model = 'detector' THEN '' ELSE {digest} END AS sha256 FROM {v_jobs}, (SELECT 'head' AS model UNION ALL SELECT 'detector' UNION ALL SELECT 'extra') ms WHERE (model <> 'extra' OR job_id % 11 = 2) AND NOT (model = 'head' AND job_id % 19 = 5)"
PINS = {"spark": MODELS.replace("{digest}", "sha2(concat(model, CAST(job_id % 5 AS VARCHAR(20))), 256)"), "duck": MODELS.replace("{digest}", "sha256(concat(model, CAST(job_id % 5 AS VARCHAR(20))))")}
SELECTED = "SELECT job_id AS run, CASE job_id % 3 WHEN 0 THEN 'frame' WHEN 1 THEN 'bag' END AS evaluation_mode, CASE job_id % 4 WHEN 0 THEN 'interpolate' WHEN 1 THEN 'repeat' END AS frame_projection FROM {v_jobs} WHERE job_id % 10 <> 0"
REQUESTED = "SELECT job_id AS run, CASE WHEN job_id % 2 = 0 THEN 'frame' ELSE 'bag' END AS mode, CASE job_id % 5 WHEN 0 THEN 'interpolate' WHEN 1 THEN 'repeat' END AS projection FROM {v_jobs}"
EXPERIMENTS = "SELECT job_id AS run, CASE WHEN job_id % 23 = 1 THEN 0.4 ELSE 0.5 END AS anomaly_threshold, CAST(CASE WHEN job_id % 29 = 2 THEN 5 ELSE 3 END AS INT) AS max_windows, 'p1' AS protocol_sha256, 'shared' AS population FROM {v_jobs}"
CHOSEN = "SELECT job_id AS run, model, {digest} AS checkpoint_sha256, CASE WHEN job_id % 31 = 3 THEN 0.7 WHEN model = 'head' THEN 0.5 END AS anomaly_threshold, CASE WHEN job_id % 37 = 4 THEN 'p2' WHEN model = 'head' THEN 'p1' END AS protocol_sha256, CASE WHEN job_id % 41 = 5 THEN 'own' WHEN model = 'head' THEN 'shared' END AS population, CASE WHEN job_id % 43 = 6 THEN NULL ELSE TRUE END AS selection_frozen, job_id % 47 = 7 AS held_out_used_for_selection FROM {v_jobs}, (SELECT 'head' AS model UNION ALL SELECT 'detector') ms"
PICKED = {"spark": CHOSEN.replace("{digest}", "sha2(concat(model, CAST(job_id % 5 AS VARCHAR(20))), 256)"), "duck": CHOSEN.replace("{digest}", "sha256(concat(model, CAST(job_id % 5 AS VARCHAR(20))))")}
NAMES = ["crossing", "waiting", "queueing", "walking", "tal|king"]


def caches(s, d):
    clips = made(s, d, CLIPS)
    n, k = F.col("num_frames"), F.col("clip_id")
    when = lambda m, rest, changed, own: F.when(k % m == rest, changed).otherwise(own)
    middle = F.expr("num_frames div 2").cast("int")
    frames = F.transform(F.sequence(F.lit(-5), F.lit(4)), lambda o: F.greatest(F.lit(0), F.least(n - 1, middle + o)))
    rows = clips.where("clip_id % 17 <> 5").select(
        "clip_id", when(19, 2, F.lit("moved"), F.col("source_video_id")).alias("source_video_id"), when(23, 3, F.lit(9), F.col("group_label")).alias("group_label"), when(31, 4, F.lit(None), F.col("split")).alias("split"),
        when(37, 5, F.lit(2), F.lit(1)).alias("schema_version"), when(41, 6, F.lit("h"), F.col("sha256")).alias("video_sha256"), F.lit("zero_based_clip_local").alias("coordinates"), when(43, 7, F.array(F.lit(0)), frames).alias("frame_indices"),
        when(47, 8, F.lit(-1), middle).alias("reference_frame"), when(53, 9, F.lit("old"), F.lit("d1")).alias("checkpoint_sha256"), when(59, 10, F.lit("{}"), F.lit('{"at":0.7}')).alias("filter_config"),
        F.array(F.array(F.lit(0), F.lit(1), (k % 50 + 5).cast("int"), F.lit(40))).alias("boxes"), F.array((k % 100).cast("int")).alias("scores"), when(61, 11, F.array(F.lit(1), F.lit(2)), F.array(F.lit(1))).alias("person_labels"), F.array(F.lit(240), F.lit(320)).alias("image_size"),
    )
    rows = rows.withColumn("fingerprint", F.when(k % 67 == 12, "stale").otherwise(r.cache_fingerprint()))
    again = rows.where("clip_id % 71 = 13")
    return rows.unionByName(again).unionByName(rows.where("clip_id % 73 = 14").withColumn("clip_id", -F.col("clip_id") - 1)), clips


def coded(rows):
    return rows.withColumn("codes", F.array_join("codes", ","))


def errors(s, d):
    scenes = made(s, d, SCENES, "v_multiclass")
    return report.error_report(scenes, paired(s, d), "Errors of group predictions", NAMES)


QUERIES = {
    "stale_caches": lambda s, d: coded(r.stale_caches(*caches(s, d), "d1", '{"at":0.7}')),
    "reuse_violations": lambda s, d: coded(r.reuse_violations(*[made(s, d, x) for x in (RECORDS, CURRENT, CATALOG, EXCLUDED)])),
    "reuse_summary": lambda s, d: r.reuse_summary(made(s, d, HELD)).withColumn("seconds", F.col("seconds").cast("double")),
    "pin_violations": lambda s, d: r.pin_violations(made(s, d, PINS["spark"], "v_jobs"), ["head", "detector"]),
    "resolved_policies": lambda s, d: r.resolved_policies(made(s, d, SELECTED, "v_jobs"), made(s, d, REQUESTED, "v_jobs")),
    "experiment_violations": lambda s, d: coded(r.experiment_violations(made(s, d, EXPERIMENTS, "v_jobs"), made(s, d, PICKED["spark"], "v_jobs"), made(s, d, PINS["spark"], "v_jobs"), 0.5, 3)),
    "error_report": errors,
}
of = lambda sql: sql.replace("{v_jobs}", "v_jobs")
SHOWN = "['crossing', 'waiting', 'queueing', 'walking', 'tal\\|king'][{0} + 1]"
named = lambda c: f"coalesce({SHOWN.replace('{0}', c)}, 'unknown')"
four = lambda c: f"coalesce(printf('%.4f', {c}), 'unknown')"


def side(section, title, prediction, confidence):
    return f"""UNION ALL SELECT {section}, i - 1, '', ['', '## {title}', '', '| Group predictions | Known confidence count | Mean | Std | Unknown |', '| --- | ---: | ---: | ---: | ---: |'][i] FROM range(1, 6) t(i)
        UNION ALL SELECT {section}, 9, kind, '| ' || kind || ' | ' || count(c) || ' | ' || {four('avg(c)')} || ' | ' || {four('stddev_pop(c)')} || ' | ' || (count(*) - count(c)) || ' |' FROM (SELECT 'all' AS kind, {confidence} AS c FROM sc UNION ALL SELECT CASE WHEN {prediction} = truth THEN 'correct' ELSE 'wrong' END, {confidence} FROM sc) GROUP BY kind
        UNION ALL SELECT {section + 1}, i - 1, '', ['', '| True group | Predicted group | Error count |', '| --- | --- | ---: |'][i] FROM range(1, 4) t(i)
        UNION ALL SELECT {section + 1}, 1152921504606846976 - count(*) + 9, lpad(CAST(truth AS VARCHAR), 5, ' ') || '>' || lpad(CAST({prediction} AS VARCHAR), 5, ' '), '| ' || {named('truth')} || ' | ' || {named(prediction)} || ' | ' || count(*) || ' |' FROM sc WHERE {prediction} <> truth GROUP BY truth, {prediction}"""


ORACLES = {
    "stale_caches": oracle(f""", cl AS ({duck(CLIPS)}), ca AS (SELECT clip_id, clip_id AS k, true AS there FROM cl WHERE clip_id % 17 <> 5 UNION ALL SELECT -clip_id - 1, clip_id, false FROM cl WHERE clip_id % 17 <> 5 AND clip_id % 73 = 14),
        co AS (SELECT clip_id, CASE WHEN NOT there THEN ['unknown_clip'] ELSE list_filter([CASE WHEN k % 71 = 13 THEN 'repeated_cache' END, CASE WHEN k % 19 = 2 THEN 'identity:source_video_id' END, CASE WHEN k % 23 = 3 THEN 'identity:group_label' END, CASE WHEN k % 31 = 4 THEN 'identity:split' END,
            CASE WHEN k % 37 = 5 THEN 'stale:schema_version' END, CASE WHEN k % 41 = 6 THEN 'stale:video_sha256' END, CASE WHEN k % 43 = 7 THEN 'stale:frame_indices' END, CASE WHEN k % 47 = 8 OR k % 43 = 7 THEN 'stale:reference_frame' END, CASE WHEN k % 53 = 9 THEN 'stale:checkpoint_sha256' END, CASE WHEN k % 59 = 10 THEN 'stale:filter_config' END,
            CASE WHEN k % 61 = 11 THEN 'changed:person_labels' END, CASE WHEN k % 67 = 12 THEN 'changed:fingerprint' END], lambda x: x IS NOT NULL) END AS codes FROM ca)
        SELECT clip_id, array_to_string(codes, ',') AS codes FROM co WHERE len(codes) > 0 UNION ALL SELECT clip_id, 'missing_cache' FROM cl WHERE clip_id % 17 = 5"""),
    "reuse_violations": oracle(f""", re AS ({duck(RECORDS)}), cu AS ({duck(CURRENT)}), ca AS ({duck(CATALOG)}), ex AS (SELECT clip_id, count(*) AS n FROM ({duck(EXCLUDED)}) x GROUP BY 1), ids AS (SELECT clip_id FROM re UNION SELECT clip_id FROM cu UNION SELECT clip_id FROM ca UNION SELECT clip_id FROM ex),
        j AS (SELECT i.clip_id, re.clip_id AS r, cu.clip_id AS c, ca.clip_id AS g, ex.clip_id AS e, ex.n, re.annotation AS ra, cu.annotation AS cua, re.sha256 AS rs, ca.sha256 AS cs, re.path AS rp, ca.path AS cp, re.file_sha256 AS rf, TRY_CAST(cu.duration AS DECIMAL(30, 9)) AS d1, TRY_CAST(ca.duration AS DECIMAL(30, 9)) AS d2
            FROM ids i LEFT JOIN re USING (clip_id) LEFT JOIN cu USING (clip_id) LEFT JOIN ca USING (clip_id) LEFT JOIN ex USING (clip_id)),
        k AS (SELECT clip_id, list_filter([CASE WHEN n > 1 THEN 'repeated:exclusions' END, CASE WHEN r IS NOT NULL AND c IS NULL THEN 'annotation_removed' END, CASE WHEN c IS NOT NULL AND r IS NULL THEN 'annotation_added' END, CASE WHEN ra <> cua THEN 'annotation_changed' END, CASE WHEN r IS NOT NULL AND g IS NULL THEN 'not_in_catalog' END, CASE WHEN rs <> cs OR rp <> cp THEN 'catalog_changed' END,
            CASE WHEN rf <> rs THEN 'media_changed' END, CASE WHEN c IS NOT NULL AND g IS NOT NULL AND (d1 IS NULL OR d2 IS NULL OR d1 <> d2) THEN 'duration_conflict' END, CASE WHEN g IS NOT NULL AND c IS NULL AND e IS NULL THEN 'exclusion_added' END, CASE WHEN e IS NOT NULL AND (c IS NOT NULL OR g IS NULL) THEN 'exclusion_removed' END], lambda x: x IS NOT NULL) AS codes FROM j)
        SELECT clip_id, array_to_string(codes, ',') AS codes FROM k WHERE len(codes) > 0"""),
    "reuse_summary": oracle(f", h AS ({duck(HELD)}) SELECT CASE WHEN issues = 0 AND readable THEN 'candidate' ELSE 'quarantine' END AS state, coalesce(label, 'missing') AS label, count(*) AS clips, CAST(coalesce(sum(TRY_CAST(duration AS DECIMAL(20, 6))), 0) AS DOUBLE) AS seconds FROM h GROUP BY 1, 2"),
    "pin_violations": oracle(f""", p AS ({of(PINS['duck'])}) SELECT run, model, CASE WHEN model = 'extra' THEN 'unknown' ELSE 'invalid' END AS code FROM p WHERE model = 'extra' OR NOT regexp_full_match(sha256, '[0-9a-f]{{64}}')
        UNION ALL SELECT DISTINCT run, 'head', 'missing' FROM p WHERE run NOT IN (SELECT run FROM p WHERE model = 'head')"""),
    "resolved_policies": oracle(f", s AS ({of(SELECTED)}), q AS ({of(REQUESTED)}), j AS (SELECT q.*, coalesce(evaluation_mode, 'bag') AS m, coalesce(frame_projection, 'repeat') AS p FROM q LEFT JOIN s USING (run)) SELECT run, mode, coalesce(projection, p) AS projection, mode <> m OR (mode = 'frame' AND projection IS NOT NULL AND projection <> p) AS changed FROM j"),
    "experiment_violations": oracle(f""", ex AS ({of(EXPERIMENTS)}), mo AS ({of(PICKED['duck'])}), pi AS ({of(PINS['duck'])}), z AS (SELECT run, 'threshold' AS code FROM ex WHERE anomaly_threshold <> 0.5 UNION SELECT run, 'windows' FROM ex WHERE max_windows <> 3
        UNION SELECT run, model || ':checkpoint' FROM mo LEFT JOIN pi USING (run, model) WHERE checkpoint_sha256 IS DISTINCT FROM sha256 UNION SELECT run, model || ':selected_threshold' FROM mo WHERE anomaly_threshold <> 0.5 UNION SELECT run, model || ':protocol' FROM mo WHERE protocol_sha256 <> 'p1' UNION SELECT run, model || ':population' FROM mo WHERE population <> 'shared'
        UNION SELECT run, model || ':selection_not_frozen' FROM mo WHERE selection_frozen IS NULL UNION SELECT run, model || ':held_out_used' FROM mo WHERE held_out_used_for_selection) SELECT run, string_agg(code, ',' ORDER BY code) AS codes FROM z GROUP BY run"""),
    "error_report": oracle(f""", {PAIRED} SELECT CAST(section AS INTEGER) AS section, CAST(place AS BIGINT) AS place, key, line FROM (SELECT 0 AS section, i - 1 AS place, '' AS key, ['# Errors of group predictions', ''][i] AS line FROM range(1, 3) t(i) UNION ALL SELECT 0, 2, '', 'Scenes: ' || count(*) FROM sc
        UNION ALL SELECT 1, i - 1, '', ['', '| Category | Scenes |', '| --- | ---: |'][i] FROM range(1, 4) t(i) UNION ALL SELECT 1, 9, category, '| ' || category || ' | ' || count(*) || ' |' FROM (SELECT unnest(categories) AS category FROM pa) GROUP BY category
        UNION ALL SELECT 2, i - 1, '', ['', '| Scene | Truth | GT prediction | Detected prediction | Coverage | Categories |', '| --- | --- | --- | --- | ---: | --- |'][i] FROM range(1, 4) t(i)
        UNION ALL SELECT 2, 9, lpad(CAST(clip_id AS VARCHAR), 20, ' '), '| ' || clip_id || ' | ' || {named('truth')} || ' | ' || {named('gt_prediction')} || ' | ' || {named('det_prediction')} || ' | ' || {four('coverage')} || ' | ' || array_to_string(categories, ', ') || ' |' FROM sc JOIN pa USING (clip_id)
        {side(10, 'Ground Truth', 'gt_prediction', 'gt_confidence')} {side(20, 'Detected', 'det_prediction', 'det_confidence')}) x"""),
}
