"""Duplicate, link, split and annotation queries over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelquery.operators import graph as g
from reelquery.operators import ingest as i
from reelquery.plans.views import oracle, view

RATIOS = {"train": 0.7, "val": 0.15, "test": 0.15}


def clip_edges(s, d):
    """Links by equal content, and between some neighbouring ids."""
    clips = view(s, d, "v_clips")
    near = clips.where("collection = 'es'").select(F.col("clip_id").alias("a"), (F.col("clip_id") + 7).alias("b"))
    return g.token_edges(clips, "clip_id", "sha256").unionByName(near.join(clips.select(F.col("clip_id").alias("b")), "b").select("a", "b"))


def components(s, d):
    return g.connected_components(view(s, d, "v_clips").select(F.col("clip_id").alias("id")), clip_edges(s, d))


def frames(s, d, turned=64):
    """Five frames a clip; of every third clip, all but one of its frames again as another clip, with some bits turned."""
    own = view(s, d, "v_hash").select(F.expr("vec_id div 5").alias("clip_id"), F.expr("CAST(vec_id % 5 AS INT)").alias("frame"), "h")
    again = own.where("clip_id % 3 = 0 AND frame <> clip_id % 4").select((F.col("clip_id") + 1_000_000).alias("clip_id"), "frame", F.col("h").bitwiseXOR(F.lit(turned)).alias("h"))
    return own.unionByName(again)


def nudged(s, d):
    """The patterns of other ids with up to five bits turned, so that some are near."""
    turned = F.col("h").bitwiseXOR(F.expr("shiftleft(31L, CAST(vec_id % 50 AS INT)) & shiftleft(CAST(vec_id % 31 AS BIGINT), CAST(vec_id % 50 AS INT))"))
    return view(s, d, "v_hash").select((F.col("vec_id") + 1_000_000).alias("id"), turned.alias("h"))


def hashes(s, d):
    return view(s, d, "v_hash").select(F.col("vec_id").alias("id"), "h")


def inheritance(s, d):
    clips = view(s, d, "v_clips").groupBy(F.col("source_video_id").alias("ref")).agg(F.first("split").alias("split"))
    sources = view(s, d, "v_truth").groupBy(F.col("source_video_id").alias("source")).agg(F.lit("train").alias("split"))
    links = view(s, d, "v_truth").where("group_label < 2").select(F.col("source_video_id").alias("source"), F.concat(F.lit("src"), (F.col("video_id") % 17).cast("string")).alias("ref")).distinct()
    return g.inherited_split(sources, links, clips)


def groups(s, d):
    return view(s, d, "v_clips").select("source_video_id", "collection").distinct()


def class_groups(s, d):
    return view(s, d, "v_scored").groupBy(F.col("source_video_id").alias("group_id")).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))


def assessed(s, d):
    return i.assess(view(s, d, "v_annotations"))


def reconciled(s, d):
    clips = view(s, d, "v_clips").select("clip_id", "collection", "duration")
    left = clips.where("duration < 150")
    right = clips.where("duration > 20").select("clip_id", F.expr("CASE WHEN clip_id % 13 = 0 THEN 'xx' ELSE collection END").alias("collection"), F.expr("CASE WHEN clip_id % 9 = 0 THEN NULL ELSE duration END").alias("duration"))
    return i.reconcile(left, right, "clip_id", ["collection", "duration"]).withColumn("conflicts", F.array_join("conflicts", ","))


def historical(s, d):
    clips = view(s, d, "v_clips")
    return i.exclude_historical(clips, clips.where("source_video_id IN ('src1', 'src2')"), clips.where("collection = 'es'")).select("clip_id", "source_video_id", "sha256")


def leaking(s, d):
    rows = view(s, d, "v_clips").withColumn("split", F.expr("CASE WHEN clip_id % 3 = 0 AND source_video_id < 'src3' THEN 'test' ELSE split END"))
    return g.leakage(rows, "source_video_id", "split").withColumn("splits", F.array_join("splits", ","))


def timing(s, d):
    rows = view(s, d, "v_clips").select("clip_id", F.col("duration").alias("presentation"), F.floor(F.col("duration") * 25 + F.col("clip_id") % 5).alias("frames"), F.expr("CASE WHEN clip_id % 17 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(25 AS DOUBLE) END").alias("fps"))
    return i.timing_observations(rows).select("clip_id", "frame_clock", "difference", "flagged")


ASSESSED = ["clip_id", "normalized_label", "duration_s", "start_s", "end_s", "issues", "end_excess"]

QUERIES = {
    "exact_duplicates": lambda s, d: g.exact_duplicates(view(s, d, "v_clips"), "clip_id", "sha256"),
    "remove_training_duplicates": lambda s, d: g.remove_training_duplicates(view(s, d, "v_clips"), "clip_id", "sha256", "split").select("clip_id", "split"),
    "hamming_pairs": lambda s, d: g.hamming_pairs(hashes(s, d), nudged(s, d), 4, 62).where("a < b"),
    "near_duplicate_pairs": lambda s, d: g.near_duplicates(frames(s, d), 4, 62),
    "reference_link_counts": lambda s, d: g.frame_matches(frames(s, d, 0b1011001101011), 8, 62, agreeing=2).where("matches >= 2"),
    "adjacent_time_links": lambda s, d: g.adjacent_links(view(s, d, "v_jobs").withColumn("kind", F.col("cancel_requested")), "job_id", "created_at", "kind", 86400.0),
    "connected_components": components,
    "split_inheritance": inheritance,
    "leakage_check": leaking,
    "largest_remainder_split": lambda s, d: g.split_groups(groups(s, d).select("source_video_id").distinct(), "source_video_id", 7, RATIOS),
    "stratified_source_split": lambda s, d: g.split_groups(groups(s, d), "source_video_id", 7, RATIOS, ["collection"]),
    "nested_subsets": lambda s, d: g.nested_subsets(groups(s, d), "source_video_id", 11, [0.25, 0.5, 1.0], ["collection"]),
    "parse_annotation_seconds": lambda s, d: view(s, d, "v_annotations").select("clip_id", i.annotation_seconds(F.col("start_text")).alias("start_s"), i.annotation_seconds(F.col("end_text")).alias("end_s"), i.annotation_seconds(F.col("duration")).alias("duration_s")),
    "normalize_label": lambda s, d: view(s, d, "v_annotations").select("clip_id", i.normalize_label(F.col("label")).alias("label"), i.binary_label(i.normalize_label(F.col("label"))).alias("binary")),
    "assess_annotation_issues": lambda s, d: assessed(s, d).select(*ASSESSED).withColumn("issues", F.array_join("issues", ",")),
    "import_quarantine": lambda s, d: i.issue_counts(assessed(s, d)),
    "accepted_annotations": lambda s, d: i.accepted(assessed(s, d)).select("clip_id", "normalized_label", "start_s", "end_s"),
    "reconcile_sources": reconciled,
    "historical_anti_join": historical,
    "timing_observations": timing,
}

SECONDS = "CASE WHEN regexp_full_match(trim({x}), '\\d+:[0-5]\\d(\\.\\d+)?') THEN 60 * CAST(split_part(trim({x}), ':', 1) AS DOUBLE) + CAST(split_part(trim({x}), ':', 2) AS DOUBLE) WHEN regexp_full_match(trim({x}), '(\\d+(\\.\\d*)?|\\.\\d+)') THEN CAST(trim({x}) AS DOUBLE) END"
NORMAL = "CASE WHEN regexp_replace(lower(trim(label)), '[\\s-]+', '_', 'g') IN ('violence', 'non_violence', 'not_sure') THEN regexp_replace(lower(trim(label)), '[\\s-]+', '_', 'g') END"
ASSESS = f"""x AS (SELECT *, {NORMAL} AS nl, CASE WHEN {SECONDS.format(x='duration')} > 0 THEN {SECONDS.format(x='duration')} END AS du, {SECONDS.format(x='start_text')} AS a, {SECONDS.format(x='end_text')} AS b,
        trim(start_text) <> '' OR trim(end_text) <> '' AS given FROM v_annotations),
    y AS (SELECT *, list_filter([CASE WHEN nl = 'not_sure' THEN 'uncertain_label' END, CASE WHEN trim(label) = '' THEN 'missing_label' END, CASE WHEN nl IS NULL AND trim(label) <> '' THEN 'unsupported_label' END,
        CASE WHEN lower(trim(playback_status)) <> 'ok' THEN 'playback_not_ok' END, CASE WHEN du IS NULL THEN 'invalid_duration' END,
        CASE WHEN given AND a >= b THEN 'invalid_interval_order' END, CASE WHEN given AND a IS NOT NULL AND b > du THEN 'interval_end_after_video' END, CASE WHEN given AND b IS NOT NULL AND a >= du THEN 'interval_start_after_video' END,
        CASE WHEN given AND a IS NOT NULL AND b IS NOT NULL AND nl IS DISTINCT FROM 'violence' THEN 'interval_on_uncertain_or_nonviolent_label' END, CASE WHEN given AND (a IS NULL OR b IS NULL) THEN 'invalid_or_partial_time' END],
        lambda z: z IS NOT NULL) AS issues, CASE WHEN given AND a IS NOT NULL AND b IS NOT NULL THEN a END AS start_s, CASE WHEN given AND a IS NOT NULL AND b IS NOT NULL THEN b END AS end_s FROM x)"""
HASHED = """n AS (SELECT vec_id + 1000000 AS id, xor(h, (CAST(31 AS BIGINT) << (vec_id % 50)) & (CAST(vec_id % 31 AS BIGINT) << (vec_id % 50))) AS h FROM v_hash),
    p AS (SELECT a.vec_id AS a, b.id AS b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM v_hash a JOIN n b ON bit_count(xor(a.h, b.h)) <= 4)"""
MATCHES = """o AS (SELECT vec_id // 5 AS clip, vec_id % 5 AS frame, h FROM v_hash), fr AS (SELECT * FROM o UNION ALL SELECT clip + 1000000, frame, xor(h, {turned}) FROM o WHERE clip % 3 = 0 AND frame <> clip % 4),
    m AS (SELECT a.clip AS a, b.clip AS b, count(*) AS matches, count(DISTINCT a.frame) AS frames_a, count(DISTINCT b.frame) AS frames_b FROM fr a JOIN fr b ON a.clip < b.clip AND bit_count(xor(a.h, b.h)) <= {most} GROUP BY 1, 2)"""
SPLIT = """k AS (SELECT *, row_number() OVER ({w} ORDER BY md5('7:' || source_video_id), source_video_id) - 1 AS rank, count(*) OVER ({w}) AS n FROM u),
    c AS (SELECT *, CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) AS f0, CAST(floor(n * CAST(0.15 AS DOUBLE)) AS BIGINT) AS f1, n * CAST(0.7 AS DOUBLE) AS t0, n * CAST(0.15 AS DOUBLE) AS t1 FROM k),
    r AS (SELECT *, n - f0 - 2 * f1 AS rest FROM c),
    q AS (SELECT *, f0 + CASE WHEN rest >= 1 AND (t0 - f0 >= t1 - f1 OR rest >= 3) THEN 1 ELSE 0 END AS c0, f1 + CASE WHEN (t0 - f0 >= t1 - f1 AND rest >= 2) OR (t0 - f0 < t1 - f1 AND rest >= 1) THEN 1 ELSE 0 END AS c1 FROM r)"""

ORACLES = {
    "exact_duplicates": oracle(" SELECT sha256, count(*) AS copies, min(clip_id) AS first FROM v_clips GROUP BY sha256 HAVING count(*) > 1"),
    "remove_training_duplicates": oracle(""", m AS (SELECT *, max(CASE WHEN split = 'test' THEN 1 ELSE 0 END) OVER (PARTITION BY sha256) AS held, min(clip_id) OVER (PARTITION BY sha256) AS first FROM v_clips)
        SELECT clip_id, split FROM m WHERE CASE WHEN held = 1 THEN split = 'test' ELSE clip_id = first END"""),
    "hamming_pairs": oracle(f", {HASHED} SELECT * FROM p WHERE a < b"),
    "near_duplicate_pairs": oracle(f", {MATCHES.format(turned=64, most=4)} SELECT a, b FROM m WHERE frames_a >= 2 AND frames_b >= 2"),
    "reference_link_counts": oracle(f", {MATCHES.format(turned=0b1011001101011, most=8)} SELECT * FROM m WHERE matches >= 2"),
    "adjacent_time_links": oracle(""", l AS (SELECT job_id AS b, lag(job_id) OVER w AS a, epoch_us(created_at) / CAST(1000000 AS DOUBLE) - epoch_us(lag(created_at) OVER w) / CAST(1000000 AS DOUBLE) AS gap,
        cancel_requested = lag(cancel_requested) OVER w AS same FROM v_jobs WINDOW w AS (ORDER BY created_at, job_id)) SELECT a, b, gap FROM l WHERE same AND gap <= 86400"""),
    "connected_components": oracle(""", e0 AS (SELECT a.clip_id AS a, b.clip_id AS b FROM v_clips a JOIN v_clips b ON a.sha256 = b.sha256 AND a.clip_id <> b.clip_id
            UNION SELECT a.clip_id, b.clip_id FROM v_clips a JOIN v_clips b ON a.collection = 'es' AND b.clip_id = a.clip_id + 7),
        e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
        c AS (SELECT clip_id AS id, clip_id AS reached FROM v_clips UNION SELECT c.id, e.b FROM c JOIN e ON e.a = c.reached)
        SELECT id, min(reached) AS root FROM c GROUP BY id"""),
    "split_inheritance": oracle(""", ref AS (SELECT source_video_id AS ref, min(split) AS split FROM v_clips GROUP BY 1),
        l AS (SELECT DISTINCT source_video_id AS source, 'src' || CAST(video_id % 17 AS VARCHAR) AS ref FROM v_truth WHERE group_label < 2),
        s AS (SELECT DISTINCT source_video_id AS source FROM v_truth),
        n AS (SELECT source, count(DISTINCT split) AS n, max(split) AS split, max(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS test FROM l JOIN ref USING (ref) GROUP BY source)
        SELECT s.source, CASE WHEN test = 1 OR n > 1 THEN NULL WHEN n = 1 THEN n.split ELSE 'train' END AS split,
            CASE WHEN test = 1 THEN 'linked_to_test' WHEN n > 1 THEN 'conflicting_links' WHEN n = 1 AND n.split <> 'train' THEN 'inherited' ELSE 'own' END AS reason FROM s LEFT JOIN n USING (source)"""),
    "leakage_check": oracle(""", m AS (SELECT source_video_id, CASE WHEN clip_id % 3 = 0 AND source_video_id < 'src3' THEN 'test' ELSE split END AS split FROM v_clips)
        SELECT source_video_id, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM m GROUP BY 1 HAVING count(DISTINCT split) > 1"""),
    "largest_remainder_split": oracle(", u AS (SELECT DISTINCT source_video_id FROM v_clips), " + SPLIT.format(w="") + " SELECT source_video_id, CASE WHEN rank < c0 THEN 'train' WHEN rank < c0 + c1 THEN 'val' ELSE 'test' END AS split FROM q"),
    "stratified_source_split": oracle(", u AS (SELECT DISTINCT source_video_id, collection FROM v_clips), " + SPLIT.format(w="PARTITION BY collection") + " SELECT source_video_id, collection, CASE WHEN rank < c0 THEN 'train' WHEN rank < c0 + c1 THEN 'val' ELSE 'test' END AS split FROM q"),
    "nested_subsets": oracle(""", u AS (SELECT DISTINCT source_video_id, collection FROM v_clips), k AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY md5('11:' || source_video_id), source_video_id) - 1 AS rank, count(*) OVER (PARTITION BY collection) AS n FROM u)
        SELECT source_video_id, collection, f AS fraction FROM k, (SELECT unnest([CAST(0.25 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(1 AS DOUBLE)]) AS f) WHERE rank < ceil(f * n)"""),
    "parse_annotation_seconds": oracle(f" SELECT clip_id, {SECONDS.format(x='start_text')} AS start_s, {SECONDS.format(x='end_text')} AS end_s, {SECONDS.format(x='duration')} AS duration_s FROM v_annotations"),
    "normalize_label": oracle(f", n AS (SELECT clip_id, {NORMAL} AS label FROM v_annotations) SELECT *, CASE label WHEN 'violence' THEN 1 WHEN 'non_violence' THEN 0 END AS binary FROM n"),
    "assess_annotation_issues": oracle(f", {ASSESS} SELECT clip_id, nl AS normalized_label, du AS duration_s, start_s, end_s, coalesce(array_to_string(issues, ','), '') AS issues, CASE WHEN end_s IS NOT NULL THEN greatest(end_s - du, 0) END AS end_excess FROM y"),
    "import_quarantine": oracle(f", {ASSESS}, z AS (SELECT unnest(issues) AS issue FROM y) SELECT issue, count(*) AS n FROM z GROUP BY issue"),
    "accepted_annotations": oracle(f", {ASSESS} SELECT clip_id, nl AS normalized_label, start_s, end_s FROM y WHERE len(issues) = 0"),
    "reconcile_sources": oracle(""", l AS (SELECT clip_id, collection, duration FROM v_clips WHERE duration < 150),
        r AS (SELECT clip_id, CASE WHEN clip_id % 13 = 0 THEN 'xx' ELSE collection END AS collection, CASE WHEN clip_id % 9 <> 0 THEN duration END AS duration FROM v_clips WHERE duration > 20),
        j AS (SELECT l.clip_id AS li, r.clip_id AS ri, l.collection AS lc, r.collection AS rc, l.duration AS ld, r.duration AS rd FROM l FULL JOIN r ON l.clip_id = r.clip_id),
        k AS (SELECT coalesce(li, ri) AS clip_id, li, ri, CASE WHEN li IS NOT NULL AND ri IS NOT NULL THEN concat_ws(',', CASE WHEN lc IS DISTINCT FROM rc THEN 'collection' END, CASE WHEN ld IS DISTINCT FROM rd THEN 'duration' END) ELSE '' END AS conflicts FROM j)
        SELECT clip_id, CASE WHEN ri IS NULL THEN 'left_only' WHEN li IS NULL THEN 'right_only' WHEN conflicts <> '' THEN 'conflict' ELSE 'equal' END AS state, conflicts FROM k"""),
    "historical_anti_join": oracle(" SELECT clip_id, source_video_id, sha256 FROM v_clips WHERE source_video_id NOT IN ('src1', 'src2') AND sha256 NOT IN (SELECT sha256 FROM v_clips WHERE collection = 'es')"),
    "timing_observations": oracle(""", t AS (SELECT clip_id, duration, CAST(floor(duration * 25 + clip_id % 5) AS BIGINT) AS frames FROM v_clips WHERE clip_id % 17 <> 0 AND floor(duration * 25 + clip_id % 5) > 0)
        SELECT clip_id, frames / CAST(25 AS DOUBLE) AS frame_clock, duration - frames / CAST(25 AS DOUBLE) AS difference, abs(duration - frames / CAST(25 AS DOUBLE)) > CAST(1 AS DOUBLE) / 25 + CAST(0.001 AS DOUBLE) AS flagged FROM t"""),
}
