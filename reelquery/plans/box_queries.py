"""Box, resampling and identity queries over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelquery.operators import geometry as g
from reelquery.operators import integrity as n
from reelquery.operators import resampling as r
from reelquery.plans.views import oracle, view


def boxes(s, d):
    return view(s, d, "v_boxes")


def matches(s, d):
    return g.match_boxes(boxes(s, d), 0.3)


def match_totals(s, d):
    """Several matchings of a scene can be best; what they have in common is how many pairs they have, and their total."""
    return matches(s, d).groupBy("scene_id").agg(F.count("*").alias("pairs"), F.sum("iou").alias("total_iou"))


def labels_given(s, d):
    labels = boxes(s, d).where("side = 'gt'").select("scene_id", F.col("box_id").alias("gt_id"), F.expr("CAST(scene_id % 6 AS INT)").alias("label"))
    return g.transferred_labels(boxes(s, d), matches(s, d), labels).groupBy("scene_id", "label").agg(F.count("*").alias("n"))


def filtered(s, d):
    return g.staged_filter(boxes(s, d).where("side = 'det'"), 60.0, 40.0, 0.2, 12.0)


def bootstrap(s, d):
    return r.cluster_bootstrap(view(s, d, "v_scored"), "source_video_id", F.when((F.col("score") >= 0.5) & (F.col("label") == 1), 1).otherwise(0), F.col("label"), 200, 7)


QUERIES = {
    "pairwise_iou": lambda s, d: g.pairwise_iou(boxes(s, d)),
    "iou_match": match_totals,
    "detection_micro_metrics": lambda s, d: g.detection_metrics(boxes(s, d), matches(s, d)),
    "transferred_labels": labels_given,
    "staged_filter": lambda s, d: filtered(s, d).select("scene_id", "box_id", "x1", "y1", "x2", "y2", "reason"),
    "nms": lambda s, d: g.suppress(filtered(s, d).where("reason IS NULL").drop("reason", "side"), 0.5, 5),
    "canonical_order": lambda s, d: boxes(s, d).select("scene_id", "box_id", F.row_number().over(g.canonical_order()).alias("rank")),
    "box_normalize": lambda s, d: g.scaled(boxes(s, d), 1 / 64, 1 / 32).select("scene_id", "box_id", "x1", "y1", "x2", "y2"),
    "cluster_bootstrap_ci": bootstrap,
    "canonical_content_hash": lambda s, d: n.content_hash(view(s, d, "v_clips"), ["split", "clip_id", "collection"]).select("clip_id", "content_hash"),
    "population_hash": lambda s, d: n.population_hash(view(s, d, "v_clips"), "sha256"),
}

IOU = """pr AS (SELECT a.scene_id, a.box_id AS gt_id, b.box_id AS det_id, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i,
        (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS u FROM v_boxes a JOIN v_boxes b ON a.scene_id = b.scene_id AND a.side = 'gt' AND b.side = 'det')"""
NEAR = f"{IOU}, o AS (SELECT scene_id, gt_id, det_id, i / (u - i) AS iou FROM pr WHERE i / nullif(u - i, 0) >= CAST(0.3 AS DOUBLE))"
#: Every way to give each detection a ground truth that is free or none; the best has the most pairs, then the highest total.
MATCHED = f"""{NEAR}, op AS (SELECT scene_id, gt_id, det_id, iou, dense_rank() OVER (PARTITION BY scene_id ORDER BY det_id) AS i FROM o),
    wy AS (SELECT *, CAST(1 AS BIGINT) << gt_id AS bit FROM op UNION ALL SELECT DISTINCT scene_id, CAST(NULL AS BIGINT), det_id, CAST(0 AS DOUBLE), i, CAST(0 AS BIGINT) FROM op),
    st AS (SELECT DISTINCT scene_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, CAST(0 AS DOUBLE) AS total, CAST([] AS STRUCT(gt_id BIGINT, det_id BIGINT, iou DOUBLE)[]) AS pairs FROM op
        UNION ALL SELECT st.scene_id, wy.i, st.used | wy.bit, st.total + wy.iou, CASE WHEN wy.gt_id IS NULL THEN st.pairs ELSE list_append(st.pairs, struct_pack(gt_id := wy.gt_id, det_id := wy.det_id, iou := wy.iou)) END
            FROM st JOIN wy ON wy.scene_id = st.scene_id AND wy.i = st.i + 1 AND st.used & wy.bit = 0),
    bs AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY bit_count(used) DESC, round(total, 9) DESC, list_transform(pairs, lambda p: p.gt_id)) AS best FROM st),
    mt AS (SELECT scene_id, p.gt_id, p.det_id, p.iou FROM (SELECT scene_id, unnest(pairs) AS p FROM bs WHERE best = 1))"""
FILTERED = """c AS (SELECT scene_id, box_id, score, greatest(least(x1, 60), 0) AS x1, greatest(least(y1, 40), 0) AS y1, greatest(least(x2, 60), 0) AS x2, greatest(least(y2, 40), 0) AS y2, x2 > x1 AND y2 > y1 AS valid FROM v_boxes WHERE side = 'det'),
    f AS (SELECT scene_id, box_id, x1, y1, x2, y2, CASE WHEN score < CAST(0.2 AS DOUBLE) THEN 'low_confidence' WHEN NOT valid THEN 'invalid_geometry' WHEN x2 <= x1 OR y2 <= y1 THEN 'outside_image' WHEN x2 - x1 < 12 OR y2 - y1 < 12 THEN 'too_small' END AS reason FROM c)"""

OVERLAP = "(greatest(least(k.x2, b.x2) - greatest(k.x1, b.x1), 0) * greatest(least(k.y2, b.y2) - greatest(k.y1, b.y1), 0))"

ORACLES = {
    "pairwise_iou": oracle(f", {IOU} SELECT scene_id, gt_id, det_id, coalesce(i / nullif(u - i, 0), 0) AS iou FROM pr"),
    "iou_match": oracle(f", {MATCHED} SELECT scene_id, count(*) AS pairs, sum(iou) AS total_iou FROM mt GROUP BY scene_id"),
    "detection_micro_metrics": oracle(f""", {MATCHED}, n AS (SELECT (SELECT count(*) FROM mt) AS matched, (SELECT avg(iou) FROM mt) AS mean_iou, count(*) FILTER (WHERE side = 'gt') AS gt, count(*) FILTER (WHERE side = 'det') AS det FROM v_boxes)
        SELECT matched, gt - matched AS missed, det - matched AS extra, matched / CAST(nullif(det, 0) AS DOUBLE) AS precision, matched / CAST(nullif(gt, 0) AS DOUBLE) AS recall, 2 * matched / CAST(nullif(gt + det, 0) AS DOUBLE) AS f1, mean_iou FROM n"""),
    "transferred_labels": oracle(f", {MATCHED} SELECT b.scene_id, CAST(CASE WHEN gt_id IS NULL THEN -100 ELSE b.scene_id % 6 END AS INTEGER) AS label, count(*) AS n FROM v_boxes b LEFT JOIN mt ON mt.scene_id = b.scene_id AND det_id = box_id WHERE side = 'det' GROUP BY 1, 2"),
    "nms": oracle(f""", {FILTERED}, b AS (SELECT f.scene_id, f.box_id, f.x1, f.y1, f.x2, f.y2, c.score, row_number() OVER (PARTITION BY f.scene_id ORDER BY c.score DESC, f.x1, f.y1, f.x2, f.y2, f.box_id) AS i FROM f JOIN c ON c.scene_id = f.scene_id AND c.box_id = f.box_id WHERE reason IS NULL),
        kp AS (SELECT scene_id, i, [struct_pack(box_id := box_id, x1 := x1, y1 := y1, x2 := x2, y2 := y2, score := score)] AS kept FROM b WHERE i = 1
            UNION ALL SELECT b.scene_id, b.i, CASE WHEN len(list_filter(kept, lambda k: {OVERLAP} > CAST(0.5 AS DOUBLE) * ((k.x2 - k.x1) * (k.y2 - k.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {OVERLAP}))) > 0 THEN kept
                ELSE list_append(kept, struct_pack(box_id := b.box_id, x1 := b.x1, y1 := b.y1, x2 := b.x2, y2 := b.y2, score := b.score)) END FROM kp JOIN b ON b.scene_id = kp.scene_id AND b.i = kp.i + 1),
        ls AS (SELECT scene_id, arg_max(kept, i) AS kept FROM kp GROUP BY scene_id)
        SELECT scene_id, kept[r + 1].box_id AS box_id, kept[r + 1].x1 AS x1, kept[r + 1].y1 AS y1, kept[r + 1].x2 AS x2, kept[r + 1].y2 AS y2, kept[r + 1].score AS score, CAST(r AS INTEGER) AS keep_rank FROM ls, range(0, 5) q(r) WHERE r < len(kept)"""),
    "population_hash": oracle(""", d0 AS (SELECT sha256 AS key, count(*) AS n FROM v_clips GROUP BY 1), d1 AS (SELECT key, sha256(key || ':' || CAST(n AS VARCHAR)) AS digest, n FROM d0),
        d2 AS (SELECT substr(key, 1, 4) AS key, sha256(string_agg(key || digest, '' ORDER BY key || digest)) AS digest, sum(n) AS n FROM d1 GROUP BY 1), d3 AS (SELECT substr(key, 1, 2) AS key, sha256(string_agg(key || digest, '' ORDER BY key || digest)) AS digest, sum(n) AS n FROM d2 GROUP BY 1)
        SELECT CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(key || digest, '' ORDER BY key || digest)) AS population FROM d3"""),
    "staged_filter": oracle(f", {FILTERED} SELECT * FROM f"),
    "canonical_order": oracle(" SELECT scene_id, box_id, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY (x1 + x2) / 2, (y1 + y2) / 2, x1, y1, x2, y2, score DESC, box_id) AS INTEGER) AS rank FROM v_boxes"),
    "box_normalize": oracle(" SELECT scene_id, box_id, x1 * CAST(0.015625 AS DOUBLE) AS x1, y1 * CAST(0.03125 AS DOUBLE) AS y1, x2 * CAST(0.015625 AS DOUBLE) AS x2, y2 * CAST(0.03125 AS DOUBLE) AS y2 FROM v_boxes"),
    "cluster_bootstrap_ci": oracle(""", s AS (SELECT source_video_id, CAST(sum(CASE WHEN score >= 0.5 AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS num, CAST(sum(label) AS BIGINT) AS den FROM v_scored GROUP BY 1),
        i AS (SELECT *, row_number() OVER (ORDER BY substr(md5(source_video_id), 1, 2), source_video_id) - 1 AS idx, count(*) OVER () AS n FROM s),
        d AS (SELECT b AS replicate, CAST('0x' || substr(md5('7:' || CAST(b AS VARCHAR) || ':' || CAST(idx AS VARCHAR)), 1, 8) AS BIGINT) % n AS pick FROM i, range(0, 200) r(b)),
        v AS (SELECT replicate, sum(num) / CAST(nullif(sum(den), 0) AS DOUBLE) AS value FROM d JOIN i ON idx = pick GROUP BY 1)
        SELECT (SELECT sum(num) / CAST(sum(den) AS DOUBLE) FROM s) AS estimate, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high, (SELECT count(*) FROM s) AS clusters FROM v"""),
    "canonical_content_hash": oracle(""" SELECT clip_id, sha256('{"clip_id":' || CAST(clip_id AS VARCHAR) || ',"collection":"' || collection || '","split":"' || split || '"}') AS content_hash FROM v_clips"""),
}
