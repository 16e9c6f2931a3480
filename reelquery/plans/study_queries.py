"""Experiment-level queries over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelquery.operators import cascade as c
from reelquery.operators import studies as e
from reelquery.plans.box_queries import NEAR
from reelquery.plans.interval_queries import PAINTED, painted
from reelquery.plans.review_queries import REASON, THRESHOLD, WINDOWS
from reelquery.plans.views import oracle, view

CLASSES, EXCLUDED = ["Normal", "click", "error", "purchase"], ["signup"]


def categories(s, d):
    return view(s, d, "v_multiclass").select("clip_id", F.expr("CASE truth WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'Normal' WHEN 3 THEN 'signup' ELSE 'other' END").alias("category"), F.expr("CAST(clip_id % 2 AS INT)").alias("binary"))


def subsets():
    return {"overall": F.lit(True), "english": F.col("collection") == "en", "even": F.col("clip_id") % 2 == 0}


def modes(s, d):
    rows = c.results(view(s, d, "v_windows"), THRESHOLD).join(view(s, d, "v_truth"), "video_id")
    both = [c.assess_review(rows, mode).select(F.lit(mode).alias("mode"), F.col("group_label").alias("truth"), F.col("suggested").alias("prediction")) for mode in ("coverage", "coverage_consistency")]
    return e.confusion_by(both[0].unionByName(both[1]), ["mode"], 6)


def arms(s, d):
    return view(s, d, "v_scored").groupBy(F.col("collection").alias("arm"), (F.col("clip_id") % 3).alias("seed")).agg(F.avg("score").alias("value"))


def examples(s, d):
    rows = view(s, d, "v_multiclass")
    return e.demo_examples(rows.select("clip_id", "truth", "prediction", ((F.col("clip_id") * 37 % 1009) / 1009).alias("confidence"), (F.col("clip_id") % 4 != 0).alias("covered"), (F.col("clip_id") % 5 + 0.5).alias("seconds")), 5)


def evidence(s, d):
    rows = e.fingerprint_evidence(fingerprints(s, d).withColumn("b", F.col("a") + 1), 26)
    return rows.select("a", F.size("matching").alias("matching"), F.aggregate("matching", F.lit(0), lambda t, m: t + m["i"] * 10 + m["j"]).alias("places"), "ordered", "distinct", "observation")


def fingerprints(s, d):
    rows = view(s, d, "v_hash").groupBy(F.expr("vec_id div 8").alias("clip_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "h"))), lambda x: x["h"]).alias("hashes"))
    return rows.select(F.col("clip_id").alias("a"), F.col("hashes").alias("ha")).join(rows.select((F.col("clip_id") - 1).alias("a"), F.col("hashes").alias("hb")), "a")


def alignments(s, d):
    return fingerprints(s, d).select("a", e.ordered_matches(F.col("ha"), F.col("hb"), 26).cast("long").alias("ordered"))


def plan(s, d):
    from reelquery.operators.intervals import grid_windows

    return e.plan_clips(grid_windows(painted(s, d), 5, 2), {"violent": 2, "normal": 3})


def actors(s, d):
    return view(s, d, "v_boxes").select("scene_id", (F.col("side") == "gt").alias("valid"), F.array("x1", "y1", "score").alias("vector"))


def tuned(s, d):
    return e.tune_threshold(view(s, d, "v_boxes"), [0.1, 0.25, 0.45, 0.75], 0.05, 0.3)


LAYERS = [([[2.0, -0.5], [-1.0, 0.75], [0.5, 0.0]], [0.0, 0.25, -0.125], True), ([[1.0, -2.0, 0.5], [0.25, 0.5, 1.0]], [0.5, -0.25], False), ([[1.5, -1.0]], [0.125], False)]

QUERIES = {
    "behavior_class": lambda s, d: categories(s, d).select("clip_id", e.behavior_class(F.col("category"), F.col("binary"), CLASSES, EXCLUDED).alias("class")),
    "subset_metrics": lambda s, d: e.subset_metrics(view(s, d, "v_scored"), subsets(), 0.5),
    "spanning_sample": lambda s, d: e.spanning_sample(view(s, d, "v_clips").withColumn("label", F.expr("CAST(clip_id % 6 AS INT)")), 40).select("clip_id", "split", "label"),
    "review_mode_confusion": modes,
    "best_arm": lambda s, d: e.best_arm(arms(s, d), "arm", "seed", "value"),
    "dense_split_counts": lambda s, d: e.dense_counts(view(s, d, "v_clips"), {"collection": ["en", "de", "fr", "es", "none"], "split": ["train", "val", "test"]}),
    "learning_curve": lambda s, d: e.learning_curve(view(s, d, "v_scored").withColumn("fraction", F.col("clip_id") % 4), "fraction", "score"),
    "demo_examples": examples,
    "ordered_fingerprint_matches": alignments,
    "fingerprint_evidence": evidence,
    "layered_head_score": lambda s, d: view(s, d, "v_segments").select("video_id", "seg", c.layered_head(F.array("score", F.lit(1.0)), LAYERS).alias("probability")),
    "family_hints": lambda s, d: view(s, d, "v_clips").select("clip_id", e.family_hint(F.expr("CASE WHEN clip_id % 2 = 0 THEN 'Snatch-1.0' ELSE 'HCI-User-Collection' END"), F.expr("CASE WHEN clip_id % 7 = 0 THEN 'True' END"), F.expr("CASE clip_id % 3 WHEN 0 THEN concat('s_', CAST(clip_id AS STRING), '_1') WHEN 1 THEN concat(CAST(clip_id AS STRING), '_2') ELSE concat('krishna-clip-', CAST(clip_id AS STRING)) END")).alias("family")),
    "interval_frame_ranges": lambda s, d: view(s, d, "v_intervals").select("video_id", "start_s", "end_s", e.frame_range(F.col("start_s"), F.col("end_s"), F.lit(29.97), F.lit(100_000)).alias("r"), e.window_frames(F.lit(12.5), 5.0).alias("window"), e.clock_text(F.col("end_s")).alias("clock")).select("video_id", "start_s", "end_s", "r.first", "r.last", "window", "clock"),
    "clip_plan": plan,
    "masked_max": lambda s, d: e.masked_max(actors(s, d)),
    "coverage_report": lambda s, d: e.coverage_by_class(view(s, d, "v_windows").withColumn("label", F.expr("CAST(video_id % 6 AS INT)"))),
    "tune_detector_threshold": tuned,
    "catalog_search": lambda s, d: e.search(view(s, d, "v_clips").select("clip_id", "source_video_id", "collection", "split"), "SRC1", {"split": "train"}),
}

RATES = """coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) AS precision, coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0) AS recall,
    coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0) AS f1"""

#: The SQL follows the definitions; it repeats no shortcut of the operators.
ORACLES = {
    "behavior_class": oracle(""", k AS (SELECT clip_id, CASE truth WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'Normal' WHEN 3 THEN 'signup' ELSE 'other' END AS category, clip_id % 2 AS b FROM v_multiclass)
        SELECT clip_id, CAST(CASE WHEN category IN ('signup', 'other') OR (category = 'Normal' AND b = 1) THEN NULL WHEN b = 0 THEN 0 WHEN category = 'click' THEN 1 ELSE 2 END AS INTEGER) AS class FROM k"""),
    "subset_metrics": oracle(f""", s AS (SELECT 'overall' AS subset, * FROM v_scored UNION ALL SELECT 'english', * FROM v_scored WHERE collection = 'en' UNION ALL SELECT 'even', * FROM v_scored WHERE clip_id % 2 = 0),
        w AS (SELECT subset, CAST(sum(CASE WHEN label = 0 AND score < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tn, CAST(sum(CASE WHEN label = 0 AND score >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
            CAST(sum(CASE WHEN label = 1 AND score < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN label = 1 AND score >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tp FROM s GROUP BY subset)
        SELECT *, {RATES}, fp / CAST(nullif(fp + tn, 0) AS DOUBLE) AS fpr FROM w"""),
    "spanning_sample": oracle(""", r AS (SELECT clip_id, split, CAST(clip_id % 6 AS INTEGER) AS label, row_number() OVER (PARTITION BY split, clip_id % 6 ORDER BY clip_id) AS i FROM v_clips WHERE split <> 'test')
        SELECT clip_id, split, label FROM r ORDER BY CASE WHEN i = 1 THEN 0 ELSE 1 END, clip_id LIMIT 40"""),
    "best_arm": oracle(""", a AS (SELECT collection AS arm, clip_id % 3 AS seed, avg(score) AS value FROM v_scored GROUP BY 1, 2)
        SELECT arm, avg(value) AS mean, count(*) AS n FROM a GROUP BY arm ORDER BY mean DESC, arm LIMIT 1"""),
    "dense_split_counts": oracle(""" SELECT collection, split, (SELECT count(*) FROM v_clips c WHERE c.collection = a.collection AND c.split = b.split) AS n
        FROM (SELECT unnest(['en', 'de', 'fr', 'es', 'none']) AS collection) a, (SELECT unnest(['train', 'val', 'test']) AS split) b"""),
    "learning_curve": oracle(" SELECT clip_id % 4 AS fraction, avg(score) AS mean, stddev_pop(score) AS std, count(score) AS seeds FROM v_scored GROUP BY 1"),
    "demo_examples": oracle(""", f AS (SELECT truth, min(clip_id) AS clip_id FROM v_multiclass WHERE clip_id % 4 <> 0 AND clip_id % 5 >= 2 GROUP BY truth),
        w AS (SELECT clip_id FROM v_multiclass WHERE truth <> prediction AND clip_id NOT IN (SELECT clip_id FROM f) ORDER BY clip_id * 37 % 1009 DESC, clip_id LIMIT 1)
        SELECT clip_id, 'first_covered_example_for_label' AS role FROM f UNION ALL SELECT clip_id, 'known_behavior_baseline_mistake' FROM w"""),
    "interval_frame_ranges": oracle(""" SELECT video_id, start_s, end_s, CAST(greatest(floor(start_s * CAST(29.97 AS DOUBLE) + 1e-8), 0) AS BIGINT) AS first, CAST(least(ceil(end_s * CAST(29.97 AS DOUBLE) - 1e-8), 100000) AS BIGINT) AS last,
        62 AS window, CAST(CAST(floor(end_s) AS BIGINT) // 60 AS VARCHAR) || ':' || lpad(CAST(CAST(floor(end_s) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS clock FROM v_intervals"""),
    "masked_max": oracle(""" SELECT scene_id, CAST(i AS INTEGER) AS dim, max(CASE i WHEN 0 THEN x1 WHEN 1 THEN y1 ELSE score END) AS x FROM v_boxes, range(0, 3) r(i) WHERE side = 'gt' GROUP BY scene_id, i"""),
    "coverage_report": oracle(" SELECT CAST(video_id % 6 AS INTEGER) AS label, count(*) AS total, CAST(sum(CASE WHEN actors > 0 THEN 1 ELSE 0 END) AS BIGINT) AS covered, sum(CASE WHEN actors = 0 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS no_actor_rate FROM v_windows GROUP BY 1"),
    # the largest matching of what a threshold keeps, over all ways to give each detection a free ground truth or none
    "tune_detector_threshold": oracle(f""", t AS (SELECT unnest([CAST(0.1 AS DOUBLE), CAST(0.25 AS DOUBLE), CAST(0.45 AS DOUBLE), CAST(0.75 AS DOUBLE)]) AS threshold), {NEAR},
        kd AS (SELECT threshold, o.*, dense_rank() OVER (PARTITION BY threshold, o.scene_id ORDER BY det_id) AS i FROM o JOIN v_boxes x ON x.scene_id = o.scene_id AND x.box_id = det_id JOIN t ON x.score >= threshold),
        st AS (SELECT DISTINCT threshold, scene_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used FROM kd
            UNION SELECT st.threshold, st.scene_id, st.i + 1, st.used | g.bit FROM st JOIN (SELECT threshold, scene_id, i, CAST(1 AS BIGINT) << gt_id AS bit FROM kd UNION SELECT threshold, scene_id, i, 0 FROM kd) g
                ON g.threshold = st.threshold AND g.scene_id = st.scene_id AND g.i = st.i + 1 AND st.used & g.bit = 0),
        b AS (SELECT threshold, scene_id, max(bit_count(used)) AS tp FROM st GROUP BY 1, 2),
        n AS (SELECT threshold, (SELECT coalesce(CAST(sum(b.tp) AS BIGINT), 0) FROM b WHERE b.threshold = t.threshold) AS tp, (SELECT count(*) FROM v_boxes WHERE side = 'det' AND score >= t.threshold) AS det, (SELECT count(*) FROM v_boxes WHERE side = 'gt') AS gt FROM t),
        k AS (SELECT threshold, tp, det - tp AS fp, gt - tp AS fn FROM n), x AS (SELECT *, {RATES} FROM k)
        SELECT * FROM x WHERE recall >= 0.05 ORDER BY f1 DESC, recall DESC, threshold DESC LIMIT 1"""),
    "ordered_fingerprint_matches": oracle(""", f AS (SELECT vec_id // 8 AS clip, vec_id % 8 AS i, h FROM v_hash), pr AS (SELECT DISTINCT a.clip AS a FROM f a JOIN f b ON b.clip = a.clip + 1),
        mt AS (SELECT a.clip AS a, a.i, b.i AS j FROM f a JOIN f b ON b.clip = a.clip + 1 AND bit_count(xor(a.h, b.h)) <= 26),
        ch AS (SELECT a, i, j, 1 AS n FROM mt UNION SELECT mt.a, mt.i, mt.j, ch.n + 1 FROM ch JOIN mt ON mt.a = ch.a AND mt.i > ch.i AND mt.j > ch.j)
        SELECT pr.a, coalesce(max(n), 0) AS ordered FROM pr LEFT JOIN ch ON ch.a = pr.a GROUP BY pr.a"""),
    "fingerprint_evidence": oracle(""", f AS (SELECT vec_id // 8 AS clip, vec_id % 8 AS i, h FROM v_hash), pr AS (SELECT DISTINCT a.clip AS a FROM f a JOIN f b ON b.clip = a.clip + 1),
        mt AS (SELECT a.clip AS a, a.i, b.i AS j FROM f a JOIN f b ON b.clip = a.clip + 1 AND bit_count(xor(a.h, b.h)) <= 26),
        ch AS (SELECT a, i, j, 1 AS n FROM mt UNION SELECT mt.a, mt.i, mt.j, ch.n + 1 FROM ch JOIN mt ON mt.a = ch.a AND mt.i > ch.i AND mt.j > ch.j),
        ds AS (SELECT clip, count(DISTINCT h) AS n FROM f GROUP BY clip), lc AS (SELECT a, max(n) AS n FROM ch GROUP BY a), ms AS (SELECT a, count(*) AS n, sum(i * 10 + j) AS places FROM mt GROUP BY a),
        z AS (SELECT pr.a, coalesce(ms.n, 0) AS matching, CAST(coalesce(places, 0) AS BIGINT) AS places, coalesce(lc.n, 0) AS ordered, least(x.n, y.n) AS dist FROM pr LEFT JOIN ms ON ms.a = pr.a LEFT JOIN lc ON lc.a = pr.a JOIN ds x ON x.clip = pr.a JOIN ds y ON y.clip = pr.a + 1)
        SELECT a, matching, places, ordered, dist AS "distinct", CASE WHEN ordered >= 3 AND dist >= 3 THEN 'temporal_visual_candidate' ELSE 'ambiguous_visual_similarity' END AS observation FROM z"""),
    "layered_head_score": oracle(""", l1 AS (SELECT video_id, seg, greatest(2 * score - CAST(0.5 AS DOUBLE), 0) AS a, greatest(CAST(1 AS DOUBLE) - score, 0) AS b, greatest(score / 2 - CAST(0.125 AS DOUBLE), 0) AS c FROM v_segments),
        l2 AS (SELECT video_id, seg, a - 2 * b + c / 2 + CAST(0.5 AS DOUBLE) AS p, a / 4 + b / 2 + c - CAST(0.25 AS DOUBLE) AS q FROM l1) SELECT video_id, seg, 1 / (1 + exp(-(CAST(1.5 AS DOUBLE) * p - q + CAST(0.125 AS DOUBLE)))) AS probability FROM l2"""),
    "family_hints": oracle(""" SELECT clip_id, CASE WHEN clip_id % 7 = 0 THEN NULL WHEN clip_id % 2 = 0 THEN CASE clip_id % 3 WHEN 0 THEN 's_' || CAST(clip_id AS VARCHAR) || '_1' WHEN 1 THEN CAST(clip_id AS VARCHAR) END
        WHEN clip_id % 3 = 2 THEN 'krishna-clip-series' END AS family FROM v_clips"""),
    "clip_plan": oracle(f""", {PAINTED}, gs AS (SELECT video_id, frame // 5 * 5 AS start, min(label) AS least FROM lab GROUP BY 1, 2 HAVING count(*) = 5),
        gn AS (SELECT gs.*, (SELECT max(label) FROM lab WHERE lab.video_id = gs.video_id AND frame >= start - 2 AND frame < start + 7) AS near FROM gs),
        gk AS (SELECT video_id, start, CASE WHEN least = 1 THEN 'violent' ELSE 'normal' END AS kind FROM gn WHERE least = 1 OR near = 0),
        gi AS (SELECT *, row_number() OVER (PARTITION BY video_id, kind ORDER BY start) - 1 AS i, count(*) OVER (PARTITION BY video_id, kind) AS n, CASE kind WHEN 'violent' THEN 2 ELSE 3 END AS most FROM gk)
        SELECT video_id, start, kind, CAST(CASE kind WHEN 'violent' THEN 1 ELSE 0 END AS INTEGER) AS label FROM gi WHERE n <= most OR i IN (n // (2 * most), 3 * n // (2 * most), CASE WHEN most = 3 THEN 5 * n // 6 ELSE -1 END)"""),
    "review_mode_confusion": oracle(f""", {WINDOWS}, a AS (SELECT 'coverage' AS mode, video_id, {REASON.format(more='')} AS reason, chosen FROM r UNION ALL SELECT 'coverage_consistency', video_id, {REASON.format(more="WHEN votes > 1 THEN 'cross_window_class_disagreement'")}, chosen FROM r),
        p AS (SELECT mode, group_label AS truth, CASE WHEN reason LIKE 'covered_%' THEN chosen END AS prediction FROM a JOIN v_truth t ON t.video_id = a.video_id)
        SELECT mode, truth, {', '.join(f"count(*) FILTER (WHERE prediction = {i}) AS predicted_{i}" for i in range(6))}, count(*) FILTER (WHERE prediction IS NULL) AS abstained FROM p GROUP BY mode, truth"""),
    "catalog_search": oracle(""" SELECT clip_id, source_video_id, collection, split FROM v_clips WHERE split = 'train' AND contains(lower(source_video_id), 'src1')"""),
}
