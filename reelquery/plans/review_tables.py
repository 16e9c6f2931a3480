"""Assignments, review queues, ranked examples, cached results and bootstraps over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelquery.operators import assignment as a
from reelquery.operators import cascade as c
from reelquery.operators import resampling as r
from reelquery.operators import review as v
from reelquery.plans.graph_queries import ASSESS, SPLIT, assessed, class_groups
from reelquery.plans.review_queries import REASON, TAGGED, WINDOWS, judged
from reelquery.plans.views import oracle, view

RATIOS = {"train": 0.7, "val": 0.15, "test": 0.15}
TRIALS, STRATIFIED_TRIALS, REPLICATES = 2048, 40, 50


def proposed(s, d):
    clips = view(s, d, "v_scored").select("clip_id", "collection", "label")
    near = clips.where("clip_id % 5 < 2").select(F.col("clip_id").alias("a"), (F.col("clip_id") + 7).alias("b")).join(clips.select(F.col("clip_id").alias("b")), "b").select("a", "b")
    return a.proposal_counts(a.proposal(clips, near, 7, RATIOS, TRIALS))


def stratified_groups(s, d):
    rows = view(s, d, "v_scored").groupBy(F.col("source_video_id").alias("group_id"), "collection").agg(F.count("*").alias("n"), F.sum("label").alias("positives"))
    own = rows.groupBy("group_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("collection", "n")))).alias("strata"), F.sum("positives").alias("positives"))
    return own.select("group_id", (F.col("group_id") == "src3").alias("pinned"), "strata", F.create_map(F.lit("positive"), F.col("positives")).alias("having"))


def stratified(s, d):
    return a.assign_stratified(stratified_groups(s, d), 7, RATIOS, {"positive": 1}, STRATIFIED_TRIALS).select("group_id", "split", "cost")


def readiness(s, d):
    rows = assessed(s, d)
    at = F.col("clip_id")
    return rows.select("clip_id", (at % 4).cast("string").alias("collection"), "normalized_label", "issues", (at % 7 != 3).alias("readable"), (at % 9 == 5).alias("conflict"), (at % 8 == 0).alias("reserved"), F.when(at % 3 == 0, "2024").otherwise(" ").alias("reviewed_at"))


def queue(s, d):
    return v.review_queue(readiness(s, d), readiness(s, d).where("clip_id % 25 = 1").select(F.col("clip_id").alias("a"), (F.col("clip_id") + 1).alias("b")))


def requests(s, d):
    clips = view(s, d, "v_clips")
    asked = clips.select(F.col("clip_id").alias("request_id"), F.expr("CASE WHEN clip_id % 4 = 0 THEN sha256 WHEN clip_id % 4 = 1 THEN 'old' END").alias("expected"), "sha256")
    cache = clips.groupBy("sha256").agg(F.min("clip_id").alias("id")).where("id % 5 <> 2").select("sha256", F.expr("CAST(CASE WHEN id % 7 = 0 THEN 2 ELSE 1 END AS INT)").alias("schema_version"), F.expr("CASE WHEN id % 6 = 0 THEN 'other' ELSE 'model' END").alias("provenance"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("result"))
    return v.cached_results(asked, cache, "model")


def modes(s, d):
    rows = judged(s, d)
    both = [c.assess_review(rows, mode).select("source_video_id", F.lit(mode).alias("mode"), F.col("group_label").alias("truth"), F.col("suggested").alias("prediction")) for mode in ("coverage", "coverage_consistency")]
    return both[0].unionByName(both[1])


def two_models(s, d):
    return view(s, d, "v_scored").withColumn("other", F.expr("CAST(clip_id * 37 % 1000 AS DOUBLE) / 1000 + 0.2D * label"))


def tagged_by_class(s, d):
    rows = c.outcomes(judged(s, d))
    return rows.select("group_label", F.explode("outcomes").alias("outcome")).groupBy("group_label", "outcome").agg(F.count("*").alias("n"))


def arms():
    return {"all": F.lit(True), "few": ~F.col("source_video_id").isin("src1", "src2", "src3")}


QUERIES = {
    "assign_groups": lambda s, d: a.assign_groups(class_groups(s, d), 7, RATIOS, TRIALS),
    "assign_stratified": stratified,
    "proposed_split": proposed,
    "review_queue": lambda s, d: queue(s, d).withColumn("flags", F.array_join("flags", ";")),
    "screening_counts": lambda s, d: v.screening_counts(queue(s, d), readiness(s, d)),
    "name_families": lambda s, d: v.name_families(view(s, d, "v_clips"), F.expr("CASE WHEN clip_id % 3 = 0 THEN concat('f', CAST(clip_id % 40 AS STRING)) WHEN clip_id % 3 = 1 THEN '' END")),
    "ranked_examples": lambda s, d: v.ranked_examples(view(s, d, "v_scored"), 0.95),
    "cached_results": requests,
    "training_schedule": lambda s, d: v.schedule(view(s, d, "v_clips"), arms(), 8),
    "audit_tail": lambda s, d: v.audit_tail(s.read.parquet(f"{d}/events.parquet").select("event_id", "event_type"), 50),
    "review_mode_deltas": lambda s, d: v.mode_deltas(modes(s, d), "coverage"),
    "review_mode_bootstrap": lambda s, d: r.mode_bootstrap(modes(s, d), "coverage", REPLICATES, 7),
    "paired_pr_difference": lambda s, d: r.paired_pr_difference(two_models(s, d), "clip_id", "score", "other", REPLICATES, 7),
    "within_source_bootstrap": lambda s, d: r.within_source_bootstrap(two_models(s, d), "score", "other", REPLICATES, 7),
    "failure_tags_by_class": tagged_by_class,
}

ASSIGNED = f"""u AS (SELECT t AS trial, g.source_video_id AS own, CAST(t AS VARCHAR) || ':' || g.source_video_id AS source_video_id, pos, neg FROM {{groups}} g, range(0, {TRIALS}) q(t)), {SPLIT.format(w='PARTITION BY trial')},
    s AS (SELECT *, CASE WHEN rank < c0 THEN 'train' WHEN rank < c0 + c1 THEN 'val' ELSE 'test' END AS split FROM q),
    h AS (SELECT trial, split, sum(pos) AS p, sum(neg) AS g, CASE split WHEN 'train' THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.15 AS DOUBLE) END AS want FROM s GROUP BY trial, split),
    b AS (SELECT trial, round(sum(pow(p / CAST((SELECT sum(pos) FROM {{groups}}) AS DOUBLE) - want, 2) + pow(g / CAST((SELECT sum(neg) FROM {{groups}}) AS DOUBLE) - want, 2)), 12) AS cost FROM h GROUP BY trial HAVING min(least(p, g)) > 0 ORDER BY cost, trial LIMIT 1)"""
GROUPS = "cg AS (SELECT source_video_id, sum(label) AS pos, sum(1 - label) AS neg FROM v_scored GROUP BY 1)"
QUEUE = f"""{ASSESS}, rd AS (SELECT clip_id, CAST(clip_id % 4 AS VARCHAR) AS collection, nl, issues, clip_id % 7 <> 3 AS readable, clip_id % 9 = 5 AS conflict, clip_id % 25 IN (1, 2) AS pair, len(issues) > 0 OR clip_id % 7 = 3 AS hold FROM y),
    fl AS (SELECT *, NOT hold AND coalesce(nl = 'violence', FALSE) AS second FROM rd),
    qu AS (SELECT clip_id, collection, CASE WHEN hold THEN 'quarantine' ELSE 'candidate_only_not_approved' END AS quality_status, CASE WHEN hold OR pair OR second OR conflict THEN 'first' ELSE 'source_evidence' END AS priority,
        list_sort(list_distinct(list_filter(['unverified_source_incident_and_overlap', CASE WHEN NOT readable THEN 'strict_loader_media_hold' END, CASE WHEN second THEN 'candidate_positive_second_look' END, CASE WHEN pair THEN 'duplicate_or_visual_candidate_review' END,
            CASE WHEN conflict THEN 'annotation_catalog_status_or_source_conflict' END, CASE WHEN clip_id % 8 = 0 THEN 'municipal_reservation_keep_out_of_optimization' END, CASE WHEN clip_id % 3 <> 0 THEN 'review_timestamp_missing' END] || issues, lambda x: x IS NOT NULL))) AS flags FROM fl)"""
MODES = f"""{WINDOWS}, am AS (SELECT 'coverage' AS mode, video_id, {REASON.format(more='')} AS reason, chosen FROM r UNION ALL SELECT 'coverage_consistency', video_id, {REASON.format(more="WHEN votes > 1 THEN 'cross_window_class_disagreement'")}, chosen FROM r),
    mo AS (SELECT t.source_video_id, mode, group_label AS truth, CASE WHEN reason LIKE 'covered_%' THEN chosen END AS prediction FROM am JOIN v_truth t ON t.video_id = am.video_id)"""
DRAWN = f"""ix AS (SELECT *, row_number() OVER (ORDER BY substr(md5(source_video_id), 1, 2), source_video_id) - 1 AS idx, count(*) OVER () AS n FROM so),
    dw AS (SELECT b AS replicate, CAST('0x' || substr(md5('7:' || CAST(b AS VARCHAR) || ':' || CAST(idx AS VARCHAR)), 1, 8) AS BIGINT) % n AS pick FROM ix, range(0, {REPLICATES}) q(b))"""
ENDS = "quantile_cont({x}, 0.025) AS low, quantile_cont({x}, 0.5) AS median, quantile_cont({x}, 0.975) AS high, count({x}) AS valid"
MODELS = "tm AS (SELECT clip_id, source_video_id, label, score, CAST(clip_id * 37 % 1000 AS DOUBLE) / 1000 + CAST(0.2 AS DOUBLE) * label AS other FROM v_scored)"
SOURCE_AUC = "(sum(CASE WHEN label = 1 THEN rk END) - CAST(sum(label) AS DOUBLE) * (sum(label) + 1) / 2) / nullif(CAST(sum(label) AS DOUBLE) * sum(1 - label), 0)"

ORACLES = {
    "assign_groups": oracle(f", {GROUPS}, {ASSIGNED.format(groups='cg')} SELECT own AS group_id, split FROM s JOIN b ON b.trial = s.trial"),
    "proposed_split": oracle(f""", e0 AS (SELECT a.clip_id AS x, b.clip_id AS y FROM v_scored a JOIN v_scored b ON b.clip_id = a.clip_id + 7 WHERE a.clip_id % 5 < 2), e AS (SELECT x, y FROM e0 UNION SELECT y, x FROM e0),
        cc AS (SELECT clip_id AS id, clip_id AS reached FROM v_scored UNION SELECT cc.id, e.y FROM cc JOIN e ON e.x = cc.reached), ro AS (SELECT id, min(reached) AS root FROM cc GROUP BY id),
        pg AS (SELECT CAST(root AS VARCHAR) AS source_video_id, sum(label) AS pos, sum(1 - label) AS neg FROM ro JOIN v_scored ON clip_id = id GROUP BY 1), {ASSIGNED.format(groups='pg')}
        SELECT split, CAST(sum(pos + neg) AS BIGINT) AS clips, CAST(sum(pos) AS BIGINT) AS violence, CAST(sum(neg) AS BIGINT) AS non_violence, count(*) AS groups FROM s JOIN b ON b.trial = s.trial GROUP BY split"""),
    # one group at a time, in each trial's order: fill holds the clips of 3 splits by 4 strata
    "assign_stratified": oracle(f""", sn AS (SELECT source_video_id AS g, collection, count(*) AS n, sum(label) AS pos FROM v_scored GROUP BY 1, 2), ks AS (SELECT list(DISTINCT collection ORDER BY collection) AS names FROM sn),
        gv AS (SELECT g, sum(pos) AS pos, list_transform(any_value(names), lambda k: CAST(coalesce(list_sum(list_filter(list_transform(list(struct_pack(c := collection, n := n)), lambda x: CASE WHEN x.c = k THEN x.n END), lambda x: x IS NOT NULL)), 0) AS DOUBLE)) AS v FROM sn, ks GROUP BY g),
        tt AS (SELECT list_transform(any_value(names), lambda k: CAST(list_sum(list_filter(list_transform(list(struct_pack(c := collection, n := n)), lambda x: CASE WHEN x.c = k THEN x.n END), lambda x: x IS NOT NULL)) AS DOUBLE)) AS t FROM sn, ks),
        od AS (SELECT q AS trial, g, v, pos, t, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN g = 'src3' THEN 0 ELSE 1 END, md5('7:' || CAST(q AS VARCHAR) || ':' || g), g) AS i FROM gv, tt, range(0, {STRATIFIED_TRIALS}) r(q)),
        pl AS (SELECT DISTINCT trial, CAST(0 AS BIGINT) AS i, list_transform(range(0, 3 * len(t)), lambda x: CAST(0 AS DOUBLE)) AS fill, CAST([] AS STRUCT(g VARCHAR, target BIGINT, pos BIGINT)[]) AS chosen FROM od
            UNION ALL SELECT trial, i, list_transform(range(0, len(fill)), lambda x: fill[x + 1] + CASE WHEN x // len(t) = target - 1 THEN v[x % len(t) + 1] ELSE 0 END), list_append(chosen, struct_pack(g := g, target := target, pos := CAST(pos AS BIGINT)))
            FROM (SELECT od.trial, od.i, od.g, od.v, od.t, od.pos, pl.fill, pl.chosen, CASE WHEN od.g = 'src3' THEN CAST(1 AS BIGINT) ELSE list_sort(list_transform(CAST([1, 2, 3] AS BIGINT[]), lambda a: struct_pack(
                    change := round(list_sum(list_transform(range(1, len(od.t) + 1), lambda b: pow((pl.fill[(a - 1) * len(od.t) + b] + od.v[b]) / od.t[b] - CAST([0.7, 0.15, 0.15] AS DOUBLE[])[a], 2) - pow(pl.fill[(a - 1) * len(od.t) + b] / od.t[b] - CAST([0.7, 0.15, 0.15] AS DOUBLE[])[a], 2))), 12),
                    mark := md5('7:' || CAST(od.trial AS VARCHAR) || ':' || od.g || ':' || ['train', 'val', 'test'][a]), target := a)))[1].target END AS target
                FROM pl JOIN od ON od.trial = pl.trial AND od.i = pl.i + 1)),
        en AS (SELECT pl.*, round(list_sum(list_transform(range(0, len(fill)), lambda x: pow(fill[x + 1] / t[x % len(t) + 1] - CAST([0.7, 0.15, 0.15] AS DOUBLE[])[x // len(t) + 1], 2))), 12) AS cost FROM pl, tt WHERE i = (SELECT count(*) FROM gv)),
        ok AS (SELECT * FROM en WHERE list_sum(list_transform(chosen, lambda x: CASE WHEN x.target = 2 THEN x.pos ELSE 0 END)) >= 1 AND list_sum(list_transform(chosen, lambda x: CASE WHEN x.target = 3 THEN x.pos ELSE 0 END)) >= 1 ORDER BY cost, trial LIMIT 1)
        SELECT x.g AS group_id, ['train', 'val', 'test'][x.target] AS split, cost FROM (SELECT unnest(chosen) AS x, cost FROM ok)"""),
    "review_queue": oracle(f", {QUEUE} SELECT clip_id, collection, quality_status, priority, array_to_string(flags, ';') AS flags, row_number() OVER (ORDER BY priority, collection, clip_id) AS turn FROM qu"),
    "screening_counts": oracle(f""", {QUEUE} SELECT 'flag' AS kind, key, count(*) AS n FROM (SELECT unnest(flags) AS key FROM qu) GROUP BY key UNION ALL SELECT 'priority', priority, count(*) FROM qu GROUP BY priority
        UNION ALL SELECT 'label', collection || '/' || coalesce(nl, 'missing'), count(*) FROM rd GROUP BY 2"""),
    "name_families": oracle(" SELECT collection, 'f' || CAST(clip_id % 40 AS VARCHAR) AS hint, count(*) AS clips, min(clip_id) AS first FROM v_clips WHERE clip_id % 3 = 0 GROUP BY 1, 2 HAVING count(*) > 1"),
    "ranked_examples": oracle(""", x AS (SELECT clip_id, label, score, score >= CAST(0.95 AS DOUBLE) AS high FROM v_scored),
        o AS (SELECT 'correct' AS role, 0 AS stage, -score AS value, clip_id FROM (SELECT * FROM x WHERE label = 1 AND high ORDER BY -score, clip_id LIMIT 5) UNION ALL SELECT 'correct', 1, score, clip_id FROM x WHERE label = 0
            UNION ALL SELECT 'failure', 0, -score, clip_id FROM x WHERE label = 1 AND NOT high UNION ALL SELECT 'failure', 1, -score, clip_id FROM x WHERE label = 0),
        n AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY stage, value, clip_id) AS turn FROM o) SELECT role, CAST(turn AS INTEGER) AS turn, clip_id FROM n WHERE stage = 0 OR turn <= 5"""),
    "cached_results": oracle(""", ch AS (SELECT sha256, min(clip_id) AS id FROM v_clips GROUP BY 1 HAVING min(clip_id) % 5 <> 2),
        z AS (SELECT clip_id, id, CASE WHEN clip_id % 4 = 1 THEN 'content_changed' WHEN id IS NULL THEN 'miss' WHEN id % 7 = 0 THEN 'unsupported_version' WHEN id % 6 = 0 THEN 'other_provenance' ELSE 'hit' END AS outcome FROM v_clips LEFT JOIN ch ON ch.sha256 = v_clips.sha256)
        SELECT clip_id AS request_id, outcome, CASE WHEN outcome = 'hit' THEN 'r' || CAST(id AS VARCHAR) END AS result FROM z"""),
    "training_schedule": oracle(""", ar AS (SELECT 'all' AS arm, count(*) AS clips FROM v_clips WHERE split = 'train' UNION ALL SELECT 'few', count(*) FROM v_clips WHERE split = 'train' AND source_video_id NOT IN ('src1', 'src2', 'src3')),
        st AS (SELECT *, CAST(ceil(2 * clips / CAST(800 AS DOUBLE)) * 100 AS BIGINT) AS steps FROM ar) SELECT *, CAST(round_even(steps / CAST(60 AS DOUBLE), 0) * 10 AS BIGINT) AS warmup FROM st"""),
    "audit_tail": "SELECT event_id, event_type, CAST(row_number() OVER (ORDER BY event_id DESC) AS INTEGER) AS turn FROM (SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 50)",
    "review_mode_deltas": oracle(f""", {MODES}, p AS (SELECT mode, count(*) AS clips, count(prediction) / CAST(count(*) AS DOUBLE) AS coverage, sum(CASE WHEN prediction = truth THEN 1 ELSE 0 END) / CAST(nullif(count(prediction), 0) AS DOUBLE) AS accuracy,
            sum(CASE WHEN prediction = truth THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS full_correct FROM mo GROUP BY mode), b AS (SELECT * FROM p WHERE mode = 'coverage')
        SELECT p.*, p.coverage - b.coverage AS coverage_delta, p.accuracy - b.accuracy AS accuracy_delta, p.full_correct - b.full_correct AS full_correct_delta FROM p, b"""),
    "review_mode_bootstrap": oracle(f""", {MODES}, so AS (SELECT DISTINCT source_video_id FROM mo), {DRAWN},
        sm AS (SELECT replicate, mode, CAST(count(*) AS DOUBLE) AS n, CAST(count(prediction) AS DOUBLE) AS c, CAST(sum(CASE WHEN prediction = truth THEN 1 ELSE 0 END) AS DOUBLE) AS k FROM dw JOIN ix ON idx = pick JOIN mo ON mo.source_video_id = ix.source_video_id GROUP BY 1, 2),
        gp AS (SELECT x.mode, x.c / x.n - y.c / y.n AS coverage, x.k / x.n - y.k / y.n AS full_correct, x.k / nullif(x.c, 0) - y.k / nullif(y.c, 0) AS accuracy FROM sm x JOIN sm y ON y.replicate = x.replicate AND y.mode = 'coverage' WHERE x.mode <> 'coverage')
        """ + " UNION ALL ".join(f"SELECT mode, '{x}' AS measure, {ENDS.format(x=x)} FROM gp GROUP BY mode" for x in ("coverage", "full_correct", "accuracy"))),
    "paired_pr_difference": oracle(f""", {MODELS}, rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('7:' || CAST(clip_id AS VARCHAR)), clip_id) - 1 AS rank, count(*) OVER (PARTITION BY label) AS size FROM tm),
        dw AS (SELECT b AS replicate, label, CAST('0x' || substr(md5('7:' || CAST(b AS VARCHAR) || ':' || CAST(label AS VARCHAR) || ':' || CAST(rank AS VARCHAR)), 1, 8) AS BIGINT) % size AS pick FROM rk, range(0, {REPLICATES}) q(b)),
        sm AS (SELECT replicate, rk.* FROM dw JOIN rk ON rk.label = dw.label AND rk.rank = dw.pick), tw AS (SELECT replicate, 0 AS model, label, score FROM sm UNION ALL SELECT replicate, 1, label, other FROM sm),
        cs AS (SELECT replicate, model, score, sum(label) AS pos, sum(1 - label) AS neg FROM tw GROUP BY ALL), ks AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM cs WINDOW w AS (PARTITION BY replicate, model ORDER BY score DESC)),
        pr AS (SELECT replicate, model, sum(pos * (tp / CAST(tp + fp AS DOUBLE) + coalesce((tp - pos) / CAST(nullif(tp + fp - pos - neg, 0) AS DOUBLE), 1)) / 2) / CAST(sum(pos) AS DOUBLE) AS area FROM ks GROUP BY 1, 2),
        df AS (SELECT replicate, sum(CASE model WHEN 0 THEN area ELSE -area END) AS x FROM pr GROUP BY 1) SELECT {ENDS.format(x='x')} FROM df"""),
    "within_source_bootstrap": oracle(f""", {MODELS}, """ + ", ".join(f"r{i} AS (SELECT *, rank() OVER (PARTITION BY source_video_id ORDER BY {x}) + (count(*) OVER (PARTITION BY source_video_id, {x}) - 1) / CAST(2 AS DOUBLE) AS rk FROM tm), a{i} AS (SELECT source_video_id, {SOURCE_AUC} AS auc FROM r{i} GROUP BY 1)" for i, x in enumerate(("score", "other"))) + f""",
        so AS (SELECT a0.source_video_id, a0.auc AS x0, a1.auc AS x1 FROM a0 JOIN a1 ON a1.source_video_id = a0.source_video_id), {DRAWN}, df AS (SELECT replicate, avg(x0) - avg(x1) AS x FROM dw JOIN ix ON idx = pick GROUP BY 1) SELECT {ENDS.format(x='x')} FROM df"""),
    "failure_tags_by_class": oracle(f""", {WINDOWS}, {TAGGED} SELECT group_label, outcome, count(*) AS n FROM tg GROUP BY 1, 2"""),
}
