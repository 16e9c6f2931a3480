"""Cascade, queue and reporting queries over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelquery.operators import cascade as c
from reelquery.operators import catalog as k
from reelquery.operators import metrics as m
from reelquery.plans.views import oracle, view

THRESHOLD = 0.6
GATE = "population = 'evaluation' AND assignment = 'test' AND status = 'completed'"


def cascade(s, d):
    return c.results(view(s, d, "v_windows"), THRESHOLD)


def judged(s, d):
    return cascade(s, d).join(view(s, d, "v_truth"), "video_id")


def review(s, d):
    rows = cascade(s, d)
    both = [c.assess_review(rows, mode).select(F.lit(mode).alias("mode"), "video_id", "reason", "suggested", "abstained", "needs_review") for mode in ("coverage", "coverage_consistency")]
    return both[0].unionByName(both[1])


def items(s, d):
    return view(s, d, "v_items")


def clips(s, d):
    """What the catalog knows of a clip, by its number."""
    rows = view(s, d, "v_items").select("clip_id").distinct()
    return rows.withColumn("population", F.expr("CASE WHEN clip_id % 4 = 0 THEN 'library' ELSE 'evaluation' END")).withColumn("assignment", F.expr("CASE WHEN clip_id % 3 = 0 THEN 'train' ELSE 'test' END"))


def reviews(s, d):
    rows = view(s, d, "v_items").where("attempts >= 2").select("job_id", "item_seq", F.expr("explode(array(1, 2))").alias("seq"))
    return rows.withColumn("decision", F.expr("CASE WHEN (job_id + seq) % 2 = 0 THEN 'confirm' ELSE 'reject' END"))


def references(s, d):
    rows = clips(s, d).where("assignment = 'test'").select("clip_id", F.expr("explode(sequence(1, CAST(1 + clip_id % 3 AS INT)))").alias("version"))
    return rows.withColumn("payload", F.expr("CAST((clip_id + version) % 6 AS INT)"))


def joined(s, d):
    return k.records(items(s, d), view(s, d, "v_jobs"), clips(s, d), reviews(s, d), references(s, d))


def latest(s, d):
    return k.latest_eligible(joined(s, d), F.expr(GATE))


def population_pairs(s, d):
    """Truth and prediction of the latest eligible item of each clip that has a reference."""
    rows = latest(s, d).where("reference IS NOT NULL")
    return rows.select(F.col("reference").alias("truth"), F.expr("CASE WHEN (clip_id + item_seq) % 7 < 6 THEN CAST((clip_id + item_seq) % 7 AS INT) END").alias("prediction"))


def exported(s, d):
    rows = joined(s, d).withColumn("notes", F.expr("CASE item_seq % 4 WHEN 0 THEN '=1+1' WHEN 1 THEN '  -x' WHEN 2 THEN '@a' ELSE 'fine - really' END"))
    return k.export_rows(rows, F.expr("attempts < 2"), ["job_id", "item_seq", "clip_id", "status", "latest_review", "notes"], ["notes"])


def submissions(s, d):
    rows = view(s, d, "v_items").select(F.expr("job_id div 3").alias("key"), F.expr("CAST(clip_id % 2 AS STRING)").alias("request_hash"), F.expr("job_id * 100 + item_seq").alias("seq"))
    existing = view(s, d, "v_jobs").where("cancel_requested = 1").select(F.expr("job_id div 3").alias("key"), F.lit("0").alias("request_hash")).distinct()
    return k.submit(existing, rows)


def proposals(s, d):
    rows = clips(s, d).select("clip_id", F.expr("explode(sequence(0, 3))").alias("seq")).withColumn("expected_version", F.expr("CAST((clip_id + seq) % 4 AS INT)"))
    return k.append_versions(references(s, d), rows)


def fused(s, d):
    p = [F.col("score"), 1 - F.col("score"), F.col("score") * F.col("score")]
    q = [F.col("seg") / F.lit(100.0), F.lit(0.25), F.col("score") / 2]
    names = [x.alias(f"class_{i}") for i, x in enumerate(c.fused_log_probabilities(p, q, 2.0))]
    return view(s, d, "v_segments").select("video_id", "seg", *names)


QUERIES = {
    "cascade_final_alert": lambda s, d: cascade(s, d).select("video_id", "overall_score", F.size("windows").alias("windows"), "state", "behavior", "alert_start", "alert_end", "alert_score"),
    "review_policy_modes": review,
    "cascade_coverage": lambda s, d: c.coverage(judged(s, d)),
    "failure_tags": lambda s, d: c.failure_counts(c.outcomes(judged(s, d))).withColumn("examples", F.array_join("examples", ",")),
    "failure_tags_by_source": lambda s, d: c.failure_counts(c.outcomes(judged(s, d)), ["source_video_id"]).withColumn("examples", F.array_join("examples", ",")),
    "linear_head_score": lambda s, d: view(s, d, "v_segments").select("video_id", "seg", c.linear_head(F.array("score", F.col("score") * F.col("score"), F.lit(1.0)), [2.0, -1.0, 0.5], -0.25).alias("probability")),
    "late_fusion_logprob": fused,
    "records_join": lambda s, d: joined(s, d).select("job_id", "item_seq", "clip_id", "status", "population", "reviews", "latest_review", "version", "reference"),
    "latest_eligible_per_clip": lambda s, d: latest(s, d).select("clip_id", "job_id", "item_seq", "created_at"),
    "population_evaluation": lambda s, d: m.class_metrics(population_pairs(s, d), 6),
    "excluded_items": lambda s, d: joined(s, d).where(F.expr(f"NOT ({GATE})")).groupBy(F.concat_ws(":", "population", "status").alias("reason")).agg(F.count("*").alias("n")),
    "export_rows_csv_safe": exported,
    "job_state_rollup": lambda s, d: k.job_states(items(s, d)),
    "dashboard_counts": lambda s, d: k.dashboard(items(s, d), reviews(s, d)),
    "claim_order": lambda s, d: k.claim(items(s, d), view(s, d, "v_jobs"), 25).select("job_id", "item_seq", "created_at"),
    "recover_transition": lambda s, d: k.recover(items(s, d), view(s, d, "v_jobs"), 1).groupBy("job_id", "status").agg(F.count("*").alias("n")),
    "cancel_transition": lambda s, d: k.cancel(items(s, d), view(s, d, "v_jobs").where("cancel_requested = 1")).groupBy("job_id", "status").agg(F.count("*").alias("n")),
    "retry_requests": lambda s, d: k.retry_requests(items(s, d)),
    "submit_outcomes": submissions,
    "append_versions": proposals,
    "retention_cutoff": lambda s, d: k.retention(view(s, d, "v_jobs").withColumnRenamed("created_at", "imported_at"), "1998-01-01 00:00:00", 365).select("job_id", "imported_at"),
    "jobs_page": lambda s, d: k.page(view(s, d, "v_jobs"), [F.col("created_at").desc(), F.col("job_id").desc()], 40, 20),
}

WINDOWS = """wf AS (SELECT *, row_number() OVER (PARTITION BY video_id, start_s, end_s ORDER BY score DESC, seg) AS one FROM v_windows WHERE score >= CAST(0.6 AS DOUBLE)),
    wk AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, seg) AS rank FROM wf WHERE one = 1),
    w AS (SELECT *, actors > 0 AS av, CASE WHEN actors > 0 AND behavior <> 0 THEN 'behavior_review' ELSE 'generic_anomaly' END AS state FROM wk WHERE rank <= 3),
    fi AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY CASE state WHEN 'behavior_review' THEN 0 ELSE 1 END, score DESC, rank) AS best FROM w),
    ov AS (SELECT video_id, max(score) AS overall_score FROM v_windows GROUP BY 1),
    ag AS (SELECT video_id, count(*) AS windows, CAST(sum(CASE WHEN av THEN 1 ELSE 0 END) AS BIGINT) AS covered, count(DISTINCT CASE WHEN av THEN behavior END) AS votes FROM w GROUP BY 1),
    f1 AS (SELECT * FROM fi WHERE best = 1),
    ch AS (SELECT w.video_id, w.behavior, row_number() OVER (PARTITION BY w.video_id ORDER BY CASE WHEN w.start_s = f1.start_s AND w.end_s = f1.end_s THEN 0 ELSE 1 END, w.rank) AS i FROM w JOIN f1 ON f1.video_id = w.video_id WHERE w.av),
    r AS (SELECT ov.video_id, overall_score, coalesce(windows, 0) AS windows, coalesce(covered, 0) AS covered, coalesce(votes, 0) AS votes, coalesce(f1.state, 'no_anomaly') AS state,
        CASE WHEN f1.av THEN f1.behavior END AS behavior, f1.start_s AS alert_start, f1.end_s AS alert_end, coalesce(f1.score, overall_score) AS alert_score, ch.behavior AS chosen
        FROM ov LEFT JOIN ag USING (video_id) LEFT JOIN f1 ON f1.video_id = ov.video_id LEFT JOIN ch ON ch.video_id = ov.video_id AND ch.i = 1)"""
REASON = "CASE WHEN windows = 0 THEN 'not_routed_actors_unexamined' WHEN covered = 0 THEN 'no_actors' WHEN covered < windows THEN 'partial_actor_coverage' {more} ELSE 'covered_suggestion_requires_human_review' END"
TAGGED = """tg AS (SELECT r.*, t.group_label, t.source_video_id, unnest(list_filter(['clips', CASE WHEN windows > 0 THEN 'routed' ELSE 'bypassed' END, CASE WHEN group_label = 0 AND windows > 0 THEN 'normal_false_alert' END,
        CASE WHEN group_label <> 0 AND windows = 0 THEN 'abnormal_bypassed' END, CASE WHEN windows > 0 AND covered = 0 THEN 'routed_no_actors' END, CASE WHEN covered > 0 THEN 'covered' END,
        CASE WHEN covered > 0 AND chosen = group_label THEN 'behavior_correct' END, CASE WHEN covered > 0 AND chosen <> group_label THEN 'behavior_incorrect' END,
        CASE WHEN covered > 0 AND covered < windows THEN 'mixed_actor_coverage' END, CASE WHEN covered > 0 AND votes > 1 THEN 'cross_window_behavior_disagreement' END], lambda z: z IS NOT NULL)) AS outcome
        FROM r JOIN v_truth t ON t.video_id = r.video_id)"""
JOINED = """cl AS (SELECT DISTINCT clip_id, CASE WHEN clip_id % 4 = 0 THEN 'library' ELSE 'evaluation' END AS population, CASE WHEN clip_id % 3 = 0 THEN 'train' ELSE 'test' END AS assignment FROM v_items),
    rv AS (SELECT job_id, item_seq, 2 AS reviews, CASE WHEN (job_id + 2) % 2 = 0 THEN 'confirm' ELSE 'reject' END AS latest_review FROM v_items WHERE attempts >= 2),
    rf AS (SELECT clip_id, CAST(1 + clip_id % 3 AS INTEGER) AS version, CAST((clip_id + 1 + clip_id % 3) % 6 AS INTEGER) AS reference FROM cl WHERE assignment = 'test'),
    jn AS (SELECT i.*, j.created_at, j.cancel_requested, cl.population, cl.assignment, coalesce(rv.reviews, 0) AS reviews, rv.latest_review, rf.version, rf.reference
        FROM v_items i JOIN v_jobs j USING (job_id) JOIN cl USING (clip_id) LEFT JOIN rv ON rv.job_id = i.job_id AND rv.item_seq = i.item_seq LEFT JOIN rf ON rf.clip_id = i.clip_id)"""
LATEST = f"lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY created_at DESC, job_id DESC, item_seq DESC) AS last FROM jn WHERE {GATE}) WHERE last = 1)"
STATES = """js AS (SELECT job_id, CASE WHEN max(CASE status WHEN 'running' THEN 1 ELSE 0 END) = 1 THEN 'running' WHEN max(CASE status WHEN 'queued' THEN 1 ELSE 0 END) = 1 THEN 'queued' WHEN max(CASE status WHEN 'failed' THEN 1 ELSE 0 END) = 1 THEN 'failed'
        WHEN max(CASE status WHEN 'cancelled' THEN 1 ELSE 0 END) = 1 THEN 'cancelled' ELSE 'completed' END AS state, sum(CASE WHEN status IN ('queued', 'running') THEN 0 ELSE 1 END) / CAST(count(*) AS DOUBLE) AS progress, count(*) AS items FROM v_items GROUP BY job_id)"""

ORACLES = {
    "cascade_final_alert": oracle(f", {WINDOWS} SELECT video_id, overall_score, windows, state, behavior, alert_start, alert_end, alert_score FROM r"),
    "review_policy_modes": oracle(f""", {WINDOWS}, a AS (SELECT 'coverage' AS mode, video_id, {REASON.format(more='')} AS reason, chosen, windows FROM r
            UNION ALL SELECT 'coverage_consistency', video_id, {REASON.format(more="WHEN votes > 1 THEN 'cross_window_class_disagreement'")}, chosen, windows FROM r)
        SELECT mode, video_id, reason, CASE WHEN reason LIKE 'covered_%' THEN chosen END AS suggested, NOT (reason LIKE 'covered_%') AS abstained, windows > 0 AS needs_review FROM a"""),
    "cascade_coverage": oracle(f""", {WINDOWS}, j AS (SELECT r.*, t.source_video_id FROM r JOIN v_truth t ON t.video_id = r.video_id)
        SELECT count(*) AS total, count(DISTINCT source_video_id) AS sources, CAST(sum(CASE WHEN windows > 0 THEN 1 ELSE 0 END) AS BIGINT) AS routed, CAST(sum(CASE WHEN windows = 0 THEN 1 ELSE 0 END) AS BIGINT) AS bypassed,
            CAST(sum(CASE WHEN covered > 0 THEN 1 ELSE 0 END) AS BIGINT) AS covered, CAST(sum(CASE WHEN windows > 0 AND covered = 0 THEN 1 ELSE 0 END) AS BIGINT) AS no_actor_routed, CAST(sum(CASE WHEN covered = 0 THEN 1 ELSE 0 END) AS BIGINT) AS abstained,
            CAST(sum(windows) AS BIGINT) AS windows, CAST(sum(windows - covered) AS BIGINT) AS no_actor_windows, sum(CASE WHEN covered > 0 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS coverage_overall,
            sum(CASE WHEN covered > 0 THEN 1 ELSE 0 END) / CAST(nullif(sum(CASE WHEN windows > 0 THEN 1 ELSE 0 END), 0) AS DOUBLE) AS coverage_among_routed FROM j"""),
    "failure_tags": oracle(f", {WINDOWS}, {TAGGED} SELECT outcome, count(*) AS n, array_to_string(list_sort(list(video_id))[1:5], ',') AS examples FROM tg GROUP BY outcome"),
    "failure_tags_by_source": oracle(f", {WINDOWS}, {TAGGED} SELECT source_video_id, outcome, count(*) AS n, array_to_string(list_sort(list(video_id))[1:5], ',') AS examples FROM tg GROUP BY source_video_id, outcome"),
    "linear_head_score": oracle(" SELECT video_id, seg, 1 / (1 + exp(-(score * 2 - score * score + CAST(0.5 AS DOUBLE) - CAST(0.25 AS DOUBLE)))) AS probability FROM v_segments"),
    "late_fusion_logprob": oracle(""", l AS (SELECT video_id, seg, exp(score) AS p0, exp(1 - score) AS p1, exp(score * score) AS p2, exp(seg / CAST(100 AS DOUBLE)) AS q0, exp(CAST(0.25 AS DOUBLE)) AS q1, exp(score / 2) AS q2 FROM v_segments)
        SELECT video_id, seg, """ + ", ".join(f"ln((2 * p{i} / (p0 + p1 + p2) + q{i} / (q0 + q1 + q2)) / 3) AS class_{i}" for i in range(3)) + " FROM l"),
    "records_join": oracle(f", {JOINED} SELECT job_id, item_seq, clip_id, status, population, reviews, latest_review, version, reference FROM jn"),
    "latest_eligible_per_clip": oracle(f", {JOINED}, {LATEST} SELECT clip_id, job_id, item_seq, created_at FROM lt"),
    "population_evaluation": oracle(f""", {JOINED}, {LATEST}, v AS (SELECT reference AS truth, CASE WHEN (clip_id + item_seq) % 7 < 6 THEN CAST((clip_id + item_seq) % 7 AS INTEGER) END AS prediction FROM lt WHERE reference IS NOT NULL),
        q AS (SELECT CAST(i AS INTEGER) AS class, (SELECT count(*) FROM v WHERE truth = i) AS support, (SELECT count(*) FROM v WHERE prediction = i) AS predicted, (SELECT count(*) FROM v WHERE truth = i AND prediction = i) AS correct FROM range(0, 6) r(i))
        SELECT *, coalesce(correct / CAST(nullif(predicted, 0) AS DOUBLE), 0) AS precision, coalesce(correct / CAST(nullif(support, 0) AS DOUBLE), 0) AS recall,
            coalesce(2 * correct / CAST(nullif(predicted + support, 0) AS DOUBLE), 0) AS f1, correct / CAST(nullif(support, 0) AS DOUBLE) AS accuracy FROM q"""),
    "excluded_items": oracle(f", {JOINED} SELECT population || ':' || status AS reason, count(*) AS n FROM jn WHERE NOT ({GATE}) GROUP BY 1"),
    "export_rows_csv_safe": oracle(f""", {JOINED}, n AS (SELECT *, CASE item_seq % 4 WHEN 0 THEN '=1+1' WHEN 1 THEN '  -x' WHEN 2 THEN '@a' ELSE 'fine - really' END AS notes FROM jn WHERE attempts < 2)
        SELECT job_id, item_seq, clip_id, status, latest_review, CASE WHEN substr(ltrim(notes), 1, 1) IN ('=', '+', '-', '@') THEN '''' || notes ELSE notes END AS notes FROM n"""),
    "job_state_rollup": oracle(f", {STATES} SELECT * FROM js"),
    "dashboard_counts": oracle(f", {STATES}, p AS (SELECT job_id, count(*) AS n FROM v_items WHERE status = 'completed' AND attempts < 2 GROUP BY 1) SELECT state, count(*) AS jobs, CAST(coalesce(sum(n), 0) AS BIGINT) AS pending FROM js LEFT JOIN p USING (job_id) GROUP BY state"),
    "claim_order": oracle(" SELECT i.job_id, item_seq, created_at FROM v_items i JOIN v_jobs j USING (job_id) WHERE status = 'queued' AND cancel_requested = 0 ORDER BY created_at, i.job_id, item_seq LIMIT 25"),
    "recover_transition": oracle(""", a AS (SELECT i.job_id, cancel_requested, CASE WHEN status <> 'running' THEN status WHEN attempts <= 1 THEN 'queued' ELSE 'failed' END AS status FROM v_items i JOIN v_jobs j USING (job_id)),
        b AS (SELECT job_id, CASE WHEN status = 'queued' AND cancel_requested = 1 THEN 'cancelled' ELSE status END AS status FROM a) SELECT job_id, status, count(*) AS n FROM b GROUP BY ALL"""),
    "cancel_transition": oracle(", b AS (SELECT job_id, CASE WHEN status = 'queued' AND job_id IN (SELECT job_id FROM v_jobs WHERE cancel_requested = 1) THEN 'cancelled' ELSE status END AS status FROM v_items) SELECT job_id, status, count(*) AS n FROM b GROUP BY ALL"),
    "retry_requests": oracle(" SELECT DISTINCT job_id, clip_id FROM v_items WHERE status IN ('failed', 'cancelled')"),
    "submit_outcomes": oracle(""", q AS (SELECT job_id // 3 AS key, CAST(clip_id % 2 AS VARCHAR) AS request_hash, job_id * 100 + item_seq AS seq FROM v_items), e AS (SELECT DISTINCT job_id // 3 AS key FROM v_jobs WHERE cancel_requested = 1),
        f AS (SELECT q.*, e.key IS NOT NULL AS known, CASE WHEN e.key IS NOT NULL THEN '0' ELSE first_value(request_hash) OVER (PARTITION BY q.key ORDER BY seq) END AS owner, row_number() OVER (PARTITION BY q.key ORDER BY seq) AS turn FROM q LEFT JOIN e ON e.key = q.key)
        SELECT key, request_hash, seq, CASE WHEN request_hash <> owner THEN 'conflict' WHEN NOT known AND turn = 1 THEN 'created' ELSE 'replayed' END AS outcome FROM f"""),
    "append_versions": oracle(""", cl AS (SELECT DISTINCT clip_id FROM v_items), p AS (SELECT clip_id, CAST(s AS INTEGER) AS seq, CAST((clip_id + s) % 4 AS INTEGER) AS expected_version, CASE WHEN clip_id % 3 <> 0 THEN CAST(1 + clip_id % 3 AS INTEGER) ELSE 0 END AS latest FROM cl, range(0, 4) r(s)),
        t AS (SELECT *, expected_version = latest AND row_number() OVER (PARTITION BY clip_id, expected_version = latest ORDER BY seq) = 1 AS accepted FROM p)
        SELECT clip_id, seq, expected_version, accepted, CASE WHEN accepted THEN latest + 1 END AS version FROM t"""),
    "retention_cutoff": oracle(" SELECT job_id, created_at AS imported_at FROM v_jobs WHERE created_at < TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 365 DAY"),
    "jobs_page": oracle(" SELECT *, (SELECT count(*) FROM v_jobs) AS total FROM v_jobs ORDER BY created_at DESC, job_id DESC LIMIT 20 OFFSET 40"),
}
