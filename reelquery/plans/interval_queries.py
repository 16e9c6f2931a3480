"""Temporal queries over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelquery.operators import intervals as t
from reelquery.plans.views import oracle, view


def videos(s, d):
    """A length and a frame rate for each video."""
    return view(s, d, "v_segments").groupBy("video_id").agg(F.count("*").alias("frames")).withColumn("fps", F.lit(2.0))


def events_of(s, d):
    """The events of each video: its quiet segments, on a clock of half the speed and a little longer."""
    start = F.col("start_s") / 2 + F.lit(0.125)
    return view(s, d, "v_segments").where("score < 0.15").select("video_id", start.alias("start_s"), (start + F.lit(0.75)).alias("end_s"))


def painted(s, d):
    return t.frame_labels(videos(s, d), events_of(s, d), "frames", "fps")


def false_alert(s, d):
    segments = view(s, d, "v_segments")
    rows = segments.groupBy("video_id").agg(F.max("end_s").alias("duration"))
    return t.temporal_false_alert(segments.where("score >= 0.5"), events_of(s, d), rows)


def bags(s, d):
    vectors = view(s, d, "v_segments").withColumn("unit", (F.row_number().over(t.W.partitionBy("video_id").orderBy("seg")) - 1).cast("long"))
    return t.segment_bag(vectors.select("video_id", "unit", F.array("score", F.col("score") * F.col("score"), F.lit(1.0) - F.col("score")).alias("vector")), 4)


def paired(s, d):
    rows = view(s, d, "v_segments")
    return rows.select(F.expr("video_id div 2").alias("pair"), "seg", F.col("video_id") % 2, "score").groupBy("pair", "seg").agg(F.max(F.expr("CASE WHEN `(video_id % 2)` = 0 THEN score END")).alias("abnormal"), F.max(F.expr("CASE WHEN `(video_id % 2)` = 1 THEN score END")).alias("normal")).where("abnormal IS NOT NULL AND normal IS NOT NULL")


def arrays(s, d):
    """Frames, and an array of segment scores."""
    rows = view(s, d, "v_segments").groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg", "score"))), lambda x: x["score"]).alias("scores"))
    return rows.withColumn("frames", F.col("video_id") % 150 + 3)


QUERIES = {
    "segment_bounds": lambda s, d: t.segment_bounds(videos(s, d), "frames", 32).select("video_id", "seg", "first", "last"),
    "unit_segment_frames": lambda s, d: t.unit_segment_frames(videos(s, d).withColumn("frames", F.col("frames") * 10), "frames", 8).select("video_id", "seg", "first", "last"),
    "frame_labels": painted,
    "project_scores_repeat": lambda s, d: t.project_scores(arrays(s, d), "frames", "scores", "repeat"),
    "project_scores_interpolate": lambda s, d: t.project_scores(arrays(s, d), "frames", "scores", "interpolate"),
    "project_scores_units": lambda s, d: t.project_scores(arrays(s, d), "frames", "scores", "c3d_units"),
    "merge_intervals": lambda s, d: t.merge_intervals(view(s, d, "v_intervals")),
    "interval_overlap_join": lambda s, d: t.overlap_join(view(s, d, "v_intervals"), view(s, d, "v_segments").withColumn("start_s", F.col("start_s") * 50).withColumn("end_s", F.col("end_s") * 50)),
    "temporal_false_alert": false_alert,
    "suspicious_runs": lambda s, d: t.suspicious_runs(view(s, d, "v_segments"), 0.4),
    "grid_windows": lambda s, d: t.grid_windows(painted(s, d), 5, 3),
    "evenly_spaced": lambda s, d: t.evenly(view(s, d, "v_segments"), 5, "video_id", "seg").select("video_id", "seg"),
    "centered_frames": lambda s, d: view(s, d, "v_segments").select("video_id", "seg", t.centered_frames(F.col("seg"), F.lit(2), F.lit(40)).alias("frames")).select("video_id", "seg", F.posexplode("frames").alias("slot", "frame")),
    "topk_distinct_windows": lambda s, d: t.top_windows(view(s, d, "v_segments"), 0.3).select("video_id", "seg", "start_s", "end_s", "score", "rank"),
    "hysteresis_alerts": lambda s, d: t.hysteresis_alerts(view(s, d, "v_segments"), 0.45, 0.3, 2.0, 0.5),
    "segment_l2_bag": lambda s, d: bags(s, d).select("video_id", "seg", F.posexplode("vector").alias("dim", "x")),
    "mil_objective": lambda s, d: t.mil_objective(paired(s, d)),
}

VIDEOS = "videos AS (SELECT video_id, count(*) AS frames, CAST(2 AS DOUBLE) AS fps FROM v_segments GROUP BY video_id)"
EVENTS = "e AS (SELECT video_id, start_s / 2 + CAST(0.125 AS DOUBLE) AS start_s, start_s / 2 + CAST(0.875 AS DOUBLE) AS end_s FROM v_segments WHERE score < CAST(0.15 AS DOUBLE))"
PAINTED = f"""{VIDEOS}, {EVENTS}, fr AS (SELECT video_id, f AS frame, fps FROM videos, unnest(range(0, frames)) u(f)),
    lab AS (SELECT fr.video_id, fr.frame, max(CASE WHEN e.video_id IS NULL THEN 0 ELSE 1 END) AS label
        FROM fr LEFT JOIN e ON e.video_id = fr.video_id AND fr.frame / fr.fps >= e.start_s AND fr.frame / fr.fps < e.end_s GROUP BY ALL)"""
MERGED = """{out}_w AS (SELECT video_id, start_s, end_s, max(end_s) OVER (PARTITION BY video_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {rows}),
    {out}_i AS (SELECT *, max(CASE WHEN reach IS NULL OR start_s > reach THEN start_s END) OVER (PARTITION BY video_id ORDER BY start_s RANGE UNBOUNDED PRECEDING) AS island FROM {out}_w),
    {out} AS (SELECT video_id, min(start_s) AS start_s, max(end_s) AS end_s FROM {out}_i GROUP BY video_id, island)"""
ARRAYS = "ar AS (SELECT video_id, list(score ORDER BY seg) AS scores, video_id % 150 + 3 AS n, count(*) AS s FROM v_segments GROUP BY video_id), ff AS (SELECT ar.*, f AS frame FROM ar, unnest(range(0, n)) u(f))"

ORACLES = {
    "segment_bounds": oracle(f""", {VIDEOS} SELECT video_id, CAST(i AS INTEGER) AS seg, i * frames // 32 AS first, CASE WHEN frames < 32 THEN i * frames // 32 + 1 ELSE (i + 1) * frames // 32 END AS last FROM videos, range(0, 32) r(i)"""),
    "unit_segment_frames": oracle(f""", {VIDEOS}, u AS (SELECT video_id, frames * 10 AS frames, (frames * 10 + 15) // 16 AS n FROM videos)
        SELECT video_id, CAST(i AS INTEGER) AS seg, i * n // 8 * 16 AS first, least((CASE WHEN n < 8 THEN i * n // 8 + 1 ELSE (i + 1) * n // 8 END) * 16, frames) AS last FROM u, range(0, 8) r(i)"""),
    "frame_labels": oracle(f", {PAINTED} SELECT video_id, frame, label FROM lab"),
    "project_scores_repeat": oracle(f""", {ARRAYS}, b AS (SELECT ar.video_id, i, scores[i + 1] AS score, i * n // s AS low, (i + 1) * n // s AS high, n, s FROM ar, unnest(range(0, s)) u(i))
        SELECT ff.video_id, frame, CASE WHEN ff.n < ff.s THEN ff.scores[CAST(least(floor((frame + CAST(0.5 AS DOUBLE)) * ff.s / ff.n), ff.s - 1) + 1 AS BIGINT)] ELSE b.score END AS score
        FROM ff LEFT JOIN b ON b.video_id = ff.video_id AND ff.n >= ff.s AND frame >= low AND frame < high"""),
    "project_scores_interpolate": oracle(f""", {ARRAYS}, x AS (SELECT *, (frame + CAST(0.5 AS DOUBLE)) / n * s - CAST(0.5 AS DOUBLE) AS x FROM ff)
        SELECT video_id, frame, CASE WHEN x <= 0 THEN scores[1] WHEN x >= s - 1 THEN scores[s] ELSE scores[CAST(floor(x) AS BIGINT) + 1] + (scores[CAST(floor(x) AS BIGINT) + 2] - scores[CAST(floor(x) AS BIGINT) + 1]) * (x - floor(x)) END AS score FROM x"""),
    "project_scores_units": oracle(f""", {ARRAYS}, cu AS (SELECT video_id, i, scores[i + 1] AS score, (n + 15) // 16 AS units, n, s FROM ar, unnest(range(0, s)) u(i)),
        cr AS (SELECT video_id, n, i * units // s * 16 AS low, CASE WHEN units < s THEN (i * units // s + 1) * 16 ELSE (i + 1) * units // s * 16 END AS high, score FROM cu)
        SELECT ff.video_id, frame, avg(score) AS score FROM ff JOIN cr ON cr.video_id = ff.video_id AND frame >= low AND frame < high GROUP BY 1, 2"""),
    "merge_intervals": oracle(f", {MERGED.format(out='m', rows='v_intervals')} SELECT * FROM m"),
    "interval_overlap_join": oracle(""" SELECT a.video_id, a.start_s AS a_start, a.end_s AS a_end, b.start_s * 50 AS b_start, b.end_s * 50 AS b_end, least(a.end_s, b.end_s * 50) - greatest(a.start_s, b.start_s * 50) AS overlap
        FROM v_intervals a JOIN v_segments b ON a.video_id = b.video_id AND a.start_s < b.end_s * 50 AND b.start_s * 50 < a.end_s"""),
    "temporal_false_alert": oracle(f""", {EVENTS}, ee AS (SELECT * FROM e), aa AS (SELECT * FROM v_segments WHERE score >= 0.5), {MERGED.format(out='ev', rows='ee')}, {MERGED.format(out='al', rows='aa')},
        o AS (SELECT al.video_id, sum(least(al.end_s, ev.end_s) - greatest(al.start_s, ev.start_s)) AS shared FROM al JOIN ev ON al.video_id = ev.video_id AND al.start_s < ev.end_s AND ev.start_s < al.end_s GROUP BY 1),
        a AS (SELECT video_id, sum(end_s - start_s) AS x FROM al GROUP BY 1), b AS (SELECT video_id, sum(end_s - start_s) AS x FROM ev GROUP BY 1), v AS (SELECT video_id, max(end_s) AS duration FROM v_segments GROUP BY 1)
        SELECT v.video_id, coalesce(a.x, 0) - coalesce(shared, 0) AS false_seconds, greatest(duration - coalesce(b.x, 0), 0) AS negative_seconds FROM v LEFT JOIN a USING (video_id) LEFT JOIN b USING (video_id) LEFT JOIN o USING (video_id)"""),
    "suspicious_runs": oracle(""", g AS (SELECT *, lag(end_s) OVER (PARTITION BY video_id ORDER BY seg) AS before FROM v_segments WHERE score >= CAST(0.4 AS DOUBLE)),
        h AS (SELECT *, sum(CASE WHEN before IS NULL OR start_s > before THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY seg ROWS UNBOUNDED PRECEDING) AS run FROM g)
        SELECT video_id, min(start_s) AS start_s, max(end_s) AS end_s, max(score) AS top FROM h GROUP BY video_id, run"""),
    "grid_windows": oracle(f""", {PAINTED}, st AS (SELECT video_id, frame // 5 * 5 AS start, count(*) AS n, min(label) AS least FROM lab GROUP BY 1, 2 HAVING count(*) = 5),
        nr AS (SELECT st.*, (SELECT max(label) FROM lab WHERE lab.video_id = st.video_id AND frame >= start - 3 AND frame < start + 8) AS near FROM st)
        SELECT video_id, start, CASE WHEN least = 1 THEN 'violent' ELSE 'normal' END AS kind FROM nr WHERE least = 1 OR near = 0"""),
    "evenly_spaced": oracle(""", i AS (SELECT video_id, seg, row_number() OVER (PARTITION BY video_id ORDER BY seg) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n FROM v_segments)
        SELECT video_id, seg FROM i WHERE n <= 5 OR i IN (n // 10, 3 * n // 10, 5 * n // 10, 7 * n // 10, 9 * n // 10)"""),
    "centered_frames": oracle(" SELECT video_id, seg, CAST(i AS INTEGER) AS slot, greatest(2, least(39, seg - 5 + i)) AS frame FROM v_segments, range(0, 10) r(i)"),
    "topk_distinct_windows": oracle(""", f AS (SELECT *, row_number() OVER (PARTITION BY video_id, start_s, end_s ORDER BY score DESC, seg) AS one FROM v_segments WHERE score >= CAST(0.3 AS DOUBLE)),
        k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, seg) AS rank FROM f WHERE one = 1)
        SELECT video_id, seg, start_s, end_s, score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3"""),
    "hysteresis_alerts": oracle(""", q AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_s) AS i, count(*) OVER (PARTITION BY video_id) AS n FROM v_segments),
        st AS (
            SELECT video_id, i, n, end_s AS previous, score AS smooth, CASE WHEN score >= CAST(0.45 AS DOUBLE) THEN start_s END AS start,
                CASE WHEN score >= CAST(0.45 AS DOUBLE) AND end_s - start_s >= 2 THEN end_s END AS decision, CAST(NULL AS DOUBLE) AS c_start, CAST(NULL AS DOUBLE) AS c_end, CAST(NULL AS DOUBLE) AS c_decision
            FROM q WHERE i = 1
            UNION ALL
            SELECT video_id, i, n, end_s, level, start3, CASE WHEN start3 IS NOT NULL AND decision2 IS NULL AND end_s - start3 >= 2 THEN end_s ELSE decision2 END,
                CASE WHEN gap AND p_decision IS NOT NULL THEN p_start WHEN ends AND decision1 IS NOT NULL THEN start1 END, CASE WHEN gap AND p_decision IS NOT NULL THEN p_previous WHEN ends AND decision1 IS NOT NULL THEN start_s END,
                CASE WHEN gap AND p_decision IS NOT NULL THEN p_decision WHEN ends AND decision1 IS NOT NULL THEN decision1 END
            FROM (SELECT *, CASE WHEN start1 IS NULL AND level >= CAST(0.45 AS DOUBLE) THEN start_s WHEN ends THEN NULL ELSE start1 END AS start3, CASE WHEN ends THEN NULL ELSE decision1 END AS decision2
                FROM (SELECT *, start1 IS NOT NULL AND level < CAST(0.3 AS DOUBLE) AS ends
                    FROM (SELECT q.video_id, q.i, q.n, q.start_s, q.end_s, q.start_s > st.previous AS gap, st.decision AS p_decision, st.start AS p_start, st.previous AS p_previous,
                            CASE WHEN q.start_s > st.previous THEN NULL ELSE st.start END AS start1, CASE WHEN q.start_s > st.previous THEN NULL ELSE st.decision END AS decision1,
                            CASE WHEN q.start_s > st.previous THEN q.score ELSE CAST(0.5 AS DOUBLE) * q.score + CAST(0.5 AS DOUBLE) * st.smooth END AS level
                        FROM st JOIN q ON q.video_id = st.video_id AND q.i = st.i + 1))))
        SELECT video_id, c_start AS start_s, c_end AS end_s, c_decision AS decision_time FROM st WHERE c_start IS NOT NULL
        UNION ALL SELECT video_id, start, previous, decision FROM st WHERE i = n AND decision IS NOT NULL"""),
    "segment_l2_bag": oracle(""", u AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY seg) - 1 AS unit, score FROM v_segments),
        n AS (SELECT video_id, count(*) AS n FROM u GROUP BY 1), b AS (SELECT video_id, CAST(i AS INTEGER) AS seg, i * n // 4 AS low, CASE WHEN n < 4 THEN i * n // 4 + 1 ELSE (i + 1) * n // 4 END AS high FROM n, range(0, 4) r(i)),
        m AS (SELECT b.video_id, b.seg, avg(score) AS x0, avg(score * score) AS x1, avg(1 - score) AS x2 FROM b JOIN u ON u.video_id = b.video_id AND unit >= low AND unit < high GROUP BY 1, 2),
        z AS (SELECT *, greatest(sqrt(x0 * x0 + x1 * x1 + x2 * x2), 1e-12) AS norm FROM m)
        SELECT video_id, seg, CAST(i AS INTEGER) AS dim, (CASE i WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END) / norm AS x FROM z, range(0, 3) r(i)"""),
    "mil_objective": oracle(""", p AS (SELECT video_id // 2 AS pair, seg, max(CASE WHEN video_id % 2 = 0 THEN score END) AS abnormal, max(CASE WHEN video_id % 2 = 1 THEN score END) AS normal FROM v_segments GROUP BY 1, 2),
        d AS (SELECT *, abnormal - lag(abnormal) OVER (PARTITION BY pair ORDER BY seg) AS step FROM p WHERE abnormal IS NOT NULL AND normal IS NOT NULL),
        g AS (SELECT pair, greatest(1 - max(abnormal) + max(normal), 0) AS hinge, sum(abnormal) AS total_score, coalesce(sum(step * step), 0) AS rough FROM d GROUP BY pair),
        m AS (SELECT avg(hinge) AS ranking, avg(total_score) AS sparsity, avg(rough) AS smoothness FROM g)
        SELECT *, ranking + CAST(0.00008 AS DOUBLE) * sparsity + CAST(0.00008 AS DOUBLE) * smoothness AS total FROM m"""),
}
