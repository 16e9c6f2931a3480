"""Queries of splits, imports, group evidence, audits and scoring over the fixture views, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelquery.operators import audit, evidence, graph, imports, scoring, splits
from reelquery.plans.views import oracle, view

TEXT = "VARCHAR(20)"
#: Fixtures in the SQL of both engines; {name} is a view, or a fixture given beside it.
SOURCES = f"SELECT concat('v', CAST(video_id AS {TEXT})) AS source, concat('c', CAST(video_id % 24 AS {TEXT})) AS category, video_id % 11 = 0 AS reserved, video_id * 7 % 5 < 2 AS positive FROM {{v_truth}}"
RECORDS = f"SELECT video_id, concat('s', CAST(video_id % 60 AS {TEXT})) AS source, CASE WHEN video_id % 60 % 9 = 0 THEN 'test' ELSE 'train' END AS split, concat('k', CAST(video_id % 4 AS {TEXT})) AS category FROM {{v_truth}}"
SHARED = f"SELECT DISTINCT concat('s', CAST(video_id % 60 AS {TEXT})) AS source, CASE WHEN video_id % 60 % 3 = 0 THEN 'test' WHEN video_id % 60 % 3 = 1 THEN 'val' ELSE 'train' END AS split FROM {{v_truth}} WHERE video_id % 60 % 4 = 1"
PRIOR = f"SELECT concat('v', CAST(video_id AS {TEXT})) AS source, CASE WHEN video_id % 11 = 0 THEN 'test' ELSE 'val' END AS split FROM {{v_truth}} WHERE video_id % 7 = 3"
STORE = "SELECT clip_id, sha256, source_video_id, split, CASE WHEN split = 'test' THEN 'evaluation' ELSE 'development' END AS population FROM {v_clips} WHERE source_video_id < 'src2' AND clip_id % 3 = 0"
INCOMING = """SELECT CAST(clip_id * 7919 % 1000003 AS BIGINT) AS seq, CASE WHEN clip_id % 25 = 4 THEN clip_id - 1 ELSE clip_id END AS clip_id, CASE WHEN clip_id % 10 = 1 THEN 'other' ELSE sha256 END AS sha256,
    CASE WHEN clip_id % 9 = 0 THEN 'srcnew' ELSE source_video_id END AS source_video_id, CASE WHEN clip_id % 8 = 0 THEN 'test' ELSE split END AS split, CASE WHEN split = 'test' THEN 'evaluation' ELSE 'development' END AS population
    FROM {v_clips} WHERE source_video_id <> 'src4'"""
UPLOADS = f"SELECT clip_id AS seq, concat('t', CAST(clip_id AS {TEXT})) AS token, CASE WHEN clip_id % 4 = 0 THEN 'same' ELSE sha256 END AS sha256 FROM {{v_clips}} WHERE clip_id % 2 = 0"
KEPT = f"SELECT concat('k', CAST(clip_id AS {TEXT})) AS clip_id, sha256, CASE WHEN clip_id % 10 = 0 THEN 'deleted' ELSE 'available' END AS status FROM {{v_clips}} WHERE clip_id % 5 = 0"
LINKS = f"""SELECT clip_id AS a, clip_id + 7 AS b, 'capture' AS reason FROM {{v_clips}} WHERE collection = 'es' AND clip_id % 2 = 0
    UNION ALL SELECT clip_id, clip_id + 7, concat('review:', CAST(clip_id % 3 AS {TEXT})) FROM {{v_clips}} WHERE collection = 'fr' UNION ALL SELECT clip_id + 7, clip_id, 'name' FROM {{v_clips}} WHERE clip_id % 6 = 0"""
VIEWS_OF = {
    "catalog": f"SELECT clip_id, concat('clips/', CAST(clip_id AS {TEXT})) AS path, collection FROM {{v_clips}} WHERE clip_id % 50 <> 0",
    "annotations": f"SELECT clip_id, concat(CASE WHEN clip_id % 21 = 1 THEN 'moved/' ELSE 'clips/' END, CAST(clip_id AS {TEXT})) AS path, collection FROM {{v_clips}} WHERE clip_id % 3 <> 0 UNION ALL SELECT clip_id, 'clips/again', collection FROM {{v_clips}} WHERE clip_id % 40 = 1",
    "priority": "SELECT clip_id, CASE WHEN clip_id % 14 = 1 THEN 'xx' ELSE collection END AS collection FROM {v_clips} WHERE clip_id % 6 = 1",
    "groups": "SELECT clip_id, source_video_id FROM {v_clips} WHERE clip_id % 7 <> 0",
    "evidence": "SELECT clip_id, CASE WHEN clip_id % 35 = 1 THEN NULL ELSE sha256 END AS sha256, source_video_id FROM {v_clips} WHERE clip_id % 5 <> 0",
    "timing": "SELECT clip_id, sha256 FROM {v_clips} WHERE clip_id % 4 <> 0",
}
REQUIRED = {"annotations": ["catalog", "groups"], "priority": ["annotations"], "timing": ["evidence"]}
FIELDS = {"collection": (0, 1, 2), "path": (0, 1), "sha256": (4, 5), "source_video_id": (3, 4)}
NAMES = list(VIEWS_OF)


def made(s, d, sql, *names):
    """A fixture as a DataFrame; names are the views that it reads."""
    return s.sql(sql, **{name: view(s, d, name) for name in names or ("v_clips",)})


def duck(sql):
    return sql.format(v_truth="v_truth", v_clips="v_clips", v_annotations="v_annotations")


def assigned(s, d):
    sources = made(s, d, SOURCES, "v_truth").distinct()
    return splits.split_sources(sources.drop("positive"), 7).join(sources.select("source", "positive"), "source")


def links(s, d):
    nodes = view(s, d, "v_clips").select(F.col("clip_id").alias("id"))
    edges = made(s, d, LINKS).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "reason").distinct()
    return nodes, graph_edges(nodes, edges)


def graph_edges(nodes, edges):
    known = nodes.select("id")
    return edges.join(known.withColumnRenamed("id", "a"), "a").join(known.withColumnRenamed("id", "b"), "b").select("a", "b", "reason")


def reasons(s, d):
    return evidence.group_reasons(*links(s, d)).withColumn("reasons", F.array_join("reasons", ","))


def forest(s, d):
    return evidence.spanning_forest(links(s, d)[1])


def ways(s, d):
    _, edges = links(s, d)
    pairs = edges.select(F.col("a").alias("x"), (F.col("a") + 14).alias("y")).distinct()
    return evidence.paths(pairs, evidence.spanning_forest(edges), edges).withColumn("reasons", F.array_join("reasons", ","))


def audited(s, d):
    return audit.reconcile_views({name: made(s, d, sql) for name, sql in VIEWS_OF.items()}, "clip_id")


def listed(s, d):
    return audited(s, d).select("clip_id", *[F.array_join(c, ",").alias(c) for c in ("present", "missing", "repeated", "conflicts")])


def reports(s, d):
    """Reports of each collection, computed, and saved with some values changed, left out or added."""
    computed = view(s, d, "v_scored").groupBy("collection").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0.5).alias("flagged"), F.count_if(F.col("label") == 1).alias("positive"))
    text = lambda flagged, rate, more: F.to_json(F.struct(F.struct("n", flagged.alias("flagged")).alias("counts"), F.array(F.col("n") - F.col("positive"), "positive").alias("labels"), F.struct(rate.alias("rate"), F.lit("0.5").alias("at"), *more).alias("alerts")))
    rate = F.col("flagged") / F.col("n")
    change = lambda c, x: F.when(F.col("collection") == c, x)
    saved = text(change("en", F.col("flagged") + 1).otherwise(F.col("flagged")), change("de", rate + 1e-7).when(F.col("collection") == "es", rate + 0.001).otherwise(rate), [change("fr", F.lit("x")).alias("note")])
    return audit.compare_reports(computed.select("collection", saved.alias("report")), computed.select("collection", text(F.col("flagged"), rate, []).alias("report")), "collection", "report")


def clip_score(row):
    """Seconds from the start to the end of an annotation; raises on texts that are no numbers, and on odd rows."""
    if row["playback_status"] != "OK ":
        raise LookupError("no such clip")
    low, high = (float(row[name]) if row[name].replace(".", "", 1).isdigit() else None for name in ("start_text", "end_text"))
    if low is None or high is None:
        raise ValueError("times are no numbers")
    return {"seconds": high - low, "flagged": high - low > 20}


def batch(s, d):
    return scoring.score_rows(view(s, d, "v_annotations").select("clip_id", "playback_status", "start_text", "end_text"), clip_score, "seconds double, flagged boolean", tries=2)


def round_of_items(s, d):
    items = view(s, d, "v_items").withColumn("error", F.expr("CASE WHEN clip_id % 3 = 0 THEN 'RuntimeError: decode' END"))
    return scoring.next_states(items, 2).select("job_id", "item_seq", "attempts", "status")


QUERIES = {
    "reserved_source_split": lambda s, d: assigned(s, d).select("source", "category", "split"),
    "class_support_repair": lambda s, d: splits.repair_support(assigned(s, d)).select("source", "category", "split", "swapped"),
    "split_with_prior": lambda s, d: splits.with_prior(made(s, d, SOURCES, "v_truth").distinct().drop("positive"), made(s, d, PRIOR, "v_truth").distinct(), 7),
    "shared_source_protection": lambda s, d: splits.protect_shared(made(s, d, RECORDS, "v_truth"), made(s, d, SHARED, "v_truth"), 7).select("video_id", "source", "split", "excluded"),
    "conflicting_contents": lambda s, d: graph.conflicting_contents(made(s, d, "SELECT sha256, CAST(clip_id % 2 AS INT) AS label FROM {v_clips}"), "sha256", "label").withColumn("labels", F.array_join("labels", ",")),
    "import_outcomes": lambda s, d: imports.import_outcomes(made(s, d, STORE), made(s, d, INCOMING)),
    "upload_outcomes": lambda s, d: imports.upload_outcomes(made(s, d, KEPT), made(s, d, UPLOADS)),
    "group_reasons": reasons,
    "link_forest": forest,
    "link_paths": ways,
    "readiness_audit": listed,
    "readiness_counts": lambda s, d: audit.audit_counts(audited(s, d), REQUIRED),
    "recomputed_reports": reports,
    "scored_batch": lambda s, d: batch(s, d).select("clip_id", "seconds", "flagged", "error", "attempts"),
    "scored_batch_report": lambda s, d: scoring.batch_report(batch(s, d)),
    "next_item_states": round_of_items,
}

#: Counts of a category (n sources, held of them reserved), as c0, c1 and the rest.
COUNTS = """n AS (SELECT category, count(*) AS n, CAST(sum(CASE WHEN reserved THEN 1 ELSE 0 END) AS BIGINT) AS held FROM src GROUP BY category),
    f AS (SELECT *, CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) AS f0, CAST(floor(n * CAST(0.15 AS DOUBLE)) AS BIGINT) AS f1, n * CAST(0.7 AS DOUBLE) AS t0, n * CAST(0.15 AS DOUBLE) AS t1 FROM n),
    r AS (SELECT *, n - f0 - 2 * f1 AS rest, t0 - f0 >= t1 - f1 AS lead FROM f),
    c AS (SELECT category, n, held, f1 + CASE WHEN (lead AND rest >= 2) OR (NOT lead AND rest >= 1) THEN 1 ELSE 0 END AS v, f1 + CASE WHEN (lead AND rest >= 3) OR (NOT lead AND rest >= 2) THEN 1 ELSE 0 END AS t FROM r),
    e AS (SELECT category, n, greatest(CASE WHEN n >= 3 AND t = 0 THEN 1 ELSE t END, held) AS t, CASE WHEN n >= 3 AND v = 0 THEN 1 ELSE v END AS v FROM c),
    g AS (SELECT category, least(v, n - t) AS v, n - t - least(v, n - t) AS tr FROM e),
    k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('7:' || source), source) - 1 AS rank FROM src WHERE NOT reserved),
    s AS (SELECT source, category, CASE WHEN rank < tr THEN 'train' WHEN rank < tr + v THEN 'val' ELSE 'test' END AS split FROM k JOIN g USING (category) UNION ALL SELECT source, category, 'test' FROM src WHERE reserved)"""
UNION = " UNION ALL ".join(
    f"SELECT clip_id, {i} AS i, " + ", ".join(f if i in own else f"CAST(NULL AS VARCHAR) AS {f}" for f, own in FIELDS.items()) + f" FROM ({duck(sql)}) x{i}" for i, sql in enumerate(VIEWS_OF.values())
)
AUDITED = f"""u AS ({UNION}), w AS (SELECT clip_id, {', '.join(f'count(CASE WHEN i = {i} THEN 1 END) AS n{i}' for i in range(6))}, {', '.join(f'max(CASE WHEN i = {i} THEN {f} END) AS {f}{i}' for f, own in FIELDS.items() for i in own)} FROM u GROUP BY clip_id),
    q AS (SELECT clip_id, list_filter([{', '.join(f"CASE WHEN n{i} > 0 THEN '{n}' END" for i, n in enumerate(NAMES))}], lambda x: x IS NOT NULL) AS present, list_filter([{', '.join(f"CASE WHEN n{i} = 0 THEN '{n}' END" for i, n in enumerate(NAMES))}], lambda x: x IS NOT NULL) AS missing,
        list_filter([{', '.join(f"CASE WHEN n{i} > 1 THEN '{n}' END" for i, n in enumerate(NAMES))}], lambda x: x IS NOT NULL) AS repeated,
        list_filter([{', '.join(f"CASE WHEN n{i} > 0 AND n{j} > 0 AND {f}{i} IS DISTINCT FROM {f}{j} THEN '{f}:{NAMES[i]}~{NAMES[j]}' END" for f, own in FIELDS.items() for x, i in enumerate(own) for j in own[x + 1:])}], lambda x: x IS NOT NULL) AS conflicts FROM w)"""
ORPHANS = ", ".join(f"CASE WHEN list_contains(present, '{v}') AND list_contains(missing, '{o}') THEN 'orphan:{v}>{o}' END" for v, others in REQUIRED.items() for o in others)
EDGES = f"""e0 AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, reason FROM ({duck(LINKS)}) x WHERE a IN (SELECT clip_id FROM v_clips) AND b IN (SELECT clip_id FROM v_clips)),
    e AS (SELECT a, b, reason FROM e0 UNION SELECT b, a, reason FROM e0),
    c AS (SELECT clip_id AS id, clip_id AS reached, 0 AS depth FROM v_clips UNION SELECT c.id, e.b, c.depth + 1 FROM c JOIN e ON e.a = c.reached WHERE c.depth < 9 AND e.b >= c.id),
    o AS (SELECT reached AS id, min(id) AS root FROM c GROUP BY reached),
    h AS (SELECT o.id, o.root, min(c.depth) AS depth FROM o JOIN c ON c.id = o.root AND c.reached = o.id GROUP BY 1, 2),
    fo AS (SELECT h.id, h.root, min(p.id) AS parent, h.depth FROM h LEFT JOIN e ON e.b = h.id LEFT JOIN h p ON p.id = e.a AND p.depth = h.depth - 1 GROUP BY 1, 2, 4)"""
JUDGED = f"""st AS ({duck(STORE)}), inc AS ({duck(INCOMING)}), bo AS (SELECT -1 AS seq, * FROM st UNION ALL SELECT * FROM inc),
    ow AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY seq, clip_id) AS turn FROM bo), f AS (SELECT * FROM ow WHERE turn = 1),
    ho AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY seq, sha256) AS turn2 FROM f), hd AS (SELECT * FROM ho WHERE turn2 = 1),
    ld AS (SELECT *, row_number() OVER (PARTITION BY source_video_id ORDER BY seq, split, population = 'evaluation') AS turn3 FROM hd), lead AS (SELECT * FROM ld WHERE turn3 = 1),
    mx AS (SELECT source_video_id, count(DISTINCT concat(split, ' ', population)) > 1 AS mixed FROM st GROUP BY 1)"""

ORACLES = {
    "reserved_source_split": oracle(f", src AS (SELECT DISTINCT * FROM ({duck(SOURCES)}) x), {COUNTS} SELECT * FROM s"),
    "class_support_repair": oracle(f""", src AS (SELECT DISTINCT * FROM ({duck(SOURCES)}) x), {COUNTS}, a AS (SELECT s.*, src.positive FROM s JOIN src USING (source)),
        d AS (SELECT category, min(source) AS donor, count(*) AS n FROM a WHERE split = 'train' AND positive GROUP BY 1), w AS (SELECT category, min(source) AS receiver FROM a WHERE split = 'val' AND NOT positive GROUP BY 1),
        x AS (SELECT category, donor, receiver FROM d JOIN w USING (category) WHERE n >= 2 AND category NOT IN (SELECT category FROM a WHERE split = 'val' AND positive))
        SELECT a.source, a.category, CASE WHEN source = donor THEN 'val' WHEN source = receiver THEN 'train' ELSE split END AS split, coalesce(source IN (donor, receiver), false) AS swapped FROM a LEFT JOIN x USING (category)"""),
    "split_with_prior": oracle(f", al AS (SELECT DISTINCT * FROM ({duck(SOURCES)}) x), pr AS (SELECT DISTINCT * FROM ({duck(PRIOR)}) x), src AS (SELECT * FROM al WHERE source NOT IN (SELECT source FROM pr)), {COUNTS} SELECT * FROM s UNION ALL SELECT al.source, al.category, pr.split FROM al JOIN pr USING (source)"),
    "shared_source_protection": oracle(f""", rec AS ({duck(RECORDS)}), sh AS ({duck(SHARED)}), j AS (SELECT rec.*, sh.split AS held FROM rec LEFT JOIN sh USING (source)),
        u AS (SELECT DISTINCT source, category FROM j WHERE split <> 'test' AND held IS NULL), k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('7:' || source), source) - 1 AS rank, count(*) OVER (PARTITION BY category) AS n FROM u),
        t AS (SELECT *, CAST(floor(n * CAST(0.85 AS DOUBLE)) AS BIGINT) AS f0, CAST(floor(n * CAST(0.15 AS DOUBLE)) AS BIGINT) AS f1, n * CAST(0.85 AS DOUBLE) AS t0, n * CAST(0.15 AS DOUBLE) AS t1 FROM k),
        z AS (SELECT source, category, CASE WHEN rank < f0 + CASE WHEN n - f0 - f1 >= 1 AND t0 - f0 >= t1 - f1 THEN 1 ELSE 0 END THEN 'train' ELSE 'val' END AS dealt FROM t)
        SELECT j.video_id, j.source, CASE WHEN j.split = 'test' THEN 'test' WHEN held = 'test' THEN NULL ELSE coalesce(held, dealt) END AS split, j.split <> 'test' AND coalesce(held = 'test', false) AS excluded FROM j LEFT JOIN z ON z.source = j.source AND z.category = j.category"""),
    "conflicting_contents": oracle(" SELECT sha256, string_agg(DISTINCT CAST(clip_id % 2 AS VARCHAR), ',' ORDER BY CAST(clip_id % 2 AS VARCHAR)) AS labels FROM v_clips GROUP BY sha256 HAVING count(DISTINCT clip_id % 2) > 1"),
    "import_outcomes": oracle(f""", {JUDGED}, j AS (SELECT i.seq, i.clip_id, f.clip_id AS owner, f.seq AS owned, hd.sha256 <> i.sha256 AND hd.seq < i.seq AS taken,
            f.source_video_id <> i.source_video_id OR f.split <> i.split OR f.population <> i.population AS other, coalesce(mixed, false) OR coalesce(lead.seq < i.seq AND (lead.split <> i.split OR (lead.population = 'evaluation') <> (i.population = 'evaluation')), false) AS crosses
            FROM inc i JOIN f ON f.sha256 = i.sha256 LEFT JOIN hd ON hd.clip_id = i.clip_id LEFT JOIN lead ON lead.source_video_id = i.source_video_id LEFT JOIN mx ON mx.source_video_id = i.source_video_id),
        o AS (SELECT seq, clip_id, owner, CASE WHEN taken THEN 'identity_conflict' WHEN seq <> owned AND other THEN 'membership_conflict' WHEN seq <> owned THEN 'duplicate' WHEN crosses THEN 'source_conflict' ELSE 'new' END AS outcome FROM j)
        SELECT seq, clip_id, outcome, CASE WHEN outcome = 'duplicate' THEN owner END AS "of" FROM o"""),
    "upload_outcomes": oracle(f""", kp AS ({duck(KEPT)}), up AS ({duck(UPLOADS)}), kn AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY clip_id, status) AS one FROM kp), x AS (SELECT *, first_value(token) OVER w AS head, first_value(seq) OVER w AS lead FROM up WINDOW w AS (PARTITION BY sha256 ORDER BY seq, token))
        SELECT x.seq, token, CASE WHEN kn.clip_id IS NULL THEN CASE WHEN x.seq = lead THEN 'new' ELSE 'duplicate' END WHEN status = 'available' THEN 'duplicate' ELSE 'refers_to_deleted' END AS outcome, coalesce(kn.clip_id, head) AS clip_id FROM x LEFT JOIN kn ON kn.sha256 = x.sha256 AND one = 1"""),
    "group_reasons": oracle(f", {EDGES}, r AS (SELECT a AS id, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM e GROUP BY a) SELECT o.id, o.root, coalesce(reasons, '') AS reasons FROM o LEFT JOIN r USING (id)"),
    "link_forest": oracle(f", {EDGES} SELECT id, root, parent, depth FROM fo WHERE id IN (SELECT a FROM e)"),
    "link_paths": oracle(f""", {EDGES}, p AS (SELECT DISTINCT a AS x, a + 14 AS y FROM e0), up AS (SELECT id, id AS above, depth FROM fo UNION ALL SELECT up.id, fo.parent, fo.depth - 1 FROM up JOIN fo ON fo.id = up.above WHERE fo.parent IS NOT NULL),
        r AS (SELECT p.x, p.y FROM p JOIN fo u ON u.id = p.x JOIN fo v ON v.id = p.y WHERE u.root = v.root),
        m AS (SELECT r.x, r.y, max(a.depth) AS low FROM r JOIN up a ON a.id = r.x JOIN up b ON b.id = r.y AND b.above = a.above GROUP BY 1, 2),
        t AS (SELECT m.x, m.y, a.above AS low, fo.parent AS top FROM m JOIN up a ON a.id IN (m.x, m.y) AND a.depth > m.low JOIN fo ON fo.id = a.above)
        SELECT x, y, least(t.low, t.top) AS a, greatest(t.low, t.top) AS b, (SELECT string_agg(DISTINCT reason, ',' ORDER BY reason) FROM e0 WHERE e0.a = least(t.low, t.top) AND e0.b = greatest(t.low, t.top)) AS reasons FROM t"""),
    "readiness_audit": oracle(f", {AUDITED} SELECT clip_id, array_to_string(present, ',') AS present, coalesce(array_to_string(missing, ','), '') AS missing, coalesce(array_to_string(repeated, ','), '') AS repeated, coalesce(array_to_string(conflicts, ','), '') AS conflicts FROM q"),
    "readiness_counts": oracle(f", {AUDITED}, z AS (SELECT unnest(list_concat(list_filter([{ORPHANS}], lambda x: x IS NOT NULL), list_concat(list_transform(repeated, lambda x: 'repeated:' || x), list_transform(conflicts, lambda x: 'conflict:' || x)))) AS kind FROM q) SELECT kind, count(*) AS n FROM z GROUP BY kind"),
    "recomputed_reports": oracle(""", c AS (SELECT collection, count(*) AS n, count(CASE WHEN score >= CAST(0.5 AS DOUBLE) THEN 1 END) AS flagged FROM v_scored GROUP BY 1)
        SELECT collection, 'counts.flagged' AS path, CAST(flagged + 1 AS VARCHAR) AS saved, CAST(flagged AS VARCHAR) AS computed FROM c WHERE collection = 'en'
        UNION ALL SELECT collection, 'alerts.rate', CAST(CAST(flagged AS DOUBLE) / CAST(n AS DOUBLE) + CAST(0.001 AS DOUBLE) AS VARCHAR), CAST(CAST(flagged AS DOUBLE) / CAST(n AS DOUBLE) AS VARCHAR) FROM c WHERE collection = 'es'
        UNION ALL SELECT collection, 'alerts.note', 'x', NULL FROM c WHERE collection = 'fr'"""),
    "scored_batch": oracle(""", x AS (SELECT *, regexp_full_match(start_text, '[0-9]+[.]?[0-9]*|[.][0-9]+') AND regexp_full_match(end_text, '[0-9]+[.]?[0-9]*|[.][0-9]+') AS ok FROM v_annotations),
        y AS (SELECT *, CASE WHEN playback_status = 'OK ' AND ok THEN CAST(end_text AS DOUBLE) - CAST(start_text AS DOUBLE) END AS seconds FROM x)
        SELECT clip_id, seconds, seconds > 20 AS flagged, CASE WHEN playback_status <> 'OK ' THEN 'LookupError: no such clip' WHEN NOT ok THEN 'ValueError: times are no numbers' END AS error, CAST(CASE WHEN seconds IS NULL THEN 2 ELSE 1 END AS INTEGER) AS attempts FROM y"""),
    "scored_batch_report": oracle(""", x AS (SELECT playback_status <> 'OK ' OR NOT regexp_full_match(start_text, '[0-9]+[.]?[0-9]*|[.][0-9]+') OR NOT regexp_full_match(end_text, '[0-9]+[.]?[0-9]*|[.][0-9]+') AS bad FROM v_annotations)
        SELECT count(*) AS rows, count(CASE WHEN bad THEN 1 END) AS failed, count(*) > 0 AND count(CASE WHEN bad THEN 1 END) = count(*) AS all_failed FROM x"""),
    "next_item_states": oracle(" SELECT job_id, item_seq, attempts, CASE WHEN status <> 'running' THEN status WHEN clip_id % 3 <> 0 THEN 'completed' WHEN attempts <= 2 THEN 'queued' ELSE 'failed' END AS status FROM v_items"),
}
