"""Queries that prepare and audit whole data sets over the fixture views, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelquery.functions.prefix import exact_quantiles
from reelquery.operators import preparation as p
from reelquery.plans.protocol_queries import duck, made
from reelquery.plans.views import oracle

TEXT = "VARCHAR(20)"
ID = f"CAST(clip_id AS {TEXT})"
#: Fixtures in the SQL of both engines; {name} is a view.
FILES = f"""SELECT clip_id, concat(CASE clip_id % 7 WHEN 0 THEN 'Abuse/' WHEN 1 THEN 'part1/Fighting/' WHEN 2 THEN 'Normal_Videos/' WHEN 3 THEN 'Training-Normal-Videos-Part-1/' WHEN 4 THEN 'Normal_Videos_Event/' WHEN 5 THEN 'Robbery/normal/' ELSE 'Unlisted/' END,
    'Clip', {ID}, CASE clip_id % 4 WHEN 0 THEN '_x264_3' WHEN 1 THEN '_X264' WHEN 2 THEN '_x264-b' ELSE '' END, '.mp4') AS name FROM {{v_clips}}"""
MAPPING = f"SELECT name, concat('SRC', CAST(clip_id % 9 AS {TEXT})) AS source FROM ({FILES}) f WHERE clip_id % 8 = 3"
LABELS = f"""SELECT name, CAST(CASE WHEN clip_id % 23 = 0 THEN 2 WHEN clip_id % 23 = 1 THEN NULL ELSE clip_id % 2 END AS INT) AS label, CASE clip_id % 3 WHEN 0 THEN 'Fighting' WHEN 1 THEN ' ' END AS category, CASE clip_id % 5 WHEN 0 THEN concat('Rec', {ID}) WHEN 1 THEN '' END AS source FROM ({FILES}) f WHERE clip_id % 13 <> 0
    UNION ALL SELECT concat('Lost/', {ID}), 1, 'Abuse', 'rec' FROM {{v_clips}} WHERE clip_id % 17 = 0 UNION ALL SELECT name, 1, 'Zero', 'zero' FROM ({FILES}) f WHERE clip_id % 19 = 4"""
EACH = "SELECT video_id AS sequence, CAST(row_number() OVER (PARTITION BY video_id ORDER BY clip_id) AS BIGINT) AS frame, clip_id AS event FROM {v_annotations}"
FRAMES = f"SELECT sequence, frame FROM ({EACH}) e WHERE NOT (sequence % 7 = 0 AND frame % 5 = 3) AND NOT (sequence % 31 = 9 AND frame > 20) AND sequence % 37 <> 8 UNION ALL SELECT sequence, frame FROM ({EACH}) e WHERE sequence % 11 = 0 AND frame = 2"
BOXES = f"""SELECT sequence, frame * 3 + k AS line, CASE WHEN event % 401 = 7 THEN 0 ELSE frame END AS frame, event % 100 - 5 AS x, CASE WHEN event % 97 = 0 THEN -300 ELSE event % 60 END + CASE WHEN event % 89 = 1 THEN 0 ELSE k END AS y, CASE WHEN event % 83 = 2 THEN 0 ELSE 10 + event % 7 END AS w, 20 AS h, CASE WHEN event % 211 = 5 THEN 9 WHEN event % 307 = 6 THEN NULL WHEN sequence % 10 = 3 AND frame % 20 = 11 THEN 1 ELSE 1 + (event + k) % 6 END AS action
    FROM ({EACH}) e, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) ks WHERE NOT (sequence % 41 = 6 AND frame % 10 = 1)"""
PARTS = "SELECT DISTINCT video_id AS sequence, CASE WHEN video_id % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM {v_annotations} WHERE video_id % 9 <> 1 UNION ALL SELECT DISTINCT video_id, 'test' FROM {v_annotations} WHERE video_id % 29 = 3"
CLIPS = f"""SELECT concat(category, '/', recording, '_x264/', CASE WHEN clip_id % 43 = 5 THEN 'other7' ELSE recording END, CASE WHEN clip_id % 47 = 9 THEN '' ELSE '_x264_' END, CASE WHEN clip_id % 53 = 2 THEN '0' ELSE {ID} END, '.mp4') AS name, concat('h', CAST(clip_id % 211 AS {TEXT})) AS sha256, clip_id % 12 <> 0 AS readable,
    CAST(320 + 10 * (clip_id % 3) AS INT) AS width, 240 AS height, CASE WHEN clip_id % 2 = 0 THEN '25' ELSE '30' END AS fps, duration
    FROM (SELECT *, concat(category, CAST(clip_id % 20 AS {TEXT})) AS recording FROM (SELECT *, CASE clip_id % 8 WHEN 0 THEN 'Normal' WHEN 1 THEN 'Abuse' WHEN 2 THEN 'Assault' WHEN 3 THEN 'Arson' WHEN 4 THEN 'Robbery' WHEN 5 THEN 'Vandalism' WHEN 6 THEN 'Shooting' ELSE 'Dancing' END AS category FROM {{v_clips}}) a) b"""
CLIP_LABELS = f"""SELECT DISTINCT clip_id, category, label FROM (SELECT concat(category, CAST(clip_id % 20 AS {TEXT}), '_x264_', {ID}) AS clip_id, CASE WHEN clip_id % 59 = 3 THEN 'Abuse' ELSE category END AS category, CAST(clip_id % 3 % 2 AS INT) AS label
    FROM (SELECT *, CASE clip_id % 8 WHEN 0 THEN 'Normal' WHEN 1 THEN 'Abuse' WHEN 2 THEN 'Assault' WHEN 3 THEN 'Arson' WHEN 4 THEN 'Robbery' WHEN 5 THEN 'Vandalism' WHEN 6 THEN 'Shooting' ELSE 'Dancing' END AS category FROM {{v_clips}}) a WHERE clip_id % 14 <> 1) b"""
WIDTH, HEIGHT = 90, 90


def sequences(s, d):
    return [made(s, d, sql, "v_annotations") for sql in (FRAMES, BOXES, PARTS)]


def scenes(s, d):
    return p.sequence_scenes(*sequences(s, d), WIDTH, HEIGHT)


def audited(s, d):
    return p.clip_audit(made(s, d, CLIPS), made(s, d, CLIP_LABELS))


def durations(s, d):
    rows = audited(s, d).where("readable")
    return exact_quantiles(rows, "duration", {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q100": 1.0}, ["category"])


QUERIES = {
    "folder_records": lambda s, d: p.folder_records(made(s, d, FILES).select("name"), made(s, d, MAPPING)),
    "labelled_records": lambda s, d: p.labelled_records(made(s, d, FILES).select("name"), made(s, d, LABELS), made(s, d, MAPPING)),
    "sequence_violations": lambda s, d: p.sequence_violations(*sequences(s, d), WIDTH, HEIGHT),
    "sequence_scenes": lambda s, d: scenes(s, d).select("sequence", "frame", "clip_id", "split", "group_label", F.size("actors").alias("actors"), F.array_join(F.transform("actors", lambda a: a["label"].cast("string")), ",").alias("labels"), F.aggregate("actors", F.lit(0.0), lambda t, a: t + a["x2"] - a["x1"]).alias("widths"), F.array_join(F.transform("frame_indices", lambda i: i.cast("string")), ",").alias("frames")),
    "box_corrections": lambda s, d: p.box_corrections(made(s, d, BOXES, "v_annotations"), WIDTH, HEIGHT),
    "scene_counts": lambda s, d: p.scene_counts(scenes(s, d)),
    "crowded_scenes": lambda s, d: p.crowded(scenes(s, d), 2),
    "clip_audit": lambda s, d: audited(s, d).select("name", "clip_id", "source", "category", "binary_label", "group_label", "selected", "reason", "code"),
    "clip_audit_counts": lambda s, d: p.audit_counts(audited(s, d)),
    "clip_audit_durations": durations,
    "labels_without_clips": lambda s, d: p.labels_without_clips(made(s, d, CLIPS), made(s, d, CLIP_LABELS)),
}
STEM = "regexp_replace(split_part({0}, '/', -1), '(.)[.][^.]*$', '\\1')"
TOLD = "CASE WHEN regexp_full_match({0}, '(?i).+\\d+_x264([_-].*)?') THEN lower(regexp_extract({0}, '(?i)^(.+\\d+)_x264', 1)) END"
of = lambda sql, x: sql.replace("{0}", x)
NAMED = f", files AS ({duck(FILES)}), mapped AS (SELECT name, lower(source) AS given FROM ({duck(MAPPING)}) m), labs AS ({duck(LABELS)})"
LISTED = ", ".join(f"'{x}'" for x in p.ABNORMAL)
NORMALS = ", ".join(f"'{x}'" for x in p.NORMAL)
SEQUENCES = f""", frames AS ({duck(FRAMES)}), boxes AS ({duck(BOXES)}), parts AS ({duck(PARTS)}),
    seen AS (SELECT *, greatest(0, x) AS l, greatest(0, y) AS t, least({WIDTH}, x + w) AS r, least({HEIGHT}, y + h) AS b FROM boxes),
    used AS (SELECT * FROM seen WHERE sequence IN (SELECT sequence FROM parts)),
    acted AS (SELECT sequence, frame, line, CAST(action - 2 AS INTEGER) AS label, CAST(r AS DOUBLE) / {WIDTH} AS x2, CAST(l AS DOUBLE) / {WIDTH} AS x1 FROM used WHERE frame % 10 = 1 AND action BETWEEN 2 AND 6 AND l < r AND t < b),
    scened AS (SELECT a.sequence, a.frame, p.split, n.last, list(a.label ORDER BY a.line) AS labels, list(x2 - x1 ORDER BY a.line) AS widths FROM acted a JOIN (SELECT sequence, min(split) AS split FROM parts GROUP BY 1) p USING (sequence) JOIN (SELECT sequence, max(frame) AS last FROM frames GROUP BY 1) n USING (sequence) GROUP BY ALL),
    scenes AS (SELECT *, (SELECT v FROM (SELECT unnest(labels) AS v) GROUP BY v ORDER BY count(*) DESC, v LIMIT 1) AS group_label FROM scened)"""
AUDITED = f""", clips AS ({duck(CLIPS)}), labs AS ({duck(CLIP_LABELS)}),
    told AS (SELECT *, {of(STEM, 'name')} AS clip_id, split_part(name, '/', 1) AS category, {of(TOLD, of(STEM, 'name'))} AS source, {of(TOLD, of(STEM, "split_part(name, '/', -2)"))} AS parent FROM clips),
    joined AS (SELECT t.*, b.label AS binary_label, b.category AS labelled, count(*) OVER (PARTITION BY t.clip_id) AS copies, CASE WHEN t.category IN ('Arson', 'Shooting', 'Dancing') OR (t.category = 'Normal' AND b.label = 1) OR b.label IS NULL THEN NULL WHEN b.label = 0 THEN 0 ELSE CAST(list_position(['Abuse', 'Assault', 'Fighting', 'Robbery', 'Vandalism'], t.category) AS INTEGER) END AS group_label FROM told t LEFT JOIN labs b USING (clip_id)),
    audited AS (SELECT *, CASE WHEN NOT readable THEN 'unreadable_video' WHEN labelled IS NULL THEN 'missing_or_invalid_annotation' WHEN group_label IS NULL THEN 'excluded_category' END AS reason,
        CASE WHEN copies > 1 THEN 'repeated_clip' WHEN source IS NULL OR source <> parent THEN 'source_disagreement' WHEN labelled <> category THEN 'category_disagreement' WHEN labelled IS NOT NULL AND category = 'Dancing' THEN 'unknown_category' WHEN category = 'Normal' AND binary_label = 1 THEN 'abnormal_normal' END AS code FROM joined)"""
CLASSES = "['crossing', 'waiting', 'queueing', 'walking', 'talking']"
ORACLES = {
    "folder_records": oracle(f"""{NAMED}, parts AS (SELECT name, list_filter(str_split(name, '/')[:-2], lambda x: lower(x) IN ({LISTED}, {NORMALS}))[1] AS category, {of(TOLD, of(STEM, 'name'))} AS told FROM files WHERE NOT list_has_any(list_transform(str_split(name, '/')[:-2], lambda x: lower(x)), ['normal_videos_for_event_recognition', 'normal_videos_event']))
        SELECT name, regexp_replace(name, '[.][^./]*$', '') AS video_id, coalesce(given, told) AS source, category, CAST(lower(category) IN ({LISTED}) AS INTEGER) AS label, CASE WHEN category IS NULL THEN 'unknown_category' WHEN coalesce(given, told) IS NULL THEN 'unknown_source' END AS code FROM parts LEFT JOIN mapped USING (name)"""),
    "labelled_records": oracle(f"""{NAMED}, given AS (SELECT name, count(*) AS n, min(label) AS label, min(CASE WHEN trim(category) <> '' THEN category END) AS category, min(CASE WHEN trim(source) <> '' THEN lower(source) END) AS source FROM labs GROUP BY name),
        j AS (SELECT coalesce(f.name, g.name) AS name, f.name IS NOT NULL AS there, g.n, g.label, g.category, g.source FROM files f FULL JOIN given g ON f.name = g.name),
        k AS (SELECT name, there, n, label, coalesce(category, split_part(name, '/', -2)) AS category, coalesce(source, given, {of(TOLD, of(STEM, 'name'))}) AS source FROM j LEFT JOIN mapped USING (name))
        SELECT name, source, category, label, CASE WHEN NOT there THEN 'missing_file' WHEN n IS NULL THEN 'missing_label' WHEN n > 1 THEN 'repeated_label' WHEN label IS NULL OR label NOT IN (0, 1) THEN 'unknown_label' WHEN source IS NULL THEN 'unknown_source' END AS code FROM k"""),
    "sequence_violations": oracle(f"""{SEQUENCES}, kept AS (SELECT DISTINCT sequence FROM parts), f AS (SELECT sequence, count(*) AS files, count(DISTINCT frame) AS n, min(frame) AS low, max(frame) AS high FROM frames GROUP BY 1), c AS (SELECT sequence, max(frame) AS last FROM used WHERE frame % 10 = 1 GROUP BY 1),
        w AS (SELECT * FROM kept LEFT JOIN f USING (sequence) LEFT JOIN c USING (sequence)), none AS (SELECT CAST(NULL AS BIGINT) AS x)
        SELECT sequence, x AS frame, 'crosses_splits' AS code FROM parts, none GROUP BY ALL HAVING count(DISTINCT split) > 1 UNION ALL SELECT sequence, x, 'repeated_sequence' FROM parts, none GROUP BY ALL HAVING count(DISTINCT split) = 1 AND count(*) > 1 UNION ALL SELECT sequence, x, 'no_frames' FROM w, none WHERE n IS NULL UNION ALL SELECT sequence, x, 'repeated_frame' FROM w, none WHERE files > n UNION ALL SELECT sequence, x, 'missing_frames' FROM w, none WHERE low <> 1 OR high <> n
        UNION ALL SELECT sequence, x, 'no_scenes' FROM w, none WHERE last IS NULL UNION ALL SELECT sequence, x, 'center_beyond_frames' FROM w, none WHERE last > high
        UNION ALL SELECT DISTINCT sequence, frame, 'broken_line' FROM used WHERE action IS NULL UNION ALL SELECT DISTINCT sequence, frame, 'invalid_frame' FROM used WHERE frame < 1 UNION ALL SELECT DISTINCT sequence, frame, 'unknown_action' FROM used WHERE action = 9
        UNION ALL SELECT DISTINCT sequence, frame, 'empty_box' FROM used WHERE w = 0 UNION ALL SELECT DISTINCT sequence, frame, 'invisible_box' FROM used WHERE w > 0 AND (l >= r OR t >= b) UNION ALL SELECT DISTINCT sequence, frame, 'outside_image' FROM used WHERE w > 0 AND l < r AND t < b AND (x, y, x + w, y + h) <> (l, t, r, b)
        UNION ALL SELECT DISTINCT sequence, frame, 'duplicate_box' FROM (SELECT sequence, frame FROM used WHERE action IS NOT NULL GROUP BY sequence, frame, l, t, r, b HAVING count(*) > 1) UNION ALL SELECT sequence, frame, 'no_actors' FROM used WHERE frame % 10 = 1 GROUP BY 1, 2 HAVING count(*) FILTER (action <> 1) = 0"""),
    "sequence_scenes": oracle(f"""{SEQUENCES} SELECT sequence, frame, CAST(sequence AS VARCHAR) || ':' || lpad(CAST(frame AS VARCHAR), 4, '0') AS clip_id, split, group_label, CAST(len(labels) AS INTEGER) AS actors, array_to_string(labels, ',') AS labels, list_sum(widths) AS widths, array_to_string(list_transform(range(-5, 5), lambda o: greatest(1, least(last, frame + o))), ',') AS frames FROM scenes"""),
    "box_corrections": oracle(f"{SEQUENCES} SELECT sequence, line, frame, x, y, w, h, l AS \"left\", t AS top, r AS \"right\", b AS bottom, frame % 10 = 1 AND action <> 1 AS selected FROM seen WHERE w > 0 AND l < r AND t < b AND (x, y, x + w, y + h) <> (l, t, r, b)"),
    "scene_counts": oracle(f"""{SEQUENCES}, grid AS (SELECT split, kind, value FROM (SELECT unnest(['train', 'val', 'test']) AS split), (SELECT unnest(['sequences', 'scenes', 'actors']) AS kind, '' AS value UNION ALL SELECT kind, value FROM (SELECT unnest(['actor_class', 'group_class']) AS kind), (SELECT unnest({CLASSES}) AS value))),
        found AS (SELECT split, 'sequences' AS kind, '' AS value, count(DISTINCT sequence) AS n FROM scenes GROUP BY 1 UNION ALL SELECT split, 'scenes', '', count(*) FROM scenes GROUP BY 1 UNION ALL SELECT split, 'actors', '', sum(len(labels)) FROM scenes GROUP BY 1
        UNION ALL SELECT split, 'group_class', {CLASSES}[group_label + 1], count(*) FROM scenes GROUP BY 1, 3 UNION ALL SELECT split, 'actor_class', {CLASSES}[v + 1], count(*) FROM (SELECT split, unnest(labels) AS v FROM scenes) GROUP BY 1, 3)
        SELECT split, kind, value, CAST(coalesce(n, 0) AS BIGINT) AS n FROM grid LEFT JOIN found USING (split, kind, value)"""),
    "crowded_scenes": oracle(f"{SEQUENCES} SELECT CAST(sequence AS VARCHAR) || ':' || lpad(CAST(frame AS VARCHAR), 4, '0') AS clip_id, CAST(len(labels) AS INTEGER) AS actors FROM scenes WHERE len(labels) > 2"),
    "clip_audit": oracle(f"{AUDITED} SELECT name, clip_id, source, category, binary_label, group_label, reason IS NULL AS selected, reason, code FROM audited"),
    "clip_audit_counts": oracle(f"""{AUDITED} SELECT 'total' AS kind, '' AS value, count(*) AS n FROM audited UNION ALL SELECT 'sources', '', count(DISTINCT source) FROM audited UNION ALL SELECT 'readable', CASE WHEN readable THEN 'yes' ELSE 'no' END, count(*) FROM audited GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM audited GROUP BY 2
        UNION ALL SELECT 'binary_label', coalesce(CAST(binary_label AS VARCHAR), 'none'), count(*) FROM audited GROUP BY 2 UNION ALL SELECT 'selected_class', ['Normal', 'Abuse', 'Assault', 'Fighting', 'Robbery', 'Vandalism'][group_label + 1], count(*) FROM audited WHERE reason IS NULL GROUP BY 2 UNION ALL SELECT 'exclusion', reason, count(*) FROM audited WHERE reason IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'resolution', CAST(width AS VARCHAR) || 'x240', count(*) FROM audited WHERE readable GROUP BY 2 UNION ALL SELECT 'fps', fps, count(*) FROM audited WHERE readable GROUP BY 2"""),
    "clip_audit_durations": oracle(f"{AUDITED} SELECT category, count(*) AS n, min(duration) AS q0, quantile_cont(duration, 0.25) AS q25, quantile_cont(duration, 0.5) AS q50, quantile_cont(duration, 0.75) AS q75, max(duration) AS q100 FROM audited WHERE readable GROUP BY category"),
    "labels_without_clips": oracle(f"{AUDITED} SELECT clip_id FROM labs WHERE clip_id NOT IN (SELECT clip_id FROM told)"),
}
