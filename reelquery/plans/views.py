"""Fixture views over the test tables: the same SQL for Spark and DuckDB, but for one hash each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Views by name; {table} names a table, {sha} and {bits} an expression that the engines write differently.
VIEWS = {
    "v_scored": "SELECT d.doc_id AS clip_id, d.source AS source_video_id, d.lang AS collection, l.toxic AS label, CAST(d.n_chars % 1000 AS DOUBLE)/CAST(1000 AS DOUBLE) AS score FROM {documents} d JOIN {labels} l ON d.doc_id=l.doc_id",
    "v_clips": "SELECT doc_id AS clip_id, source AS source_video_id, lang AS collection, {sha} AS sha256, CAST(n_chars AS DOUBLE)/CAST(25 AS DOUBLE) AS duration, CASE WHEN ascii(substr(source, length(source), 1)) % 10 < 7 THEN 'train' WHEN ascii(substr(source, length(source), 1)) % 10 = 7 THEN 'val' ELSE 'test' END AS split FROM {documents}",
    "v_segments": "SELECT video_id, seg, CAST(seg AS DOUBLE) AS start_s, CAST(seg+1 AS DOUBLE) AS end_s, score FROM (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS seg, CASE WHEN value>=200 THEN CAST(1 AS DOUBLE) ELSE value/CAST(200 AS DOUBLE) END AS score FROM {events}) t WHERE seg % 7 <> 0",
    "v_intervals": "SELECT user_id AS video_id, CAST(event_id AS DOUBLE) AS start_s, CAST(event_id + 5 + event_id % 40 AS DOUBLE) AS end_s FROM {events}",
    "v_multiclass": "SELECT event_id AS clip_id, user_id AS source_video_id, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS truth, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST((event_id + CAST(floor(value) AS BIGINT)) % 5 AS INT) END AS prediction FROM {events}",
    "v_jobs": "SELECT o_orderkey AS job_id, o_orderdate AS created_at, CASE WHEN o_orderstatus='P' THEN 1 ELSE 0 END AS cancel_requested FROM {orders}",
    "v_items": "SELECT l_orderkey AS job_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) AS item_seq, l_partkey AS clip_id, CASE WHEN l_returnflag='R' THEN 'failed' WHEN l_returnflag='A' THEN 'cancelled' WHEN l_linestatus='O' AND l_linenumber % 2 = 0 THEN 'queued' WHEN l_linestatus='O' AND l_linenumber % 5 = 0 THEN 'running' ELSE 'completed' END AS status, CAST(l_quantity AS INT) % 4 AS attempts FROM {lineitem}",
    "v_boxes": "SELECT l_orderkey AS scene_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) AS box_id, CASE WHEN l_linenumber % 2 = 1 THEN 'gt' ELSE 'det' END AS side, CAST(l_partkey % 20 AS DOUBLE) AS x1, CAST(l_suppkey % 20 AS DOUBLE) AS y1, CAST(l_partkey % 20 AS DOUBLE)+10+l_quantity AS x2, CAST(l_suppkey % 20 AS DOUBLE)+10+l_quantity AS y2, l_discount*10 AS score FROM {lineitem}",
    "v_hash": "SELECT vec_id, label, {bits} AS h FROM {embeddings}",
    # annotation rows with valid and broken times and labels
    "v_annotations": "SELECT event_id AS clip_id, user_id AS video_id, CASE event_id % 6 WHEN 0 THEN 'Violence' WHEN 1 THEN ' non-violence ' WHEN 2 THEN 'NOT  sure' WHEN 3 THEN 'non_violence' WHEN 4 THEN 'violence' ELSE CASE WHEN event_id % 12 = 5 THEN '' ELSE 'fight' END END AS label, CASE WHEN event_id % 11 = 0 THEN 'broken' ELSE 'OK ' END AS playback_status, CASE WHEN event_id % 13 = 0 THEN 'n/a' ELSE CAST(20 + event_id % 50 AS VARCHAR(9)) END AS duration, CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN CAST(event_id % 30 AS VARCHAR(9)) WHEN event_id % 4 = 2 THEN concat('0:', lpad(CAST(event_id % 75 AS VARCHAR(9)), 2, '0')) ELSE concat(CAST(event_id % 9 AS VARCHAR(9)), '.5') END AS start_text, CASE WHEN event_id % 4 = 0 AND event_id % 8 = 0 THEN '' WHEN event_id % 5 = 0 THEN concat('1:', lpad(CAST(event_id % 60 AS VARCHAR(9)), 2, '0'), '.25') WHEN event_id % 5 = 1 THEN '1:2:3' ELSE CAST(event_id % 80 AS VARCHAR(9)) END AS end_text FROM {events}",
    # routed windows of the cascade: the class and the actors of a segment
    "v_windows": "SELECT video_id, seg, start_s, end_s, score, CASE WHEN seg % 5 = 0 THEN 0 ELSE CAST(1 + seg % 3 AS INT) END AS actors, CASE WHEN seg % 5 = 0 THEN NULL ELSE CAST((video_id + seg * 7) % 6 AS INT) END AS behavior FROM ({v_segments}) s",
    "v_truth": "SELECT DISTINCT user_id AS video_id, CAST(user_id % 6 AS INT) AS group_label, concat('cam', CAST(user_id % 8 AS VARCHAR(9))) AS source_video_id FROM {events}",
}
TABLES = ("documents", "labels", "events", "orders", "lineitem", "embeddings", "customer", "part", "supplier", "nation", "region")
SPARK = {
    "sha": "sha2(text, 256)",
    "bits": "aggregate(sequence(0, 61), 0L, (a, i) -> a | IF(embedding[i] > 0, shiftleft(1L, i), 0L))",
}
DUCKDB = {
    "sha": "sha256(text)",
    "bits": "CAST(list_sum(list_transform(range(62), lambda i: CASE WHEN embedding[i+1]>0 THEN (CAST(1 AS BIGINT) << i) ELSE CAST(0 AS BIGINT) END)) AS BIGINT)",
}


def named(sql: str, names: dict[str, str]) -> str:
    for name, text in names.items():
        sql = sql.replace("{" + name + "}", text)
    return sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view over the tables under sf_dir."""
    sql = named(VIEWS[name], {"v_segments": VIEWS["v_segments"]} | SPARK)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def oracle(body: str) -> str:
    """DuckDB SQL of body after definitions of the views that it names."""
    found = {n: named(VIEWS[n], {"v_segments": VIEWS["v_segments"]} | DUCKDB | {t: t for t in TABLES}) for n in VIEWS if n in body}
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({sql})" for n, sql in found.items()) + body if found else body
