"""The registered queries of the review engine, and their DuckDB SQL."""

from __future__ import annotations

from reelquery.plans import box_queries, freezing_queries, graph_queries, interval_queries, metric_queries, preparation_queries, protocol_queries, registration_queries, review_queries, review_tables, study_queries, table_queries

PARTS = (metric_queries, interval_queries, graph_queries, review_queries, box_queries, study_queries, table_queries, review_tables, protocol_queries, freezing_queries, preparation_queries, registration_queries)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
