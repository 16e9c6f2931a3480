"""The registered queries opN_<name> of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.llm.alignment import group_digests, link_scores
from reelquery.llm.common import checkpoint, checkpoint_dir, fold, remove, table
from reelquery.llm.encoding import decode, encode
from reelquery.llm.langid import identify
from reelquery.llm.licenses import scan
from reelquery.llm.mixing import taken_words
from reelquery.llm.packing import pack
from reelquery.llm.quality import judge
from reelquery.llm.runs import periodic_runs, with_repeats
from reelquery.llm.sharding import shards_of
from reelquery.llm.shinglejoin import near_duplicates
from reelquery.llm.topk import top_k
from reelquery.llm.toxicity import fit, score_toxicity
from reelquery.llm.warc import archive_round_trip


def held_out() -> Column:
    """Whether a document is in fold 0; false for rows without doc_id."""
    return F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out")


def op1_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = judge(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op5_trained_license_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_word_first_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    found = identify(docs.select("doc_id", "text"), docs.where(fold("doc_id") != 0))
    return found.select("doc_id", held_out(), "lang_pred", "score")


def op7_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards_of(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows.where(F.col("vec_id") % 50 == 0), rows, k=5)


def op9_count_vector_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_maximum_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs.where(fold("doc_id") != 0), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    found = score_toxicity(docs, model)
    return found.select("doc_id", held_out(), "score", "predicted", F.size("segments").alias("n_passages"), F.col("segments").alias("passages"))


def op11_distinct_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_byte_owner_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/aligned-{uuid.uuid4().hex}"
    group_digests(table(spark, sf_dir, "documents").select("doc_id", "text")).write.parquet(folder, compression="zstd")
    aligned = spark.read.parquet(folder)
    texts = aligned.where("slot IS NULL").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")
    found = checkpoint(link_scores(texts, aligned.where("slot IS NOT NULL").select("chunk", "slot", "a", "b", "n")))
    remove(spark, folder)
    return found


def op13_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", with_repeats(F.col("doc_id"), F.col("text")).alias("text")))
    longest = F.get(F.array_sort("runs", lambda a, b: F.when(a["length"] != b["length"], b["length"] - a["length"]).when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"]).cast("int")), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"longest.{name}").alias(name) for name in ("start", "length", "period")],
        F.floor(1000 * F.col("longest.length") / F.col("longest.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_distribution_divergence,
        op2_low_discrepancy_mix,
        op3_best_fit_packing,
        op4_warc_round_trip,
        op5_trained_license_classifier,
        op6_word_first_backoff,
        op7_extendible_hashing,
        op8_exact_topk,
        op9_count_vector_rtree,
        op10_maximum_segments,
        op11_distinct_word_table,
        op12_byte_owner_arrays,
        op13_lyndon_runs,
    )
}

ORACLES = {
    "op7_extendible_hashing": """
        WITH d AS (
            SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS h, coalesce(strlen(text), 0) AS bytes FROM documents),
        x AS (
            SELECT d.*, CAST(depth AS INTEGER) AS depth, h >> CAST(60 - depth AS BIGINT) AS prefix FROM d, range(0, 61) r(depth)),
        s AS (
            SELECT *, CAST(sum(bytes) OVER w AS BIGINT) AS shard_bytes, min(h) OVER w AS low, max(h) OVER w AS high
            FROM x WINDOW w AS (PARTITION BY depth, prefix)),
        b AS (
            SELECT doc_id, bytes, depth, prefix, shard_bytes, min(depth) OVER (PARTITION BY doc_id, h) AS least
            FROM s WHERE shard_bytes <= 16777216 OR low = high)
        SELECT doc_id, bytes, depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, shard_bytes FROM b WHERE depth = least""",
    "op9_count_vector_rtree": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles
            FROM w),
        e AS MATERIALIZED (SELECT doc_id, unnest(shingles) AS shingle FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS MATERIALIZED (
            SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
            WHERE 100 * n >= 80 * (len(x.shingles) + len(y.shingles) - n)),
        c AS (
            SELECT doc_id AS id, doc_id AS reached FROM s
            UNION SELECT c.id, l.b FROM c JOIN l ON l.a = c.reached)
        SELECT s.doc_id, len(s.shingles) AS n_shingles, min(c.reached) AS component_id
        FROM s JOIN c ON c.id = s.doc_id GROUP BY s.doc_id, len(s.shingles)""",
    "op2_low_discrepancy_mix": """
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5('7:' || CAST(doc_id AS VARCHAR)) AS mark
            FROM documents),
        p AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1) AS DOUBLE) AS weight
            FROM d GROUP BY source),
        w AS (
            SELECT *, CAST(2 * source_size AS DOUBLE) AS lim, CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE) AS total,
                coalesce(sum(CAST(2 * source_size AS DOUBLE)) OVER (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                sum(weight) OVER (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
            FROM p),
        f AS (SELECT *, lim * rest <= (total - before) * weight AS is_full FROM w),
        t AS (
            SELECT *, CASE WHEN is_full THEN lim ELSE (total - sum(CASE WHEN is_full THEN lim ELSE 0 END) OVER ()) / (sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ()) * weight END AS target
            FROM f),
        s AS (
            SELECT d.doc_id, d.size, t.source_size, t.target, least(CAST(round(t.target) AS BIGINT), 2 * t.source_size) AS words,
                CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.mark, d.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
            greatest(0, least(start + size, words) - start) + greatest(0, least(start + size, words - source_size) - start) AS taken
        FROM s""",
    "op4_warc_round_trip": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
        b AS (
            SELECT *, min(page_id) OVER (PARTITION BY hex) AS first,
                list_reduce(list_transform(range(8), lambda g: list_reduce(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                    CAST((CAST('0x' || substr(hex, CAST(5 * g + 1 AS BIGINT), 5) AS BIGINT) >> s) & 31 AS BIGINT) + 1, 1)), lambda x, y: x || y)), lambda x, y: x || y) AS payload_digest
            FROM p)
        SELECT page_id, strlen(html) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM b""",
    "op8_exact_topk": """
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(CAST(256 AS DOUBLE) * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 5""",
}
