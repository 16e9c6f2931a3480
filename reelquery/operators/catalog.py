"""Jobs, items, reviews and exports: the queue's state transitions as queries, and population-gated reporting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from reelquery.functions.prefix import ratio
from reelquery.operators.metrics import count_if

ACTIVE = ("queued", "running")


def records(items: DataFrame, jobs: DataFrame, clips: DataFrame, reviews: DataFrame, references: DataFrame) -> DataFrame:
    """Items with their job and clip, the number of reviews, the latest review and the latest reference of the clip.
    reviews: job_id, item_seq, seq, decision; references: clip_id, version, payload."""
    own = reviews.groupBy("job_id", "item_seq").agg(F.count("*").alias("reviews"), F.max_by("decision", "seq").alias("latest_review"))
    latest = references.groupBy("clip_id").agg(F.max("version").alias("version"), F.max_by("payload", "version").alias("reference"))
    rows = items.join(jobs, "job_id").join(clips, "clip_id").join(own, ["job_id", "item_seq"], "left").join(latest, "clip_id", "left")
    return rows.fillna(0, ["reviews"])


def latest_eligible(rows: DataFrame, eligible: Column, key: str = "clip_id", order: tuple[str, ...] = ("created_at", "job_id", "item_seq")) -> DataFrame:
    """The last eligible row per key; later rows that are not eligible never displace it."""
    return rows.where(eligible).groupBy(key).agg(F.max(F.struct(*order, *[c for c in rows.columns if c not in (key, *order)])).alias("_row")).select(key, "_row.*")


def job_states(items: DataFrame) -> DataFrame:
    """job_id, state, progress: running before queued while anything is open; then failed, cancelled, completed."""
    status = F.col("status")
    has = lambda s: F.max(F.when(status == s, 1).otherwise(0)) == 1
    state = F.when(has("running"), "running").when(has("queued"), "queued").when(has("failed"), "failed").when(has("cancelled"), "cancelled").otherwise("completed")
    return items.groupBy("job_id").agg(state.alias("state"), ratio(count_if(~status.isin(*ACTIVE)), F.count("*")).alias("progress"), F.count("*").alias("items"))


def dashboard(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """state, jobs, completed_items, pending: jobs by state, and the completed items of those jobs without a review."""
    open_ = items.where("status = 'completed'").join(reviews.select("job_id", "item_seq").distinct(), ["job_id", "item_seq"], "left_anti").groupBy("job_id").agg(F.count("*").alias("pending"))
    rows = job_states(items).join(open_, "job_id", "left")
    return rows.groupBy("state").agg(F.count("*").alias("jobs"), F.coalesce(F.sum("pending"), F.lit(0)).alias("pending"))


def claim(items: DataFrame, jobs: DataFrame, n: int = 1) -> DataFrame:
    """The n oldest queued items of jobs that are not to be cancelled."""
    rows = items.where("status = 'queued'").join(jobs.where("cancel_requested = 0"), "job_id")
    return rows.orderBy("created_at", "job_id", "item_seq").limit(n)


def recover(items: DataFrame, jobs: DataFrame, max_retries: int) -> DataFrame:
    """items after a restart: running ones are queued again within max_retries and failed beyond; queued ones of jobs that
    are to be cancelled are cancelled."""
    rows = items.join(jobs.select("job_id", "cancel_requested"), "job_id")
    status = F.when(F.col("status") != "running", F.col("status")).when(F.col("attempts") <= max_retries, "queued").otherwise("failed")
    rows = rows.withColumn("_status", status)
    final = F.when((F.col("_status") == "queued") & (F.col("cancel_requested") == 1), "cancelled").otherwise(F.col("_status"))
    return rows.withColumn("status", final).select(*items.columns)


def cancel(items: DataFrame, job_ids: DataFrame) -> DataFrame:
    """items after cancelling jobs: what is queued is cancelled, what runs may finish."""
    hit = job_ids.select("job_id").distinct().withColumn("_hit", F.lit(True))
    rows = items.join(hit, "job_id", "left")
    return rows.withColumn("status", F.when(F.col("_hit") & (F.col("status") == "queued"), "cancelled").otherwise(F.col("status"))).select(*items.columns)


def retry_requests(items: DataFrame) -> DataFrame:
    """job_id, clip_id of what a retry submits again."""
    return items.where(F.col("status").isin("failed", "cancelled")).select("job_id", "clip_id").distinct()


def submit(existing: DataFrame, requests: DataFrame) -> DataFrame:
    """key, request_hash, outcome of requests (key, request_hash, seq) against existing jobs (key, request_hash): created for
    a key's first request, replayed for equal later ones, conflict for a key that stands for another request."""
    known = existing.select("key", F.col("request_hash").alias("_known"))
    first = F.first("request_hash").over(W.partitionBy("key").orderBy("seq"))
    turn = F.row_number().over(W.partitionBy("key").orderBy("seq"))
    rows = requests.withColumn("_first", first).withColumn("_turn", turn).join(known, "key", "left")
    owner = F.coalesce("_known", "_first")
    outcome = F.when(F.col("request_hash") != owner, "conflict").when(F.col("_known").isNull() & (F.col("_turn") == 1), "created").otherwise("replayed")
    return rows.select("key", "request_hash", "seq", outcome.alias("outcome"))


def append_versions(existing: DataFrame, proposals: DataFrame) -> DataFrame:
    """clip_id, expected_version, accepted, version: a proposal is accepted if it expects the clip's latest version (0 for
    none); of several that do, the first by seq."""
    latest = existing.groupBy("clip_id").agg(F.max("version").alias("_latest"))
    rows = proposals.join(latest, "clip_id", "left").fillna(0, ["_latest"]).withColumn("_fits", F.col("expected_version") == F.col("_latest"))
    turn = F.row_number().over(W.partitionBy("clip_id", "_fits").orderBy("seq"))
    accepted = F.col("_fits") & (turn == 1)
    return rows.select("clip_id", "seq", "expected_version", accepted.alias("accepted"), F.when(accepted, F.col("_latest") + 1).alias("version"))


def retention(uploads: DataFrame, now: str, days: int) -> DataFrame:
    """Uploads imported more than `days` days before now."""
    return uploads.where(F.col("imported_at") < F.to_timestamp_ntz(F.lit(now)) - F.make_interval(days=F.lit(days)))


def csv_safe(text: Column) -> Column:
    """Text that no spreadsheet takes for a formula: a quote before what begins with = + - or @ after white space."""
    return F.when(F.ltrim(text).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def export_rows(rows: DataFrame, permission: Column, columns: list[str], texts: list[str]) -> DataFrame:
    """Permitted rows, the named columns alone, with texts made safe."""
    return rows.where(permission).select(*[csv_safe(F.col(c)).alias(c) if c in texts else F.col(c) for c in columns])


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of at most 1000 rows, with the total number of rows."""
    if not 0 <= offset or not 0 < limit <= 1000:
        raise ValueError("expected offset >= 0 and 0 < limit <= 1000")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))


def job_details(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs with their state, progress and ordered items."""
    own = items.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("item_seq", "clip_id", "status", "attempts"))).alias("item_list"))
    return jobs.join(job_states(items), "job_id").join(own, "job_id")


def current_revisions(events: DataFrame) -> DataFrame:
    """The result of each session's latest revision; stale ones are left out (session, revision, result)."""
    return events.groupBy("session").agg(F.max("revision").alias("revision"), F.max_by("result", "revision").alias("result"))


def delete_uploads(uploads: DataFrame, requested: DataFrame, items: DataFrame) -> DataFrame:
    """uploads after deleting the bytes of owned clips without open items; identity and results stay, as status deleted."""
    active = items.where(F.col("status").isin(*ACTIVE)).select("clip_id").distinct()
    hit = requested.select("clip_id").distinct().join(active, "clip_id", "left_anti").withColumn("_hit", F.lit(True))
    rows = uploads.join(hit, "clip_id", "left")
    gone = F.coalesce(F.col("_hit"), F.lit(False)) & F.col("owned")
    return rows.withColumn("status", F.when(gone, "deleted").otherwise(F.col("status"))).select(*uploads.columns)


def new_reviews(existing: DataFrame, proposals: DataFrame, items: DataFrame) -> DataFrame:
    """Reviews (job_id, item_seq, decision) that may be appended, with their seq: only of completed items, after those there."""
    done = items.where("status = 'completed'").select("job_id", "item_seq")
    last = existing.groupBy("job_id", "item_seq").agg(F.max("seq").alias("_last"))
    rows = proposals.join(done, ["job_id", "item_seq"], "left_semi").join(last, ["job_id", "item_seq"], "left")
    turn = F.row_number().over(W.partitionBy("job_id", "item_seq").orderBy("decision"))
    return rows.select("job_id", "item_seq", "decision", (F.coalesce("_last", F.lit(0)) + turn).alias("seq"))


def snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    """Copy tables to a new folder; an existing target is an error."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")
