"""The review queue over readiness records, its screening counts, ranked examples, cached results and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from reelquery.functions.prefix import running_totals
from reelquery.operators.metrics import count_if


def review_queue(records: DataFrame, candidates: DataFrame) -> DataFrame:
    """clip_id, collection, quality_status, priority, flags (sorted), turn (its place in the queue, from 1).

    records: clip_id, collection, normalized_label, issues (array), readable, conflict (its annotation and catalog differ),
    reserved, reviewed_at (text). candidates: a, b (pairs of possible duplicates). Quality holds, duplicate candidates, positives
    that need a second look and conflicts come first; then all by collection and clip. A pair with an unknown clip raises, and
    so does a clip with several records."""
    repeated = records.groupBy("clip_id").count().where("count > 1").head(5)
    if repeated:
        raise ValueError(f"clips with several records: {repeated}")
    ids = candidates.select(F.explode(F.array("a", "b")).alias("clip_id")).distinct()
    unknown = ids.join(records, "clip_id", "left_anti").head(5)
    if unknown:
        raise ValueError(f"duplicate candidates of unknown clips: {unknown}")
    rows = records.join(ids.withColumn("_pair", F.lit(True)), "clip_id", "left").withColumn("_pair", F.coalesce("_pair", F.lit(False)))
    hold = (F.size("issues") > 0) | ~F.col("readable")
    second = ~hold & F.coalesce(F.col("normalized_label") == "violence", F.lit(False))
    cases = [  # fixed values: the names of the flags
        (F.lit(True), "unverified_source_incident_and_overlap"),
        (~F.col("readable"), "strict_loader_media_hold"),
        (second, "candidate_positive_second_look"),
        (F.col("_pair"), "duplicate_or_visual_candidate_review"),
        (F.col("conflict"), "annotation_catalog_status_or_source_conflict"),
        (F.col("reserved"), "municipal_reservation_keep_out_of_optimization"),
        (F.trim(F.coalesce("reviewed_at", F.lit(""))) == "", "review_timestamp_missing"),
    ]
    flags = F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*[F.when(when, flag) for when, flag in cases])), "issues")))
    first = hold | F.col("_pair") | second | F.col("conflict")
    rows = rows.select("clip_id", "collection", F.when(hold, "quarantine").otherwise("candidate_only_not_approved").alias("quality_status"), F.when(first, "first").otherwise("source_evidence").alias("priority"), flags.alias("flags"))
    # the queue is cut by (priority, collection), so no task orders all of it
    part = rows.groupBy("priority", "collection").agg(F.count("*").alias("_n"))
    before = part.select("priority", "collection", (F.sum("_n").over(W.orderBy("priority", "collection")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(W.partitionBy("priority", "collection").orderBy("clip_id"))
    return rows.withColumn("_inside", inside).join(before, ["priority", "collection"]).withColumn("turn", F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def screening_counts(queue: DataFrame, records: DataFrame) -> DataFrame:
    """kind, key, n: how often each flag stands, records and first ones, and labels by collection (missing ones too)."""
    flags = queue.select(F.explode("flags").alias("key")).groupBy("key").agg(F.count("*").alias("n")).select(F.lit("flag").alias("kind"), "key", "n")
    size = queue.groupBy("priority").agg(F.count("*").alias("n")).select(F.lit("priority").alias("kind"), F.col("priority").alias("key"), "n")
    label = F.concat_ws("/", "collection", F.coalesce("normalized_label", F.lit("missing")))
    labels = records.groupBy(label.alias("key")).agg(F.count("*").alias("n")).select(F.lit("label").alias("kind"), "key", "n")
    return flags.unionByName(size).unionByName(labels)


def name_families(df: DataFrame, hint: Column, collection: str = "collection", key: str = "clip_id") -> DataFrame:
    """collection, hint, clips, first: file-name families of more than one clip. A family is a hint, not a proven incident."""
    rows = df.withColumn("hint", hint).where("hint IS NOT NULL AND hint <> ''")
    return rows.groupBy(collection, "hint").agg(F.count("*").alias("clips"), F.min(key).alias("first")).where("clips > 1")


def ranked_examples(df: DataFrame, threshold: float, each: int = 5, key: str = "clip_id") -> DataFrame:
    """role (correct or failure), turn, clip_id: positives at or above the threshold by falling score, filled up with the
    calmest negatives; positives below it by falling score, filled up with the highest negatives, those at or above the
    threshold first. All missed positives are shown, also beyond `each`. df has label and score; ties go by id."""
    positive, score = F.col("label") == 1, F.col("score")
    high = score >= threshold
    cases = {
        "correct": [(positive & high, 0, -score), (~positive, 1, score)],
        "failure": [(positive & ~high, 0, -score), (~positive, 1, -score)],
    }
    out = None
    for role, parts in cases.items():
        (main, _, by), (other, _, calm) = parts
        own = df.where(main).select(key, by.alias("_by"))
        rest = df.where(other).select(key, calm.alias("_by")).orderBy("_by", key).limit(each)
        if role == "correct":
            own = own.orderBy("_by", key).limit(each)
            shown = own.withColumn("turn", F.row_number().over(W.orderBy("_by", key)))
        else:
            # every missed positive is shown: its turn is the number of those with a higher score, and its place among equals
            counts = running_totals(own.groupBy("_by").agg(F.count("*").alias("_n")), "_by", ["_n"]).select("_by", (F.col("cum__n") - F.col("_n")).alias("_before"))
            shown = own.join(counts, "_by").withColumn("turn", F.col("_before") + F.row_number().over(W.partitionBy("_by").orderBy(key)))
        filled = rest.withColumn("turn", F.row_number().over(W.orderBy("_by", key))).join(own.agg(F.count("*").alias("_mine")))
        filled = filled.withColumn("turn", F.col("turn") + F.col("_mine")).where(F.col("turn") <= each)
        picked = shown.select(key, F.col("turn").cast("int").alias("turn")).unionByName(filled.select(key, F.col("turn").cast("int").alias("turn")))
        picked = picked.select(F.lit(role).alias("role"), "turn", key)
        out = picked if out is None else out.unionByName(picked)
    return out


def cached_results(requests: DataFrame, cache: DataFrame, provenance: str, version: int = 1) -> DataFrame:
    """request_id, outcome, result: the cached result of each request's content. requests: request_id, expected (a frozen
    digest or null), sha256; cache: sha256, schema_version, provenance, result. A frozen example whose content changed, a result of
    another version or of another model are no hits and say so; nothing cached is a miss."""
    rows = requests.join(cache.withColumnRenamed("provenance", "_from"), "sha256", "left")
    outcome = (
        F.when(F.col("expected").isNotNull() & (F.col("expected") != F.col("sha256")), "content_changed")
        .when(F.col("schema_version").isNull(), "miss")
        .when(F.col("schema_version") != version, "unsupported_version")
        .when(F.col("_from") != provenance, "other_provenance")
        .otherwise("hit")
    )
    return rows.select("request_id", outcome.alias("outcome"), F.when(outcome == "hit", F.col("result")).alias("result"))


def schedule(rows: DataFrame, arms: dict[str, Column], batch: int, source: str = "source_video_id") -> DataFrame:
    """arm, clips, steps, warmup: two passes over an arm's training clips in whole hundreds of steps, and a sixth of them in
    whole tens. arms says of each training source whether it belongs."""
    named = F.array_compact(F.array(*[F.when(when, name) for name, when in arms.items()]))
    counts = rows.where("split = 'train'").withColumn("arm", F.explode(named)).groupBy("arm").agg(F.count("*").alias("clips"))
    steps = (F.ceil(2 * F.col("clips") / batch / 100) * 100).cast("long")
    return counts.withColumn("steps", steps).withColumn("warmup", (F.bround(F.col("steps") / 60, 0) * 10).cast("long"))


def audit_tail(events: DataFrame, n: int, order: str = "event_id") -> DataFrame:
    """The n latest events, latest first, with their turn."""
    rows = events.orderBy(F.col(order).desc()).limit(n)
    return rows.withColumn("turn", F.row_number().over(W.orderBy(F.col(order).desc())))


def mode_deltas(rows: DataFrame, base: str) -> DataFrame:
    """mode, clips, coverage, accuracy, full_correct and their differences from the base mode. rows: mode, truth, prediction."""
    per = rows.groupBy("mode").agg(F.count("*").alias("clips"), F.count("prediction").alias("covered"), count_if(F.col("prediction") == F.col("truth")).alias("correct"))
    per = per.select("mode", "clips", (F.col("covered") / F.col("clips")).alias("coverage"), F.try_divide("correct", "covered").alias("accuracy"), (F.col("correct") / F.col("clips")).alias("full_correct"))
    own = per.where(F.col("mode") == base).select(*[F.col(c).alias(f"_{c}") for c in ("coverage", "accuracy", "full_correct")])
    joined = per.join(F.broadcast(own))
    return joined.select(*per.columns, *[(F.col(c) - F.col(f"_{c}")).alias(f"{c}_delta") for c in ("coverage", "accuracy", "full_correct")])
