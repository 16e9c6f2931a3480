"""What may be reused and what may be run: caches checked against clips, a prior audit against the files of today, pinned
models, a frozen evaluation policy, and experiments registered once."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.operators.imports import claim
from reelquery.operators.integrity import canonical
from reelquery.operators.intervals import centered_frames


def _listed(cases: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.lit(code)) for when, code in cases]))


def cache_fingerprint() -> Column:
    """A hash of a cached detection: boxes, person_labels, image_size and scores, in their order."""
    return F.sha2(F.to_json(F.struct("boxes", "image_size", "person_labels", "scores")), 256)


def stale_caches(caches: DataFrame, clips: DataFrame, detector: str, filters: str) -> DataFrame:
    """clip_id, codes of cached detections that may not be used for their clips; clips without a cache are missing_cache.

    clips: clip_id, source_video_id, group_label, split, sha256, num_frames. caches: the same identity, schema_version,
    video_sha256, coordinates, frame_indices, reference_frame, checkpoint_sha256, filter_config, boxes, scores, person_labels,
    image_size, fingerprint. The sampled frames must be the ten around the clip's middle, with the sixth as reference; nulls
    differ from everything but null. Caches are compared where they are: one join by clip_id, nothing is collected."""
    own = ["source_video_id", "group_label", "split"]
    want = clips.select("clip_id", *[F.col(c).alias(f"_{c}") for c in own], F.col("sha256").alias("_sha256"), F.col("num_frames").cast("int").alias("_n"), F.lit(True).alias("_clip"))
    copies = caches.groupBy("clip_id").agg(F.count("*").alias("_copies"))
    rows = caches.withColumn("_cache", F.lit(True)).join(copies, "clip_id").join(want, "clip_id", "full")
    frames = centered_frames(F.expr("_n div 2").cast("int"), F.lit(0), F.col("_n"))
    differs = lambda a, b: ~a.eqNullSafe(b)
    both = F.col("_cache") & F.col("_clip")
    cases = [(F.col("_cache").isNull(), "missing_cache"), (F.col("_clip").isNull(), "unknown_clip"), (F.col("_copies") > 1, "repeated_cache")]
    cases += [(both & differs(F.col(c), F.col(f"_{c}")), f"identity:{c}") for c in own]
    cases += [(both & when, f"stale:{name}") for name, when in {
        "schema_version": differs(F.col("schema_version"), F.lit(1)), "video_sha256": differs(F.col("video_sha256"), F.col("_sha256")),
        "coordinates": differs(F.col("coordinates"), F.lit("zero_based_clip_local")),  # fixed value
        "frame_indices": differs(F.col("frame_indices"), F.when(F.col("_n") > 0, frames)), "reference_frame": differs(F.col("reference_frame"), F.get("frame_indices", F.lit(5))),
        "checkpoint_sha256": differs(F.col("checkpoint_sha256"), F.lit(detector)), "filter_config": differs(F.col("filter_config"), F.lit(filters)),
    }.items()]
    persons = F.coalesce(F.forall("person_labels", lambda x: x.eqNullSafe(F.lit(1))), F.lit(False))
    cases += [(both & ~persons, "changed:person_labels"), (both & differs(F.col("fingerprint"), cache_fingerprint()), "changed:fingerprint")]
    return rows.select("clip_id", _listed(cases).alias("codes")).where(F.size("codes") > 0).distinct()


def reuse_violations(records: DataFrame, current: DataFrame, catalog: DataFrame, exclusions: DataFrame) -> DataFrame:
    """clip_id, codes of what changed since a prior audit, so that its decoding can't be reused.

    records (prior): clip_id, annotation (as text), sha256, path, file_sha256 (of the bytes today); current: clip_id, annotation,
    duration; catalog: clip_id, sha256, path, duration; exclusions (prior): clip_id of catalog rows without annotations.
    Durations are texts that must be equal as decimals (1.50 equals 1.5; what is no number conflicts). A clip_id that a
    table repeats is repeated:<table>."""
    tables = {"records": records, "current": current, "catalog": catalog, "exclusions": exclusions}
    fields = ("annotation", "sha256", "path", "file_sha256", "duration")
    whole = None
    for name, df in tables.items():
        once = df.groupBy("clip_id").agg(F.count("*").alias(f"_{name}"), *[F.min(c).alias(f"{name}_{c}") for c in fields if c in df.columns])
        whole = once if whole is None else whole.join(once, "clip_id", "full")
    there = {name: F.col(f"_{name}").isNotNull() for name in tables}
    of = lambda name, c: F.col(f"{name}_{c}")
    seconds = lambda name: of(name, "duration").try_cast("decimal(30,9)")
    known, listed = there["records"] & there["catalog"], there["current"] & there["catalog"]
    cases = [(F.col(f"_{name}") > 1, f"repeated:{name}") for name in tables] + [
        (there["records"] & ~there["current"], "annotation_removed"), (there["current"] & ~there["records"], "annotation_added"),
        (there["records"] & there["current"] & ~of("records", "annotation").eqNullSafe(of("current", "annotation")), "annotation_changed"),
        (there["records"] & ~there["catalog"], "not_in_catalog"), (known & ~(of("records", "sha256").eqNullSafe(of("catalog", "sha256")) & of("records", "path").eqNullSafe(of("catalog", "path"))), "catalog_changed"),
        (there["records"] & ~of("records", "file_sha256").eqNullSafe(of("records", "sha256")), "media_changed"),
        (listed & ~F.coalesce(seconds("current") == seconds("catalog"), F.lit(False)), "duration_conflict"),
        (there["catalog"] & ~there["current"] & ~there["exclusions"], "exclusion_added"), (there["exclusions"] & (there["current"] | ~there["catalog"]), "exclusion_removed"),
    ]
    return whole.select("clip_id", _listed(cases).alias("codes")).where(F.size("codes") > 0)


def reuse_summary(records: DataFrame) -> DataFrame:
    """state (candidate or quarantine), label, clips, seconds of records (issues, readable, label, duration): exact decimal sums of
    presentation durations. What has an annotation issue, or can't be read, is in quarantine; durations that are no numbers are
    left out of the sum."""
    fine = (F.col("issues") == 0) & F.coalesce("readable", F.lit(False))
    rows = records.select(F.when(F.coalesce(fine, F.lit(False)), "candidate").otherwise("quarantine").alias("state"), F.coalesce("label", F.lit("missing")).alias("label"), F.col("duration").try_cast("decimal(20,6)").alias("seconds"))
    return rows.groupBy("state", "label").agg(F.count("*").alias("clips"), F.coalesce(F.sum("seconds"), F.lit(0)).cast("decimal(30,6)").alias("seconds"))


def pin_violations(pins: DataFrame, required: list[str]) -> DataFrame:
    """run, model, code (missing, unknown, repeated, invalid) of runs whose models (run, model, sha256) are not exactly the required
    ones, each pinned by 64 lower-case hex digits."""
    by = pins.groupBy("run", "model").agg(F.count("*").alias("_n"), F.min(F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))).alias("_fine"))
    wanted = pins.select("run").distinct().select("run", F.explode(F.array(*map(F.lit, required))).alias("model"), F.lit(True).alias("_wanted"))
    code = F.when(F.col("_n").isNull(), "missing").when(F.col("_wanted").isNull(), "unknown").when(F.col("_n") > 1, "repeated").when(~F.col("_fine"), "invalid")
    return wanted.join(by, ["run", "model"], "full").select("run", "model", code.alias("code")).where("code IS NOT NULL")


def resolved_policies(selected: DataFrame, requested: DataFrame) -> DataFrame:
    """run, mode, projection, changed of requested evaluations (run, mode, projection) under frozen policies (run, evaluation_mode,
    frame_projection; null or absent: bag, repeat). A request may leave its projection null; another mode, or in frame mode
    another projection, is a change, which forbids the evaluation. Fixed values: the names of modes and projections."""
    rows = requested.join(selected, "run", "left")
    mode, projection = F.coalesce("evaluation_mode", F.lit("bag")), F.coalesce("frame_projection", F.lit("repeat"))
    changed = ~F.col("mode").eqNullSafe(mode) | ((F.col("mode") == "frame") & F.coalesce(F.col("projection") != projection, F.lit(False)))
    return rows.select("run", "mode", F.coalesce("projection", projection).alias("projection"), changed.alias("changed"))


def experiment_violations(experiments: DataFrame, models: DataFrame, pins: DataFrame, threshold: float, windows: int) -> DataFrame:
    """run, codes of experiments (run, anomaly_threshold, max_windows, protocol_sha256, population) that differ from what was
    selected in advance: models (run, model, checkpoint_sha256, anomaly_threshold, protocol_sha256, population,
    selection_frozen, held_out_used_for_selection; the last threshold, protocol and population may be null) against the pins
    (run, model, sha256) and the fixed threshold and number of windows."""
    own = experiments.select("run", _listed([(~F.col("anomaly_threshold").eqNullSafe(F.lit(threshold)), "threshold"), (~F.col("max_windows").eqNullSafe(F.lit(windows)), "windows")]).alias("_own"))
    stated = experiments.select("run", F.col("protocol_sha256").alias("_protocol"), F.col("population").alias("_population"))
    rows = models.join(stated, "run").join(pins.select("run", "model", F.col("sha256").alias("_pin")), ["run", "model"], "left")
    given = lambda c: F.col(c).isNotNull()
    cases = [
        (~F.col("checkpoint_sha256").eqNullSafe(F.col("_pin")), "checkpoint"), (given("anomaly_threshold") & (F.col("anomaly_threshold") != threshold), "selected_threshold"),
        (given("protocol_sha256") & ~F.col("protocol_sha256").eqNullSafe(F.col("_protocol")), "protocol"), (given("population") & ~F.col("population").eqNullSafe(F.col("_population")), "population"),
        (~F.col("selection_frozen").eqNullSafe(F.lit(True)), "selection_not_frozen"), (~F.col("held_out_used_for_selection").eqNullSafe(F.lit(False)), "held_out_used"),
    ]
    by_model = rows.select("run", F.explode(F.transform(_listed(cases), lambda code: F.concat_ws(":", "model", code))).alias("code"))
    found = by_model.unionByName(own.select("run", F.explode("_own").alias("code")))
    return found.groupBy("run").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def register(spark: SparkSession, folder: str, identity: dict, resume: bool = False) -> dict:
    """Register an experiment once: the identity is written to folder by exclusive create. A folder that has one raises, unless
    resume is given, the experiment is not complete() and its identity is the same."""
    text = canonical(identity)
    if claim(spark, folder, 0, text):
        return identity
    if not resume or is_complete(spark, folder):
        raise FileExistsError(f"an experiment is registered in {folder} already")
    if spark.read.text(f"{folder}/_commits/{0:012d}", wholetext=True).first()[0] != text:
        raise ValueError("an experiment can't be resumed with another identity")
    return identity


def complete(spark: SparkSession, folder: str, results: dict) -> None:
    """Close a registered experiment with its results; a second time raises."""
    if not claim(spark, folder, 1, canonical(json.loads(json.dumps(results)))):
        raise FileExistsError(f"the experiment in {folder} is complete already")


def is_complete(spark: SparkSession, folder: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_commits/{1:012d}")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
