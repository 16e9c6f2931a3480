"""Imports into the clip catalog: a batch is judged against the store and itself, in its own order, and goes in whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.functions.lineage import remove

#: What a second record of the same content must agree in.
PROTECTED = ("sha256", "source_video_id", "split", "population")
CONFLICTS = ("identity_conflict", "membership_conflict", "source_conflict")


class ImportConflict(ValueError):
    """A batch that must not go in; it names the first row that forbids it."""


def import_outcomes(existing: DataFrame, incoming: DataFrame, protected: tuple[str, ...] = PROTECTED) -> DataFrame:
    """seq, clip_id, outcome, of (the clip of a duplicate) for every row of incoming (seq, clip_id and what protected names).

    Rows are taken in the order of seq. A row is looked up by content and by id, in the store and among the rows before it:
    identity_conflict - its id stands for another content;
    membership_conflict - its content is there, but a protected field differs;
    duplicate - its content is there, and all protected fields agree;
    source_conflict - its source has another assignment, or is for evaluation where it is not;
    new - else.
    A content's owner is the store's row or else the batch's first; so each question is one aggregate per content, id or
    source that is joined back, and no task holds all rows of one. What follows a conflict is judged as if the conflicting
    row were in; as a conflict stops the whole batch, that never matters."""
    fields = F.struct(*[F.col(c) for c in protected])
    store = existing.select(F.lit(-1).cast("long").alias("seq"), "clip_id", *protected)
    rows = incoming.select(F.col("seq").cast("long").alias("seq"), "clip_id", *protected)
    both = store.unionByName(rows)
    owners = both.groupBy("sha256").agg(F.min(F.struct("seq", "clip_id", fields.alias("fields"))).alias("_owner"))
    first = both.join(owners, "sha256").where("seq = _owner.seq AND clip_id <=> _owner.clip_id")
    # of several contents under one id, the first keeps it
    holders = first.groupBy("clip_id").agg(F.min(F.struct("seq", "sha256")).alias("_holder"))
    evaluation = F.col("population") == "evaluation"
    kept = first.join(holders, "clip_id").where("sha256 = _holder.sha256").groupBy("source_video_id").agg(F.min(F.struct("seq", "split", evaluation.alias("evaluation"))).alias("_lead"))
    mixed = store.groupBy("source_video_id").agg((F.countDistinct("split", evaluation) > 1).alias("_mixed"))
    judged = rows.join(owners, "sha256").join(holders, "clip_id", "left").join(kept, "source_video_id", "left").join(mixed, "source_video_id", "left")
    own = F.col("seq") == F.col("_owner.seq")
    foreign_id = F.coalesce((F.col("_holder.sha256") != F.col("sha256")) & (F.col("_holder.seq") < F.col("seq")), F.lit(False))
    crosses = F.coalesce("_mixed", F.lit(False)) | (F.col("_lead.seq") < F.col("seq")) & ((F.col("_lead.split") != F.col("split")) | (F.col("_lead.evaluation") != evaluation))
    outcome = F.when(foreign_id, "identity_conflict").when(~own & ~F.col("_owner.fields").eqNullSafe(fields), "membership_conflict").when(~own, "duplicate").when(F.coalesce(crosses, F.lit(False)), "source_conflict").otherwise("new")
    judged = judged.withColumn("outcome", outcome)
    return judged.select("seq", "clip_id", "outcome", F.when(F.col("outcome") == "duplicate", F.col("_owner.clip_id")).alias("of"))


def upload_outcomes(existing: DataFrame, uploads: DataFrame) -> DataFrame:
    """seq, token, outcome, clip_id of uploads (seq, token, sha256) against the store (clip_id, sha256, status): an upload whose
    content is there is a duplicate of that clip, or refused if the clip is deleted; of several of one content the first is
    new, as a clip of its own token."""
    known = existing.groupBy("sha256").agg(F.min(F.struct("clip_id", "status")).alias("_known"))
    first = uploads.groupBy("sha256").agg(F.min(F.struct("seq", "token")).alias("_first"))
    rows = uploads.join(first, "sha256").join(known, "sha256", "left")
    outcome = F.when(F.col("_known").isNull(), F.when(F.col("seq") == F.col("_first.seq"), "new").otherwise("duplicate")).when(F.col("_known.status") == "available", "duplicate").otherwise("refers_to_deleted")
    return rows.select("seq", "token", outcome.alias("outcome"), F.coalesce("_known.clip_id", "_first.token").alias("clip_id"))


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def commits(spark: SparkSession, store: str) -> list[str]:
    """The batches that are in the store, in order; an empty string for a number whose import did not get to name its batch."""
    where, files = _file_system(spark, f"{store}/_commits")
    if not files.exists(where):
        return []
    named = {r["name"]: r["value"] for r in spark.read.text(f"{store}/_commits", wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("name"), "value").collect()}
    return [named.get(s.getPath().getName(), "").strip() for s in sorted(files.listStatus(where), key=lambda s: s.getPath().getName())]


def read_store(spark: SparkSession, store: str, schema: str) -> DataFrame:
    """The rows of all committed batches. Files of an import that did not reach its marker are never read."""
    batches = [b for b in commits(spark, store) if b]
    return spark.read.schema(schema).parquet(*[f"{store}/{b}" for b in batches]) if batches else spark.createDataFrame([], schema)


def import_batch(spark: SparkSession, store: str, incoming: DataFrame, schema: str, dry_run: bool = False) -> dict[str, int]:
    """Import a batch whole, or raise ImportConflict and leave the store as it is. Returns how many rows are new and duplicate.

    The batch's new rows are written beside the store's; a marker file with the next number, created only if no other import
    has created it meanwhile, makes them part of it. Who loses that race gets an ImportConflict and may try again."""
    number = len(commits(spark, store))
    outcomes = import_outcomes(read_store(spark, store, schema), incoming).cache()
    try:
        worst = outcomes.where(F.col("outcome").isin(*CONFLICTS)).orderBy("seq").first()
        if worst:
            raise ImportConflict(f"row {worst['seq']}, clip {worst['clip_id']}: {worst['outcome']}")
        counts = {r["outcome"]: r["count"] for r in outcomes.groupBy("outcome").count().collect()}
        if not dry_run and counts.get("new"):
            batch = f"batch-{uuid.uuid4().hex}"
            incoming.join(outcomes.where("outcome = 'new'").select("seq"), "seq").select(*read_store(spark, store, schema).columns).write.parquet(f"{store}/{batch}")
            if not claim(spark, store, number, batch):
                remove(spark, f"{store}/{batch}")
                raise ImportConflict("another import was committed meanwhile")
    finally:
        outcomes.unpersist()
    return {name: counts.get(name, 0) for name in ("new", "duplicate")}


def claim(spark: SparkSession, store: str, number: int, batch: str) -> bool:
    """Make batch the store's commit of that number by exclusive create; False if the number is taken."""
    where, files = _file_system(spark, f"{store}/_commits/{number:012d}")
    try:
        out = files.create(where, False)
    except Exception:  # noqa: BLE001  whatever the store calls it: the file is there already
        if files.exists(where):
            return False
        raise
    out.write(batch.encode())
    out.close()
    return True
