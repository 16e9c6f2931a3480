"""Splits of whole sources that honour reservations, earlier assignments and the support of classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelquery.operators.graph import largest_remainder, leakage, shuffled_rank, split_groups
from reelquery.sources.manifests import require_none

RATIOS = {"train": 0.7, "val": 0.15, "test": 0.15}
#: Shares of what is left of an official training list.
TRAINING_RATIOS = {"train": 0.85, "val": 0.15, "test": 0.0}


def split_sources(sources: DataFrame, seed: int, ratios: dict[str, float] = RATIOS) -> DataFrame:
    """source, category, split: each category's sources by largest-remainder counts of a seeded shuffle.

    From three sources on, a category has at least one source each for val and test, taken from train. Reserved sources
    (reserved, a boolean) are test; if they are more than test's share, test grows at the cost of val first, then train.
    A category's counts are one aggregate, and its shuffle is ranked in parts (see shuffled_rank)."""
    per = sources.groupBy("category").agg(F.count(F.lit(1)).alias("_n"), F.count_if("reserved").alias("_reserved"))
    counts = largest_remainder(F.col("_n"), ratios)
    enough = lambda name: F.when((F.col("_n") >= 3) & (counts[name] == 0), 1).otherwise(counts[name])
    per = per.select("category", "_n", F.greatest(enough("test"), F.col("_reserved")).alias("_test"), enough("val").alias("_val"))
    per = per.withColumn("_val", F.least("_val", F.col("_n") - F.col("_test")))
    per = per.select("category", "_val", (F.col("_n") - F.col("_val") - F.col("_test")).alias("_train"))
    rest = shuffled_rank(sources.where("NOT reserved").select("source", "category"), "source", seed, ["category"]).join(per, "category")
    split = F.when(F.col("rank") < F.col("_train"), "train").when(F.col("rank") < F.col("_train") + F.col("_val"), "val").otherwise("test")
    held = sources.where("reserved").select("source", "category", F.lit("test").alias("split"))
    return rest.select("source", "category", split.alias("split")).unionByName(held)


def repair_support(assigned: DataFrame) -> DataFrame:
    """assigned (source, category, split, positive) after an exchange: a category without a positive val source swaps its
    first positive train source with its first val source that is not positive, if it has both and keeps a positive train
    source. swapped says which rows moved. Categories are independent, so one aggregate per category decides them all."""
    first = lambda rows: F.min(F.when(rows, F.col("source")))
    donors = (F.col("split") == "train") & F.col("positive")
    val = F.col("split") == "val"
    per = assigned.groupBy("category").agg(F.bool_or(val & F.col("positive")).alias("_held"), F.count_if(donors).alias("_donors"), first(donors).alias("_donor"), first(val & ~F.col("positive")).alias("_receiver"))
    swaps = per.where("NOT _held AND _donors >= 2 AND _receiver IS NOT NULL").select("category", "_donor", "_receiver")
    rows = assigned.join(swaps, "category", "left")
    gives, takes = F.coalesce(F.col("source") == F.col("_donor"), F.lit(False)), F.coalesce(F.col("source") == F.col("_receiver"), F.lit(False))
    split = F.when(gives, "val").when(takes, "train").otherwise(F.col("split"))
    return rows.select("source", "category", "positive", split.alias("split"), (gives | takes).alias("swapped"))


def human_split_violations(clips: DataFrame, splits: DataFrame) -> DataFrame:
    """kind, subject of what forbids a split of clips (clip_id, source, category, label, expected_label, sha256, reserved) by
    splits (source, split): labels that contradict their category, sources of several categories, equal content in several
    splits, reserved sources outside test."""
    label = clips.where("NOT (label <=> expected_label)").select(F.lit("inconsistent_label").alias("kind"), F.col("clip_id").cast("string").alias("subject"))
    category = clips.groupBy("source").agg(F.min("category").alias("_low"), F.max("category").alias("_high")).where("_low <> _high").select(F.lit("conflicting_category").alias("kind"), F.col("source").alias("subject"))
    placed = clips.join(splits.select("source", "split"), "source")
    content = leakage(placed, "sha256", "split").select(F.lit("content_leak").alias("kind"), F.col("sha256").alias("subject"))
    exposed = placed.where("reserved AND split <> 'test'").select(F.lit("reserved_exposed").alias("kind"), F.col("source").alias("subject")).distinct()
    return label.unionByName(category).unionByName(content).unionByName(exposed)


def build_human_split(clips: DataFrame, seed: int = 0) -> DataFrame:
    """clips and split: whole sources, split and repaired (see split_sources and repair_support); raises on what
    human_split_violations finds, and on an empty population."""
    if clips.isEmpty():
        raise ValueError("the population is empty")
    sources = clips.groupBy("source").agg(F.min("category").alias("category"), F.bool_or("reserved").alias("reserved"), F.bool_or(F.col("label") > 0).alias("positive"))
    assigned = split_sources(sources, seed).join(sources.select("source", "positive"), "source")
    splits = repair_support(assigned)
    require_none(human_split_violations(clips, splits), "the split is not allowed")
    return clips.join(splits.select("source", "split"), "source")


def with_prior(sources: DataFrame, prior: DataFrame, seed: int) -> DataFrame:
    """source, category, split: sources with an assignment (prior: source, split) keep it; the rest are split among themselves.
    Raises if a reserved source has another assignment than test."""
    rows = sources.join(prior.select("source", F.col("split").alias("_prior")), "source", "left")
    require_none(rows.where("reserved AND _prior <> 'test'").select("source"), "a reserved source is assigned outside test")
    kept = rows.where("_prior IS NOT NULL").select("source", "category", F.col("_prior").alias("split"))
    return split_sources(rows.where("_prior IS NULL").select("source", "category", "reserved"), seed).unionByName(kept)


def protect_shared(records: DataFrame, shared: DataFrame, seed: int) -> DataFrame:
    """records (source, split, category, ...) with split and excluded. The official test set stays; other records whose source is
    held out elsewhere (shared: source, split test) are excluded (split null); other shared sources keep that split; the
    rest of a category is split among train and val. Raises if an official test source is shared outside test."""
    rows = records.join(shared.select("source", F.col("split").alias("_shared")), "source", "left")
    official = F.col("split") == "test"
    require_none(rows.where(official & (F.col("_shared") != "test")).select("source"), "an official test source is shared outside test")
    free = rows.where(~official & F.col("_shared").isNull()).select("source", "category").distinct()
    dealt = split_groups(free, "source", seed, TRAINING_RATIOS, ["category"]).withColumnRenamed("split", "_dealt")
    joined = rows.join(dealt, ["source", "category"], "left")
    excluded = ~official & F.coalesce(F.col("_shared") == "test", F.lit(False))
    split: Column = F.when(official, "test").when(excluded, F.lit(None)).otherwise(F.coalesce("_shared", "_dealt"))
    return joined.select(*[c for c in records.columns if c != "split"], split.alias("split"), excluded.alias("excluded"))
