"""Bootstrap intervals from reproducible draws: md5 of (seed, replicate, draw) stands for the random numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from reelquery.functions.prefix import ratio, running_totals
from reelquery.operators.graph import shuffled_rank
from reelquery.operators.metrics import roc_auc


def uniform(*parts: Column) -> Column:
    """A number in [0, 2**32) from the md5 of the parts joined by colons."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def drawn_clusters(sums: DataFrame, cluster: str, replicates: int, seed: int) -> DataFrame:
    """replicate and the rows of sums (one per cluster) that it draws with replacement, as many as there are clusters."""
    # numbers by the order of a hash part, then the name: no task orders all clusters
    part = F.substring(F.md5(F.col(cluster).cast("string").cast("binary")), 1, 2)
    sums = sums.withColumn("_part", part)
    counts = sums.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    numbered = sums.withColumn("_inside", F.row_number().over(W.partitionBy("_part").orderBy(cluster)) - 1).join(F.broadcast(before), "_part").withColumn("_index", F.col("_before") + F.col("_inside")).drop("_part", "_inside", "_before")
    total = numbered.agg(F.count("*").alias("_clusters"))
    draws = numbered.select(F.col("_index").alias("_draw")).join(F.broadcast(total)).select("_draw", "_clusters", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    draws = draws.select("replicate", (uniform(F.lit(seed), F.col("replicate"), F.col("_draw")) % F.col("_clusters")).alias("_index"))
    return draws.join(numbered, "_index").drop("_index")


def interval(rows: DataFrame, value: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, low, median, high (2.5, 50 and 97.5 percent) and valid: over the replicates with a value."""
    q = rows.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("_q"), F.count(value).alias("valid"))
    return q.select(*by, F.col("_q")[0].alias("low"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("high"), "valid")


def cluster_bootstrap(df: DataFrame, cluster: str, numerator: Column, denominator: Column, replicates: int, seed: int) -> DataFrame:
    """estimate, low, high (2.5 and 97.5 percent of the replicates), clusters: sum(numerator) / sum(denominator) when whole
    clusters are drawn with replacement. Rows are summed per cluster first; a replicate draws as many clusters as there are."""
    sums = df.groupBy(cluster).agg(F.sum(numerator).alias("num"), F.sum(denominator).alias("den"))
    values = drawn_clusters(sums, cluster, replicates, seed).groupBy("replicate").agg(ratio(F.sum("num"), F.sum("den")).alias("value"))
    total = sums.agg(F.count("*").alias("clusters"), ratio(F.sum("num"), F.sum("den")).alias("estimate"))
    return total.join(F.broadcast(interval(values, "value"))).select("estimate", "low", "high", "clusters")


def mode_bootstrap(rows: DataFrame, base: str, replicates: int, seed: int, source: str = "source_video_id") -> DataFrame:
    """mode, measure (coverage, full_correct, accuracy), low, median, high, valid: differences from the base mode when whole
    sources are drawn with replacement. accuracy is conditional on a prediction and not valid in replicates where either mode
    has none. rows: source, mode, truth, prediction; every source has rows in every mode."""
    right = F.when(F.col("prediction") == F.col("truth"), 1).otherwise(0)
    vector = F.struct(F.count("*").alias("n"), F.count("prediction").alias("c"), F.sum(right).alias("k"))
    per = rows.groupBy(source, "mode").agg(vector.alias("v")).groupBy(source).agg(F.map_from_entries(F.collect_list(F.struct("mode", "v"))).alias("modes"))
    drawn = drawn_clusters(per, source, replicates, seed).select("replicate", F.explode("modes").alias("mode", "v"))
    sums = drawn.groupBy("replicate", "mode").agg(*[F.sum(f"v.{x}").alias(x) for x in ("n", "c", "k")])
    own = sums.where(F.col("mode") == base).select("replicate", *[F.col(x).alias(f"b{x}") for x in ("n", "c", "k")])
    both = sums.where(F.col("mode") != base).join(own, "replicate")
    gap = lambda a, b: ratio(F.col(a), F.col(b)) - ratio(F.col(f"b{a}"), F.col(f"b{b}"))
    measures = F.array(*[F.struct(F.lit(name).alias("measure"), value.alias("value")) for name, value in (("coverage", gap("c", "n")), ("full_correct", gap("k", "n")), ("accuracy", gap("k", "c")))])
    return interval(both.select("replicate", "mode", F.inline(measures)), "value", ["mode", "measure"])


def stratified_draws(df: DataFrame, id_col: str, label: str, replicates: int, seed: int) -> DataFrame:
    """df's rows with replicate and weight: how often a replicate draws the row, when each class is drawn with replacement as
    often as it has rows. Rows of weight 0 are left out."""
    rows = shuffled_rank(df, id_col, seed, [label])
    draws = rows.select(label, "rank", "size", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    draws = draws.select(label, "replicate", (uniform(F.lit(seed), F.col("replicate"), F.col(label), F.col("rank")) % F.col("size")).alias("rank"))
    return draws.groupBy(label, "replicate", "rank").agg(F.count("*").alias("weight")).join(rows, [label, "rank"]).drop("rank", "size")


def weighted_pr_auc(df: DataFrame, by: list[str], label: str = "label", score: str = "score", weight: str = "weight") -> DataFrame:
    """by, pr_auc: trapezoids between the distinct scores, from recall 0 at precision 1, where rows count weight times."""
    own = df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.when(F.col(label) == 1, F.col(weight)).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 0, F.col(weight)).otherwise(0)).alias("neg"))
    rows = running_totals(own, "score", ["pos", "neg"], by, descending=True)
    tp, fp, pos, neg = (F.col(x) for x in ("cum_pos", "cum_neg", "pos", "neg"))
    precision, before = ratio(tp, tp + fp), F.coalesce(ratio(tp - pos, tp + fp - pos - neg), F.lit(1.0))
    return rows.groupBy(*by).agg(ratio(F.sum(pos * (precision + before) / 2), F.sum("pos")).alias("pr_auc"))


def paired_pr_difference(df: DataFrame, id_col: str, first: str, second: str, replicates: int, seed: int, label: str = "label") -> DataFrame:
    """low, median, high, valid of pr_auc(first) - pr_auc(second) over stratified replicates that both scores share."""
    drawn = stratified_draws(df.select(id_col, label, first, second), id_col, label, replicates, seed)
    both = drawn.select("replicate", label, "weight", F.inline(F.array(*[F.struct(F.lit(i).alias("model"), F.col(c).alias("score")) for i, c in enumerate((first, second))])))
    areas = weighted_pr_auc(both, ["replicate", "model"], label)
    return interval(areas.groupBy("replicate").agg(F.sum(F.when(F.col("model") == 0, F.col("pr_auc")).otherwise(-F.col("pr_auc"))).alias("difference")), "difference")


def within_source_bootstrap(df: DataFrame, first: str, second: str, replicates: int, seed: int, source: str = "source_video_id", label: str = "label") -> DataFrame:
    """low, median, high, valid of the difference of two scores' mean AUC within sources, when sources are drawn with
    replacement and each draw is a source of its own. A source's AUC does not depend on how often it is drawn, so it is
    computed once; sources of one class have none."""
    aucs = [roc_auc(df, [source], label, c).withColumnRenamed("roc_auc", f"auc_{i}") for i, c in enumerate((first, second))]
    every = df.select(source).distinct().join(aucs[0], source, "left").join(aucs[1], source, "left")
    drawn = drawn_clusters(every, source, replicates, seed)
    return interval(drawn.groupBy("replicate").agg((F.avg("auc_0") - F.avg("auc_1")).alias("difference")), "difference")


#: Cumulative probabilities of a Poisson variable of mean 1 for 0 to 7.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


def poisson_weights(df: DataFrame, id_col: str, replicates: int, seed: int) -> DataFrame:
    """df times replicates, with replicate and weight: how often the row is drawn, Poisson of mean 1 by a hash of its id, so
    replicates need no pass over the data to know its size. Rows of weight 0 are left out."""
    rows = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    u = uniform(F.lit(seed), F.col("replicate"), F.col(id_col)) / float(2**32)
    weight = sum([F.when(u >= p, 1).otherwise(0) for p in POISSON], F.lit(0))
    return rows.withColumn("weight", weight).where("weight > 0")


def paired_difference(rows: DataFrame, first: Column, second: Column) -> DataFrame:
    """low, median, high of the weighted mean of first minus that of second over the replicates of poisson_weights()."""
    per = rows.groupBy("replicate").agg((ratio(F.sum(first * F.col("weight")), F.sum("weight")) - ratio(F.sum(second * F.col("weight")), F.sum("weight"))).alias("difference"))
    q = per.agg(F.percentile("difference", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("_q"))
    return q.select(F.col("_q")[0].alias("low"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("high"))
