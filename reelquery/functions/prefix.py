"""Running totals and exact quantiles over a global order, without collecting the order in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Parts that a global order is cut into. The cuts come from approximate quantiles; they change speed, never results.
PARTS = 64


def running_totals(rows: DataFrame, key: str, sums: list[str], by: list[str] = [], descending: bool = False) -> DataFrame:  # noqa: B006
    """rows and cum_<name> for each of sums: the total over rows at or before this one in the order of key within by.

    key is numeric and unique within by. Rows are cut into PARTS ranges of the key; a range's totals start from the sum of
    the ranges before it, so a window holds one range of one group and never the whole order."""
    cuts = rows.agg(F.percentile_approx(key, [i / PARTS for i in range(1, PARTS)], 10_000)).first()[0] or []
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(key))) if cuts else F.lit(0)
    rows = rows.withColumn("_part", -part if descending else part)
    own = rows.groupBy(*by, "_part").agg(*[F.sum(x).alias(f"_{x}") for x in sums])
    over = W.partitionBy(*by).orderBy("_part")
    before = own.select(*by, "_part", *[(F.sum(f"_{x}").over(over) - F.col(f"_{x}")).alias(f"_{x}") for x in sums])
    inside = W.partitionBy(*by, "_part").orderBy(F.col(key).desc() if descending else F.col(key)).rowsBetween(W.unboundedPreceding, 0)
    joined = rows.join(before, [*by, "_part"])
    return joined.select(*rows.drop("_part").columns, *[(F.sum(x).over(inside) + F.col(f"_{x}")).alias(f"cum_{x}") for x in sums])


def previous(rows: DataFrame, value: str, name: str, by: list[str], chunk: str, order: str) -> DataFrame:
    """rows and name: value of the row before each one in the order of (chunk, order) within by; null for the first. A window
    holds one chunk of one group, and takes the last row of the chunk before it from one row a chunk."""
    inside = W.partitionBy(*by, chunk).orderBy(order)
    lasts = rows.groupBy(*by, chunk).agg(F.max_by(value, order).alias("_last"))
    carried = lasts.select(*by, chunk, F.lag("_last").over(W.partitionBy(*by).orderBy(chunk)).alias("_carried"))
    first = F.row_number().over(inside) == 1
    ahead = rows.withColumn("_first", first).withColumn("_inside", F.lag(value).over(inside))
    return ahead.join(carried, [*by, chunk]).withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_inside"))).drop("_first", "_inside", "_carried")


def exact_quantiles(df: DataFrame, value: str, levels: dict[str, float], by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, n and a column per level: quantiles of value with linear interpolation between order statistics. Null values are
    left out; a group without values is missing."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    ranked = running_totals(counts, "_v", ["_n"], by)
    total = counts.groupBy(*by).agg(F.sum("_n").alias("n"))
    rows = ranked.join(total, by) if by else ranked.join(F.broadcast(total))
    at = {name: (F.col("n") - 1) * F.lit(float(q)) for name, q in levels.items()}
    reach = lambda rank: F.min(F.when(F.col("cum__n") > rank, F.col("_v")))
    low = [reach(F.floor(x)).alias(f"_low_{name}") for name, x in at.items()]
    high = [reach(F.ceil(x)).alias(f"_high_{name}") for name, x in at.items()]
    found = rows.groupBy(*by).agg(F.first("n").alias("n"), *low, *high)
    mixed = [(F.col(f"_low_{k}") + (F.col(f"_high_{k}") - F.col(f"_low_{k}")) * (x - F.floor(x))).alias(k) for k, x in at.items()]
    return found.select(*by, "n", *mixed)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))
