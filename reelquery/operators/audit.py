"""Audits: several views of the same clips reconciled in one shuffle, and reports recomputed and compared value by value."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of a report below which nothing may be nested.
NESTED_AT_MOST = 12


def reconcile_views(views: dict[str, DataFrame], key: str) -> DataFrame:
    """key, present, missing, repeated (names of views) and conflicts (field:view~view) of every key that any view has.

    A field is compared between all views that have a column of that name, null-safely and as text; a view that repeats a key
    counts with its largest value, and is named in repeated. The views are one tagged union, so all of them meet in a
    single shuffle of partial aggregates, however many views there are and however often a key comes."""
    names = list(views)
    fields = sorted({c for df in views.values() for c in df.columns if c != key})
    tagged = [df.select(F.col(key), F.lit(i).alias("_view"), *[(F.col(f).cast("string") if f in df.columns else F.lit(None).cast("string")).alias(f) for f in fields]) for i, df in enumerate(views.values())]
    of = lambda i, f: f"_{i}_{f}"
    having = {f: [i for i, df in enumerate(views.values()) if f in df.columns] for f in fields}
    counts = [F.count_if(F.col("_view") == i).alias(f"_n_{i}") for i in range(len(names))]
    values = [F.max(F.when(F.col("_view") == i, F.col(f))).alias(of(i, f)) for f in fields for i in having[f]]
    rows = reduce(DataFrame.unionByName, tagged).groupBy(key).agg(*counts, *values)
    there = [F.col(f"_n_{i}") > 0 for i in range(len(names))]
    listed = lambda cases: F.array_compact(F.array(*[F.when(c, F.lit(text)) for text, c in cases])) if cases else F.array().cast("array<string>")
    differing = [(f"{f}:{names[i]}~{names[j]}", there[i] & there[j] & ~F.col(of(i, f)).eqNullSafe(F.col(of(j, f)))) for f in fields for i, j in combinations(having[f], 2)]
    return rows.select(
        key,
        listed(list(zip(names, there, strict=True))).alias("present"),
        listed([(n, ~c) for n, c in zip(names, there, strict=True)]).alias("missing"),
        listed([(n, F.col(f"_n_{i}") > 1) for i, n in enumerate(names)]).alias("repeated"),
        listed(differing).alias("conflicts"),
    )


def audit_counts(audited: DataFrame, required: dict[str, list[str]]) -> DataFrame:
    """kind, n: orphans (`orphan:view>other`: keys of a view that lack another one which it requires), repeats and conflicts."""
    has = lambda column, name: F.array_contains(column, name)
    orphans: list[Column] = [F.when(has("present", view) & has("missing", other), F.lit(f"orphan:{view}>{other}")) for view, others in required.items() for other in others]
    prefixed = lambda column, prefix: F.transform(column, lambda x: F.concat(F.lit(prefix), x))
    kinds = F.concat(F.array_compact(F.array(*orphans)) if orphans else F.array().cast("array<string>"), prefixed("repeated", "repeated:"), prefixed("conflicts", "conflict:"))
    return audited.select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def flattened(reports: DataFrame, key: str, report: str, deepest: int = NESTED_AT_MOST) -> DataFrame:
    """key, path, value of every leaf of JSON texts: objects by name, arrays by number, as in rates.recall or labels[0]. value is
    the leaf's text (null for JSON null); empty objects and arrays have no leaves. Raises on what is nested deeper."""
    rows = reports.select(F.col(key), F.lit("").alias("path"), F.parse_json(report).alias("node"))
    leaves = []
    for _ in range(deepest + 1):
        kind = F.schema_of_variant("node")
        inner = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        leaves.append(rows.where(~F.coalesce(inner, F.lit(False))).select(key, "path", F.expr("try_variant_get(node, '$', 'string')").alias("value")))
        rows = rows.where(inner).select(key, "path", F.expr("schema_of_variant(node) LIKE 'ARRAY%'").alias("_list"), "node")
        exploded = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("node").outer()).select(F.col("pos").alias("_pos"), F.col("key").alias("_name"), F.col("value").alias("_value")))
        step = F.when(F.col("_list"), F.concat(F.lit("["), F.col("_pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.when(F.col("path") != "", ".").otherwise(""), F.col("_name")))
        rows = exploded.select(key, F.concat("path", step).alias("path"), F.col("_value").alias("node"))
    too_deep = rows.select(key, "path", F.raise_error(F.lit("a report is nested too deeply")).cast("string").alias("value"))
    return reduce(DataFrame.unionByName, [*leaves, too_deep])


def compare_reports(saved: DataFrame, computed: DataFrame, key: str, report: str, tolerance: float = 1e-5) -> DataFrame:
    """key, path, saved, computed: every value of the reports that one side lacks, or that differs: numbers by more than
    tolerance, anything else as text. No rows mean that the saved reports are reproduced."""
    side = lambda df, name: flattened(df, key, report).select(key, "path", F.struct("value").alias(name))
    rows = side(saved, "saved").join(side(computed, "computed"), [key, "path"], "full")
    a, b = F.col("saved.value"), F.col("computed.value")
    x, y = a.try_cast("double"), b.try_cast("double")
    equal = F.when(x.isNotNull() & y.isNotNull(), (F.abs(x - y) <= tolerance) | (F.isnan(x) & F.isnan(y)) | (x == y)).otherwise(a.eqNullSafe(b))
    return rows.where(F.col("saved").isNull() | F.col("computed").isNull() | ~equal).select(key, "path", a.alias("saved"), b.alias("computed"))


def require_reproduced(saved: DataFrame, computed: DataFrame, key: str, report: str, tolerance: float = 1e-5) -> None:
    """Raise with up to five differences if the saved reports are not reproduced."""
    found = compare_reports(saved, computed, key, report, tolerance).limit(5).collect()
    if found:
        raise ValueError(f"recomputed reports differ: {[r.asDict() for r in found]}")
