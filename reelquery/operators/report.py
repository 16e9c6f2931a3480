"""Error reports as tables of markdown lines, so that a report of any number of scenes is written by many tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelquery.operators.evaluation import category_counts

#: Sides of a paired audit: the columns of their predictions and confidences.
SIDES = {"Ground Truth": ("gt_prediction", "gt_confidence"), "Detected": ("det_prediction", "det_confidence")}


def row(*cells: Column) -> Column:
    """A line of a markdown table: bars are escaped, line breaks become blanks, null is unknown."""
    plain = [F.coalesce(F.replace(F.regexp_replace(c.cast("string"), r"\n", " "), F.lit("|"), F.lit("\\|")), F.lit("unknown")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *plain), F.lit(" |"))


def error_report(scenes: DataFrame, audited: DataFrame, title: str, classes: list[str], actors: DataFrame | None = None) -> DataFrame:
    """section, place, key, line of a report on scenes and their paired_audit(): counts of categories; a row a scene; and for each
    side of SIDES the confidences of all, correct and wrong predictions, the wrong pairs by frequency, and, given actors
    (side, class, support, accuracy, f1), a row a class. Lines are in the order of (section, place, key).

    Class numbers are shown by name. Everything but the scenes' rows is as small as the classes; an empty table gives the
    headings and zero scenes."""
    spark = scenes.sparkSession
    named = lambda c: F.get(F.array(*map(F.lit, classes)), F.col(c).cast("int"))
    four = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.4f", F.col(c)))
    fixed: list[tuple[int, list[str]]] = [(0, [f"# {title}", ""]), (1, ["", "| Category | Scenes |", "| --- | ---: |"]), (2, ["", "| Scene | Truth | GT prediction | Detected prediction | Coverage | Categories |", "| --- | --- | --- | --- | ---: | --- |"])]
    parts = [scenes.agg(F.count("*").alias("n")).select(F.lit(0).alias("section"), F.lit(2).cast("long").alias("place"), F.lit("").alias("key"), F.concat(F.lit("Scenes: "), F.col("n").cast("string")).alias("line"))]

    def add(section: int, rows: DataFrame, key: Column, line: Column, place: Column | None = None) -> None:
        parts.append(rows.select(F.lit(section).alias("section"), (F.lit(9) if place is None else place + 9).cast("long").alias("place"), key.cast("string").alias("key"), line.alias("line")))

    add(1, category_counts(audited), F.col("category"), row(F.col("category"), F.col("n")))
    each = scenes.join(audited.select("clip_id", "categories", "coverage"), "clip_id")
    add(2, each, F.lpad(F.col("clip_id").cast("string"), 20, " "), row(F.col("clip_id"), named("truth"), named("gt_prediction"), named("det_prediction"), four("coverage"), F.array_join("categories", ", ")))
    for number, (side, (prediction, confidence)) in enumerate(SIDES.items()):
        section = 10 * (number + 1)
        fixed += [(section, ["", f"## {side}", "", "| Group predictions | Known confidence count | Mean | Std | Unknown |", "| --- | ---: | ---: | ---: | ---: |"]), (section + 1, ["", "| True group | Predicted group | Error count |", "| --- | --- | ---: |"])]
        right = F.coalesce(F.col(prediction) == F.col("truth"), F.lit(False))
        kinds = scenes.select(F.explode(F.array(F.lit("all"), F.when(right, "correct").otherwise("wrong"))).alias("kind"), F.col(confidence).alias("c")).groupBy("kind").agg(F.count("c").alias("n"), F.avg("c").alias("mean"), F.stddev_pop("c").alias("std"), F.count_if(F.col("c").isNull()).alias("unknown"))
        add(section, kinds, F.col("kind"), row(F.col("kind"), F.col("n"), four("mean"), four("std"), F.col("unknown")))
        wrong = scenes.where(F.col(prediction).isNotNull() & (F.col(prediction) != F.col("truth"))).groupBy("truth", prediction).agg(F.count("*").alias("n"))
        most = F.lit(2**60) - F.col("n")
        add(section + 1, wrong, F.concat_ws(">", F.lpad(F.col("truth").cast("string"), 5, " "), F.lpad(F.col(prediction).cast("string"), 5, " ")), row(named("truth"), named(prediction), F.col("n")), most)
        if actors is not None:
            fixed.append((section + 2, ["", "| Actor class | Annotated support | Accuracy | F1 |", "| --- | ---: | ---: | ---: |"]))
            add(section + 2, actors.where(F.col("side") == side), F.lpad(F.col("class").cast("string"), 5, " "), row(named("class"), F.col("support"), four("accuracy"), four("f1")))
    lines = [(section, place, "", line) for section, texts in fixed for place, line in enumerate(texts)]
    return reduce(DataFrame.unionByName, [spark.createDataFrame(lines, "section int, place long, key string, line string"), *parts])


def write_report(report: DataFrame, path: str) -> None:
    """The lines as text files whose names give their order; an existing target is an error."""
    report.orderBy("section", "place", "key").select("line").write.mode("errorifexists").text(path)
