"""Batches that survive bad rows: an error stays with its row, tries are bounded, and a micro-batch counts once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of an error that are kept.
ERROR_CHARACTERS = 500


def score_rows(df: DataFrame, score: Callable[[dict], dict], result: str, tries: int = 1) -> DataFrame:
    """df, the columns of result (a DDL list), error and attempts.

    score gets a row as a dict and returns its result. An exception never stops the batch: after the last of `tries` it is the
    row's error (`ValueError: text`), its results are null, and all other rows have theirs. A worker that is lost is Spark's
    to run again; score must therefore give the same for the same row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.to_dict("records"):
                error, found, attempt = None, {}, 0
                while attempt < tries:
                    attempt += 1
                    try:
                        found, error = dict(score(dict(row))), None
                        break
                    except Exception as failure:  # noqa: BLE001  one bad row must not stop the batch
                        error = f"{type(failure).__name__}: {failure}"[:ERROR_CHARACTERS]
                out.append(row | {name: found.get(name) for name in names} | {"error": error, "attempts": attempt})
            yield pd.DataFrame(out, columns=columns)

    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(result)
    names = fields.fieldNames()
    columns = [*df.columns, *names, "error", "attempts"]
    schema = StructType([*df.schema.fields, *fields.fields]).add("error", "string").add("attempts", "integer")
    return df.mapInPandas(run, schema)


def batch_report(scored: DataFrame) -> DataFrame:
    """rows, failed and all_failed of a scored batch: a batch fails as a whole only if every row did."""
    failed = F.count_if(F.col("error").isNotNull())
    return scored.agg(F.count(F.lit(1)).alias("rows"), failed.alias("failed"), ((F.count(F.lit(1)) > 0) & (failed == F.count(F.lit(1)))).alias("all_failed"))


def next_states(items: DataFrame, max_retries: int) -> DataFrame:
    """items (status, attempts, error of the last try) after a round: running ones with an error are queued again within
    max_retries, and failed beyond; those without are completed; others stay."""
    status = F.when(F.col("status") != "running", F.col("status")).when(F.col("error").isNull(), "completed").when(F.col("attempts") <= max_retries, "queued").otherwise("failed")
    return items.withColumn("status", status)


def commit_once(folder: str) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that keeps each micro-batch under folder/batch=<id>. A batch that comes again, as after a
    restart, overwrites what it has written itself, so every row counts once."""

    def commit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return commit
