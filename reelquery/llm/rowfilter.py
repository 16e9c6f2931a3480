"""Filtering rows by a verdict on their text, in place: no shuffle, all columns kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelquery.llm.common import text_bytes


def where_text(df: DataFrame, one: Callable[[], Callable[..., list[bool]]], *beside: str) -> DataFrame:
    """The rows of df for whose text one()(texts) is true; the columns beside, as strings, are further arguments. one()
    builds the verdict once per task."""
    added = ["text", *beside]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verdict = one()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts, *others = part.columns[-len(added) :]
                keep = part.filter(pa.array(verdict(text_bytes(texts), *[x.to_pylist() for x in others]), pa.bool_()))
                yield pa.RecordBatch.from_arrays(keep.columns[: -len(added)], names=keep.schema.names[: -len(added)])

    return df.select("*", *[F.col(x).cast("string").alias(f"_{x}_for_verdict") for x in added]).mapInArrow(run, df.schema)
