"""Small helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.functions.lineage import checkpoint, checkpoint_dir, remove, settled  # noqa: F401  shared with the operators here

#: Entries that a Python worker's word cache may hold before it starts anew. It changes speed only, never results.
CACHE_ENTRIES = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str) -> Column:
    """The fold 0 to 4 of a document: crc32 of its id as text, modulo 5. Fold 0 is held out."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a text column. bytes.split() then yields exactly the words [^\\x20\\x09-\\x0D]+."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return column.to_pylist()


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(k) if k in plain else chr(next(rest)) for k in range(256)]


class WordCache(dict):
    """word -> make(self, word), computed once. Above CACHE_ENTRIES words (see trim) it starts anew and keeps the words so far
    aside; of those, what is asked for again moves over, the rest goes with the next start."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make, self.aside = make, {}

    def __missing__(self, word: bytes):
        value = self.aside.get(word)
        if value is None:
            value = self.make(self, word)
        self[word] = value
        return value

    def trim(self) -> None:
        if len(self) > CACHE_ENTRIES:
            self.aside = dict(self)
            self.clear()


def map_texts(df: DataFrame, one: Callable[[], Callable[[list, list], dict]], schema: str) -> DataFrame:
    """mapInArrow over (id, text): one() builds a function once per task; it gets the lists of a batch and returns columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = one()
        for batch in batches:
            # a few hundred texts at a time keep the bytes in Python small
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_pydict(work(part.column(0).to_pylist(), text_bytes(part.column(1))), schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return df.mapInArrow(run, schema)


def fold_texts(df: DataFrame, one: Callable[[], tuple[Callable, Callable, Callable]], schema: str, most: int = 300_000) -> DataFrame:
    """mapInArrow over (id, text) that gathers: one() builds add(ids, texts), held() and rows() once per task. What is held
    goes out as rows() at the task's end, and whenever it exceeds `most` entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, held, rows = one()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                add(part.column(0).to_pylist(), text_bytes(part.column(1)))
                if held() > most:
                    yield pa.RecordBatch.from_pydict(rows(), schema=arrow)
        yield pa.RecordBatch.from_pydict(rows(), schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return df.mapInArrow(run, schema)
