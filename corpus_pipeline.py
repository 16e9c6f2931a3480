"""The corpus pipeline: quality rules, toxicity, near-duplicates, mixing, packing, each on what the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from reelquery.llm.common import checkpoint_dir, fold, remove, table
from reelquery.llm.mixing import keep_mixed
from reelquery.llm.packing import pack
from reelquery.llm.quality import keep_good
from reelquery.llm.shinglejoin import keep_one
from reelquery.llm.toxicity import drop_toxic, fit


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and short texts go (the base rules); rows with null or repeated doc_id are
    judged each; a text of any length is judged whole."""
    return keep_good(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; learned from the labelled documents outside the held-out fold. Null and empty
    texts have no passage; rows with null or repeated doc_id are scored each."""
    return drop_toxic(docs, fit(docs.where(fold("doc_id") != 0), table(spark, sf_dir, "labels").select("doc_id", "toxic")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id. Rows that share a doc_id are one document;
    rows without doc_id and without words stay."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 0, 1 or 2 times; those without words once. A null source is a source of its
    own; rows with null or repeated doc_id are documents of their own."""
    return keep_mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in packed sequences; a null or empty text is a single end token."""
    return pack(docs)


#: Every stage gives no rows for an empty table and keeps extra columns, whatever their names, but the last, which ignores them.
STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]
#: Trained models and a tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet to the shared checkpoint folder and read again. A stage's files are
    deleted when the next one is written; those of the last are what is returned."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            remove(spark, f"{folder}/{before}")
        before = name
    return docs
