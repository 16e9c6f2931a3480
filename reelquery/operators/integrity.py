"""Content identities and receipts: canonical JSON hashes of rows, population hashes, and comparing against a receipt."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical(value: object) -> str:
    """JSON with sorted keys, without white space; numbers that are not finite are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


#: Types whose JSON Spark and the canonical form write alike.
EXACT = ("string", "boolean", "tinyint", "smallint", "int", "bigint")


def content_hash(df: DataFrame, columns: list[str], name: str = "content_hash") -> DataFrame:
    """df and the SHA-256 of the canonical JSON of its columns: sorted names, no white space, nulls written out.

    Rows of texts, whole numbers and booleans are hashed in the JVM. Other types, such as doubles, whose digits Spark
    writes in its own way, go through Python in batches."""
    kinds = dict(df.select(*columns).dtypes)
    if all(k in EXACT for k in kinds.values()):
        return df.withColumn(name, F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256))

    @F.pandas_udf("string")
    def digest(rows: pd.DataFrame) -> pd.Series:
        plain = rows.astype(object).where(rows.notna(), None).to_dict("records")
        return pd.Series([hashlib.sha256(canonical({k: v.item() if hasattr(v, "item") else v for k, v in r.items()}).encode()).hexdigest() for r in plain])

    return df.withColumn(name, digest(F.struct(*columns)))


def population_hash(df: DataFrame, fingerprint: str) -> DataFrame:
    """rows, population: a hash of the multiset of fingerprints (hex digests). Fingerprints are ordered and hashed per 4-digit
    prefix, those hashes per 2-digit prefix, and those at last, so no task orders the whole population."""
    def level(rows: DataFrame, digits: int) -> DataFrame:
        return rows.groupBy(F.substring("key", 1, digits).alias("key")).agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list(F.concat("key", "digest")))), 256).alias("digest"), F.sum("n").alias("n"))

    rows = df.groupBy(F.col(fingerprint).alias("key")).agg(F.count("*").alias("n")).withColumn("digest", F.sha2(F.concat_ws(":", "key", F.col("n").cast("string")), 256))
    return level(level(level(rows, 4), 2), 0).select(F.col("n").alias("rows"), F.col("digest").alias("population"))


def receipt(identity: dict, artifacts: DataFrame) -> dict:
    """A receipt that binds an identity to artifacts (name, sha256): freeze_hash covers both."""
    named = {r["name"]: r["sha256"] for r in artifacts.select("name", "sha256").collect()}
    body = {"identity": identity, "artifacts": named}
    return body | {"freeze_hash": hashlib.sha256(canonical(body).encode()).hexdigest()}


def receipt_violations(frozen: dict, artifacts: DataFrame) -> list[str]:
    """What differs from a receipt: the receipt itself, missing, added or changed artifacts. Receipts name few artifacts;
    artifact_changes() compares whole tables of them."""
    body = {k: frozen[k] for k in ("identity", "artifacts")}
    found = [] if hashlib.sha256(canonical(body).encode()).hexdigest() == frozen["freeze_hash"] else ["receipt"]
    now = {r["name"]: r["sha256"] for r in artifacts.select("name", "sha256").collect()}
    return found + sorted(n for n in now.keys() | frozen["artifacts"].keys() if now.get(n) != frozen["artifacts"].get(n))


def artifact_changes(frozen: DataFrame, current: DataFrame) -> DataFrame:
    """name, code (missing, added, changed) of artifacts (name, sha256) that differ from the frozen ones."""
    old, new = frozen.select("name", F.col("sha256").alias("_old")), current.select("name", F.col("sha256").alias("_new"))
    code = F.when(F.col("_new").isNull(), "missing").when(F.col("_old").isNull(), "added").when(F.col("_old") != F.col("_new"), "changed")
    return old.join(new, "name", "full_outer").select("name", code.alias("code")).where("code IS NOT NULL")
