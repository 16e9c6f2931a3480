"""Sharding by extendible hashing, with DataFrame operations alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelquery.llm.common import checkpoint

#: Bytes of text that a shard may hold.
LIMIT_BYTES = 16 * 2**20
#: Bits of the hash, and bits that one round adds to the prefixes of buckets that are too large.
BITS, STEP = 60, 6


def prefix(h: Column | str, depth: Column | int) -> Column:
    """The first depth bits of the hash."""
    depth = depth if isinstance(depth, Column) else F.lit(depth)
    return F.call_function("shiftright", F.col(h) if isinstance(h, str) else h, (BITS - depth).cast("int"))


def shards_of(docs: DataFrame, limit: int = LIMIT_BYTES, step: int = STEP) -> DataFrame:
    """doc_id, bytes, depth, shard (the depth bits of its prefix as 0s and 1s; empty if one shard holds all), shard_bytes.

    The directory is indexed by the first bits of a hash of doc_id. Every bucket above limit bytes is split on the next bit,
    and only such buckets, until each fits: a document's shard is its shortest prefix whose documents fit together. Rounds
    look step bits further in the buckets that are still too large, so there are few of them, and their directories hold
    2**step entries a bucket. Documents with one hash can't be parted: rows that repeat an id, or a document above the limit,
    are one shard as soon as they are alone, even above the limit.

    Null texts have 0 bytes; rows without doc_id are hashed by their text. Texts may be of any length. An empty table gives no rows; extra columns are ignored."""
    named = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    h = F.conv(F.substring(F.md5(named.cast("binary")), 1, BITS // 4), 16, 10).cast("long")
    rows = checkpoint(docs.select(F.col("doc_id").cast("long"), h.alias("h"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("bytes")))
    done, depth = [], 0
    open_rows = rows
    while True:
        last = min(depth + step, BITS)
        cells = checkpoint(open_rows.groupBy(prefix("h", last).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.min("h").alias("low"), F.max("h").alias("high")))
        levels = F.sequence(F.lit(depth + (depth > 0)), F.lit(last))
        at = cells.select("cell", "bytes", "low", "high", F.explode(levels).alias("depth")).withColumn("prefix", F.call_function("shiftright", "cell", F.lit(last) - F.col("depth")))
        fits = at.groupBy("depth", "prefix").agg(F.sum("bytes").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).where((F.col("total") <= limit) | (F.col("low") == F.col("high")))
        entries = at.select("cell", "depth", "prefix").join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min_by(F.struct("depth", "prefix", "total"), "depth").alias("bucket"))
        directory = checkpoint(cells.select("cell").join(entries, "cell", "left"))
        looked = open_rows.join(directory, prefix("h", last) == F.col("cell"))
        done.append(looked.where("bucket IS NOT NULL").select("doc_id", "bytes", "bucket.*"))
        if directory.where("bucket IS NULL").isEmpty():
            break
        open_rows, depth = checkpoint(looked.where("bucket IS NULL").select("doc_id", "h", "bytes")), last
    found = reduce(DataFrame.unionByName, done)
    bits = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    return found.select("doc_id", "bytes", F.col("depth").cast("int").alias("depth"), bits.alias("shard"), F.col("total").alias("shard_bytes"))
