"""Exact top-k inner-product search: tiles of queries and shards, selection per tile, tree merging."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of the doubles of a shard of candidates, and of a tile of queries, which one task multiplies, queries by queries at once.
SHARD_BYTES, SHARDS_AT_LEAST, AT_ONCE = 64_000_000, 64, 256
#: Partial lists that one step of the merging tree joins.
FAN_IN = 16
EXACT_FLOAT = float(2**53)


def usable(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, vec): floor(scale * component) as double. Rows whose id or vector is null, or whose vector holds a null or
    non-finite component or none at all, take no part."""
    x = F.col(vec_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite)
    # floor stays a double: components beyond the longs can't overflow here
    ints = F.transform(x, lambda v: F.lit(float(scale)) * v.cast("double"))
    return rows.select(F.col(id_col).cast("long").alias("id"), ints.alias("vec"))


def scores_of(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products. Doubles are exact below 2**53; beyond that Python's integers, clipped to a long."""
    if np.abs(q).max() * np.abs(c).max() * q.shape[1] < EXACT_FLOAT:
        return (q @ c.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in c], object).T
    return np.clip(exact, -(2**63) + 1, 2**63 - 1).astype(np.int64)


BLOCK = "dim int, block long, n long, ids binary, vecs binary, times binary"


def packed(rows: DataFrame, blocks: int) -> DataFrame:
    """A row per block of distinct vectors (id, vec) of one length: their ids, their whole numbers in the narrowest type, and how
    many rows each stands for. Equal rows are counted before they are dealt, so many copies are one row of one block."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(mark=[v.tobytes() for v in part["vec"]]).sort_values(["id", "mark"], ignore_index=True)  # the same at every run
        values = np.floor(np.stack(part["vec"].to_numpy()))
        kind = next((k for k in ("<i2", "<i4") if np.abs(values).max() <= np.iinfo(k).max), "<f8")
        own = pd.DataFrame({"dim": [part["dim"].iloc[0]], "block": [part["block"].iloc[0]], "n": [len(part)]})
        return own.assign(ids=[part["id"].to_numpy(np.int64).tobytes()], vecs=[values.astype(kind).tobytes()], times=[part["times"].to_numpy(np.int64).tobytes()])

    counted = rows.groupBy("id", "vec").agg(F.count(F.lit(1)).alias("times"))
    dealt = counted.select("id", "vec", "times", F.size("vec").alias("dim"), F.pmod(F.xxhash64("id", "vec"), F.lit(blocks)).alias("block"))
    return dealt.groupBy("dim", "block").applyInPandas(pack, BLOCK)


def unpacked(block: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, dim, raw = int(block["n"]), int(block["dim"]), block["vecs"]
    kind = {2: "<i2", 4: "<i4", 8: "<f8"}[len(raw) // (n * dim)]
    return np.frombuffer(block["ids"], np.int64), np.frombuffer(raw, kind).reshape(n, dim).astype(np.float64), np.frombuffer(block["times"], np.int64)


def tile_best(k: int):
    """The best k of a shard for each query of a tile, by (score descending, id ascending)."""

    def best(key, queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(queries) and len(shard):
            (own_ids, asked, repeats), (ids, vecs, times) = unpacked(queries.iloc[0]), unpacked(shard.iloc[0])
            take = min(k + 1, len(ids))  # one more: the query's own row may be among them
            for at in range(0, len(asked), AT_ONCE):
                for number, line in enumerate(scores_of(asked[at : at + AT_ONCE], vecs), at):
                    floor = np.partition(line, len(line) - take)[len(line) - take]
                    hits = np.flatnonzero(line >= floor)
                    hits = hits[np.argsort(-line[hits], kind="stable")]  # a block is in order of ids, so ties are too
                    found = []
                    for i in hits.tolist():
                        copies = int(times[i])
                        if ids[i] == own_ids[number] and np.array_equal(vecs[i], asked[number]):
                            copies -= 1
                        found += [{"low": -int(line[i]), "vec_id": int(ids[i])}] * min(copies, k - len(found))
                        if len(found) == k:
                            break
                    if found:
                        rows.append((own_ids[number], key[2], number, repeats[number], key[1], found))
        return pd.DataFrame(rows, columns=["query_id", "tile", "number", "repeats", "shard", "hits"]).astype({c: "int64" for c in ("query_id", "tile", "number", "repeats", "shard")})

    return best


def top_k(queries: DataFrame, candidates: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """The k candidates with the highest integer inner products for each query.

    Returns query_id, rank (from 1), vec_id, score; fewer than k rows where there are fewer candidates. Ties go to the
    smaller id. Of the candidates with the query's id and vector one is left out: the query itself. All other rows take part,
    whether they repeat an id, a vector or both; query rows of one id are queries of their own, and each gets its rows.
    Vectors of different lengths are never compared. Empty tables give no rows; extra columns are ignored.

    Both sides are packed into blocks by a hash of the id: a task multiplies one tile of queries with one shard and keeps k
    rows per query; the partial lists then meet in a tree of FAN_IN lists a step, so no task ever sees all partial results
    of a query, however many shards there are. A vector is shuffled twice as an array, to count its copies and to be packed,
    and then in packed blocks (two bytes a component) once for every block of the other side."""
    cand, asked = usable(candidates, id_col, vec_col, scale), usable(queries, id_col, vec_col, scale)
    (n, wide), m = cand.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first(), asked.count()
    most = max(1, SHARD_BYTES // (8 * (wide or 1)))
    shards = max(1, -(-n // min(most, max(256, -(-n // SHARDS_AT_LEAST)))))
    tiles = max(1, -(-m // most))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    c = packed(cand, shards).select(F.col("dim"), F.col("block").alias("shard"), every(tiles).alias("tile"), "n", "ids", "vecs", "times")
    q = packed(asked, tiles).select(F.col("dim"), every(shards).alias("shard"), F.col("block").alias("tile"), "n", "ids", "vecs", "times")
    keys = ["dim", "shard", "tile"]
    found = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(tile_best(k), "query_id long, tile long, number long, repeats long, shard long, hits array<struct<low: long, vec_id: long>>")
    while shards > 1:
        found = found.groupBy("query_id", "tile", "number", "repeats", F.expr(f"shard div {FAN_IN}").alias("shard")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k).alias("hits"))
        shards = -(-shards // FAN_IN)
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "repeats")))
    return each.select("query_id", F.posexplode("hits").alias("at", "hit")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.low")).alias("score"))
