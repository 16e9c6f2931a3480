"""Links between clips: duplicates, Hamming neighbours, adjacent recordings, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from reelquery.functions.lineage import checkpoint, settled
from reelquery.functions.prefix import previous
from reelquery.sources.manifests import require_none

#: Edges of a graph that one task solves at once (16 bytes each).
EDGES_AT_ONCE = 500_000
#: Frames of a block, blocks at least (so that a small table is several tasks), and pairs of frames that are compared at once.
BLOCK, LEAST_BLOCKS, PAIRS_AT_ONCE = 262_144, 8, 1_000_000


def roots_at_once(edges: pd.DataFrame) -> pd.DataFrame:
    """id, root of every id in edges: roots pass along edges and are then followed to their own roots, until none moves."""
    ids, ends = np.unique(np.concatenate([edges["a"], edges["b"]]), return_inverse=True)
    a, b = ends.reshape(2, -1)
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        for side in (root[a], root[b]):  # a root that meets a smaller one gives way with all that hangs on it
            np.minimum.at(after, side, low)
        while (after[after] != after).any():
            after = after[after]
        after = after[root]
        if (after == root).all():
            return pd.DataFrame({"id": ids, "root": ids[root]})
        root = after


def linked_roots(edges: DataFrame, at_once: int = EDGES_AT_ONCE) -> DataFrame:
    """id, root for every id in edges (a, b; longs): the smallest id that edges reach.

    A graph of up to at_once edges is solved in one task. A larger one takes rounds: each takes the smallest root among the
    neighbours and then that root's root, so rounds grow with the logarithm of a component's diameter."""
    apart, n = settled(edges.where("a <> b").select("a", "b").distinct())
    if n <= at_once:
        return checkpoint(apart.coalesce(1).mapInPandas(lambda parts: [roots_at_once(pd.concat(list(parts)))] if n else [], "id long, root long"))
    both = checkpoint(apart.unionByName(apart.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    roots = checkpoint(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "id"))
    while True:
        near = both.join(roots, both["b"] == roots["id"]).groupBy("a").agg(F.min("root").alias("near"))
        step = roots.join(near, roots["id"] == near["a"]).select("id", F.least("root", "near").alias("to"), F.col("root").alias("old"))
        up = step.select(F.col("id").alias("at"), F.col("to").alias("top"))
        moved = checkpoint(step.join(up, step["to"] == up["at"], "left").select("id", F.least("to", F.coalesce("top", "to")).alias("root"), "old"))
        roots = moved.select("id", "root")
        if moved.where("root < old").isEmpty():
            return roots


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, root for every node: the smallest id that edges (a, b) reach; a node without edges is its own root."""
    return nodes.select("id").distinct().join(linked_roots(edges), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def token_edges(df: DataFrame, id_col: str, token: str) -> DataFrame:
    """Edges that join all rows of a token: each row to the token's smallest id. Null tokens join nothing."""
    known = df.where(F.col(token).isNotNull()).select(F.col(id_col).alias("b"), token)
    first = known.groupBy(token).agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1")
    return known.join(first, token).where("a <> b").select("a", "b")


def exact_duplicates(df: DataFrame, id_col: str, digest: str) -> DataFrame:
    """digest, copies, first (smallest id) of contents that occur more than once."""
    return df.groupBy(digest).agg(F.count("*").alias("copies"), F.min(id_col).alias("first")).where("copies > 1")


def conflicting_contents(df: DataFrame, digest: str, label: str) -> DataFrame:
    """digest, labels: contents that stand under several labels."""
    per = df.groupBy(digest).agg(F.min(label).alias("_low"), F.max(label).alias("_high"), F.sort_array(F.collect_set(label)).alias("labels"))
    return per.where("_low <> _high").select(digest, "labels")


def remove_training_duplicates(df: DataFrame, id_col: str, digest: str, split: str, label: str | None = None) -> DataFrame:
    """Per content: all test copies if there are any, else the row with the smallest id. The group's facts are aggregated
    and joined back, so a content with many copies is no single task. With a label, equal contents of different labels
    raise: no copy of them may be preferred."""
    if label:
        require_none(conflicting_contents(df, digest, label), "equal contents have different labels")
    per = df.groupBy(digest).agg(F.max(F.col(split) == "test").alias("_held"), F.min(id_col).alias("_first"))
    rows = df.join(per, digest)
    return rows.where(F.when(F.col("_held"), F.col(split) == "test").otherwise(F.col(id_col) == F.col("_first"))).select(*df.columns)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def band_masks(most: int, bits: int, agreeing: int) -> list[int]:
    """The bits of every combination of `agreeing` of most + agreeing bands."""
    bands = most + agreeing
    cuts = [round(i * bits / bands) for i in range(bands + 1)]
    return [sum(own) for own in combinations([((1 << (high - low)) - 1) << low for low, high in zip(cuts, cuts[1:])], agreeing)]


def hamming_pairs(left: DataFrame, right: DataFrame, most: int, bits: int = 64, agreeing: int = 1) -> DataFrame:
    """a, b, distance for rows (id, h) of both sides whose bit patterns differ in at most `most` bits.

    Patterns are cut into most + agreeing bands, of which `agreeing` at least must be equal, so the join is by (combination of
    bands, their value). A pair is kept in the first combination that it shares, so it comes once without a distinct. More
    agreeing bands make more keys a pattern, but longer ones: at 64 bits and 8 of them, one band of 9 lets 7 % of all pairs
    meet, two of 10 0.6 %, three of 11 0.09 %. The result is the same for any."""
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in band_masks(most, bits, agreeing)]

    def banded(df: DataFrame, name: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(i).alias("band"), F.col("h").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(signed)])
        return df.select(F.col("id").alias(name), F.col("h").alias(f"h{name}"), F.inline(keys))

    x = F.col("ha").bitwiseXOR(F.col("hb"))
    pairs = banded(left, "a").join(banded(right, "b"), ["band", "part"]).where(F.bit_count(x) <= most)
    first = F.array_position(F.transform(F.array(*map(F.lit, signed)), lambda m: x.bitwiseAND(m) == 0), True) - 1
    return pairs.where(first == F.col("band")).select("a", "b", F.bit_count(x).alias("distance"))


def near_patterns(a: np.ndarray, b: np.ndarray, most: int, masks: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i, j of the patterns a[i], b[j] (uint64) that differ in at most `most` bits, each pair once, in its first mask where both
    are equal. Some PAIRS_AT_ONCE candidates are compared at once. Where masks leave more than an eighth of all pairs, as many
    like patterns do, the rest is compared without them."""
    masks, room = np.array(masks, np.uint64), len(a) * len(b) // 8

    def near(i: np.ndarray, j: np.ndarray, x: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
        fresh = np.ones(len(x), bool)
        for mask in masks[:before]:
            fresh &= x & mask != 0
        return i[fresh], j[fresh]

    for turn, mask in enumerate(masks):
        order, own = np.argsort(b & mask), np.argsort(a & mask)
        keys, wanted = (b & mask)[order], (a & mask)[own]
        first = np.searchsorted(keys, wanted)
        counts = np.searchsorted(keys, wanted, side="right") - first
        room -= int(counts.sum())
        if room < 0:
            step = max(1, PAIRS_AT_ONCE // len(b))
            for low in range(0, len(a), step):
                x = a[low : low + step, None] ^ b
                i, j = np.nonzero(np.bitwise_count(x) <= most)
                yield near(i + low, j, x[i, j], turn)
            return
        met = np.flatnonzero(counts)
        for at in np.split(met, np.flatnonzero(np.diff(np.cumsum(counts[met]) // PAIRS_AT_ONCE)) + 1):
            each = counts[at]
            i, j = np.repeat(own[at], each), order[np.repeat(first[at] - np.cumsum(each) + each, each) + np.arange(each.sum())]
            x = a[i] ^ b[j]
            kept = np.flatnonzero(np.bitwise_count(x) <= most)
            yield near(i[kept], j[kept], x[kept], turn)


def frame_matches(frames: DataFrame, most: int, bits: int = 64, agreeing: int = 1) -> DataFrame:
    """a, b (a < b), matches, frames_a, frames_b: clips with frames (clip_id, frame, h) within `most` bits of each other.

    Frames are dealt to blocks, and every two blocks meet in a group of some 2 * BLOCK frames, which a task searches by bands (see
    near_patterns and hamming_pairs). The pairs of blocks, and with them time, grow with the square of the frames; a task does not."""
    rows, n = settled(frames.where("clip_id IS NOT NULL AND h IS NOT NULL").select("clip_id", "frame", "h"))
    blocks, masks = max(LEAST_BLOCKS, -(-n // BLOCK)), band_masks(most, bits, agreeing)
    dealt = rows.withColumn("_own", F.pmod(F.xxhash64("clip_id", "frame"), F.lit(blocks)).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("clip_id", "frame", "h", (F.least("_own", "_other") * blocks + F.greatest("_own", "_other")).alias("_pair"), (F.col("_own") > F.col("_other")).alias("_second"))

    def solve(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        second, same = rows["_second"].to_numpy(), divmod(int(rows["_pair"].iloc[0]), blocks)
        left, right = rows[~second], rows[~second if same[0] == same[1] else second]
        (clip_a, frame_a, h_a), (clip_b, frame_b, h_b) = ([side[c].to_numpy() for c in ("clip_id", "frame", "h")] for side in (left, right))
        if not len(left) or not len(right):
            return
        for i, j in near_patterns(h_a.view(np.uint64), h_b.view(np.uint64), most, masks):
            kept = clip_a[i] < clip_b[j] if same[0] == same[1] else clip_a[i] != clip_b[j]
            i, j = i[kept], j[kept]
            turned = clip_a[i] > clip_b[j]
            yield pd.DataFrame({"a": np.where(turned, clip_b[j], clip_a[i]), "b": np.where(turned, clip_a[i], clip_b[j]), "frame_a": np.where(turned, frame_b[j], frame_a[i]), "frame_b": np.where(turned, frame_a[i], frame_b[j])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for batch in batches:
            if not len(batch):
                continue
            pair = batch["_pair"].to_numpy()
            for start, stop in pairwise([0, *(np.flatnonzero(np.diff(pair)) + 1), len(pair)]):
                if held and held[0]["_pair"].iloc[0] != pair[start]:
                    yield from solve(pd.concat(held, ignore_index=True))
                    held = []
                held.append(batch.iloc[start:stop])
        if held:
            yield from solve(pd.concat(held, ignore_index=True))

    kinds = dict(frames.dtypes)
    tasks = min(blocks * (blocks + 1), 1_000)
    found = dealt.repartition(tasks, "_pair").sortWithinPartitions("_pair").mapInPandas(run, ", ".join(f"{name} {kinds[kind]}" for name, kind in (("a", "clip_id"), ("b", "clip_id"), ("frame_a", "frame"), ("frame_b", "frame"))))
    return found.groupBy("a", "b").agg(F.count("*").alias("matches"), F.countDistinct("frame_a").alias("frames_a"), F.countDistinct("frame_b").alias("frames_b"))


def near_duplicates(frames: DataFrame, most: int, bits: int = 64) -> DataFrame:
    """a, b: clips of which two distinct frames on each side match."""
    return frame_matches(frames, most, bits).where("frames_a >= 2 AND frames_b >= 2").select("a", "b")


def adjacent_links(df: DataFrame, id_col: str, time: str, collection: str, seconds: float, chunk_seconds: float = 3_600.0) -> DataFrame:
    """a, b, gap: rows next to each other in the order (time, id) of all rows, if both are of one collection and at most
    `seconds` apart. Rows without a time have no neighbours. Chunks of time are ordered on their own; a chunk's first row follows
    the last of the chunk before it, so all that is ordered as a whole is one row a chunk."""
    rows = df.select(F.col(time).cast("timestamp").alias("_t"), F.col(id_col).alias("b"), F.col(collection).alias("_c")).where("_t IS NOT NULL")
    rows = rows.select("b", "_c", (F.unix_micros("_t") / 1e6).alias("_s"), F.struct("_t", "b", "_c").alias("_own")).withColumn("_chunk", F.floor(F.col("_s") / chunk_seconds))
    rows = previous(rows, "_own", "_before", [], "_chunk", "_own")
    gap = F.col("_s") - F.unix_micros("_before._t") / 1e6
    return rows.where((F.col("_before._c") == F.col("_c")) & (gap <= seconds)).select(F.col("_before.b").alias("a"), "b", gap.alias("gap"))


def inherited_split(sources: DataFrame, links: DataFrame, splits: DataFrame) -> DataFrame:
    """source, split, reason: a source takes the split of the references it links to. A link to a test reference, or to
    references of different splits, drops it (split null). sources: source, split; links: source, ref; splits: ref, split."""
    seen = links.join(splits.withColumnRenamed("split", "_ref_split"), "ref").groupBy("source").agg(F.sort_array(F.collect_set("_ref_split")).alias("_seen"))
    rows = sources.join(seen, "source", "left")
    s = F.coalesce("_seen", F.array().cast("array<string>"))
    reason = F.when(F.array_contains(s, "test"), "linked_to_test").when(F.size(s) > 1, "conflicting_links").when((F.size(s) == 1) & (F.get(s, F.lit(0)) != F.col("split")), "inherited").otherwise("own")
    split = F.when(reason.isin("linked_to_test", "conflicting_links"), F.lit(None)).when(reason == "inherited", F.get(s, F.lit(0))).otherwise(F.col("split"))
    return rows.select("source", split.alias("split"), reason.alias("reason"))


def shuffled_rank(df: DataFrame, id_col: str, seed: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """df, rank (from 0) and size within by, in the order of md5(seed:id): a seeded shuffle that any engine reproduces. A
    group is ranked in 256 parts of that order, so no task holds a whole group."""
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))
    rows = df.withColumn("_mark", mark).withColumn("_part", F.substring("_mark", 1, 2))
    parts = rows.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    over = W.partitionBy(*by)
    before = parts.select(*by, "_part", (F.sum("_n").over(over.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(over).alias("size"))
    inside = F.row_number().over(W.partitionBy(*by, "_part").orderBy("_mark", id_col)) - 1
    return rows.withColumn("_inside", inside).join(before, [*by, "_part"]).withColumn("rank", F.col("_before") + F.col("_inside")).drop("_mark", "_part", "_inside", "_before")


def largest_remainder(n: Column, ratios: dict[str, float]) -> dict[str, Column]:
    """Whole counts per name that add up to n: floors, then one more for the largest remainders (ties to the earlier name)."""
    names = list(ratios)
    floors = {k: F.floor(n * ratios[k]) for k in names}
    left = n - sum(floors.values(), F.lit(0))
    order = F.array_sort(F.array(*[F.struct((floors[k] - n * ratios[k]).alias("low"), F.lit(i).alias("i")) for i, k in enumerate(names) if ratios[k] > 0]))
    return {k: floors[k] + F.when(F.array_position(F.transform(order, lambda x: x["i"]), F.lit(i)).between(1, left), 1).otherwise(0) for i, k in enumerate(names)}


def split_groups(groups: DataFrame, id_col: str, seed: int, ratios: dict[str, float], by: list[str] = []) -> DataFrame:  # noqa: B006
    """groups and split: a seeded shuffle (within by) cut by largest-remainder counts in the order of ratios."""
    rows = shuffled_rank(groups, id_col, seed, by)
    split, reached = F.lit(None).cast("string"), F.lit(0)
    cuts = []
    for name, count in largest_remainder(F.col("size"), ratios).items():
        reached = reached + count
        cuts.append((name, reached))
    for name, cut in reversed(cuts):
        split = F.when(F.col("rank") < cut, name).otherwise(split)
    return rows.withColumn("split", split).drop("rank", "size")


def nested_subsets(groups: DataFrame, id_col: str, seed: int, fractions: list[float], by: list[str]) -> DataFrame:
    """id, fraction: for each fraction, the first ceil(fraction * size) groups of a stratum's shuffle, so subsets nest."""
    rows = shuffled_rank(groups, id_col, seed, by).withColumn("fraction", F.explode(F.array(*map(F.lit, fractions))))
    return rows.where(F.col("rank") < F.ceil(F.col("fraction") * F.col("size"))).select(id_col, *by, "fraction")


def leakage(df: DataFrame, source: str, split: str) -> DataFrame:
    """source, splits: sources in more than one split."""
    return df.groupBy(source).agg(F.sort_array(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


