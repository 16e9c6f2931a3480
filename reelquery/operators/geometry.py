"""Boxes: overlap, optimal matching, staged filtering with greedy suppression, and detection metrics."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelquery.functions.prefix import ratio

SIDES = ("x1", "y1", "x2", "y2")


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (y2 - y1)


def iou_of(a: str, b: str) -> Column:
    """Intersection over union of boxes in columns a_x1 .. and b_x1 ..; 0 where neither has an area."""
    p, q = ({s: F.col(f"{x}_{s}") for s in SIDES} for x in (a, b))
    width = F.greatest(F.least(p["x2"], q["x2"]) - F.greatest(p["x1"], q["x1"]), F.lit(0.0))
    height = F.greatest(F.least(p["y2"], q["y2"]) - F.greatest(p["y1"], q["y1"]), F.lit(0.0))
    shared = width * height
    return F.coalesce(ratio(shared, area(*p.values()) + area(*q.values()) - shared), F.lit(0.0))


def pairwise_iou(boxes: DataFrame, key: str = "scene_id") -> DataFrame:
    """key, gt_id, det_id, iou for every ground truth and detection of one scene (boxes: key, box_id, side, x1 .. y2)."""
    of = lambda side: boxes.where(F.col("side") == side).select(key, F.col("box_id").alias(f"{side}_id"), *[F.col(s).alias(f"{side}_{s}") for s in SIDES])
    return of("gt").join(of("det"), key).select(key, "gt_id", "det_id", iou_of("gt", "det").alias("iou"))


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns of the highest total gain: the Hungarian method with potentials, a row at a time."""
    flip = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flip else gain)
    n, m = cost.shape
    row_price, column_price = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)  # 1-based row of each column; column 0 holds the row being placed
    for row in range(1, n + 1):
        owner[0], column = row, 0
        slack, back, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[column]:
            done[column] = True
            reduced = cost[owner[column] - 1] - row_price[owner[column]] - column_price[1:]
            better = ~done[1:] & (reduced < slack[1:])
            slack[1:][better], back[1:][better] = reduced[better], column
            following = 1 + int(np.where(done[1:], np.inf, slack[1:]).argmin())
            step = slack[following]
            row_price[owner[done]] += step
            column_price[done] -= step
            slack[~done] -= step
            column = following
        while column:
            owner[column], column = owner[back[column]], back[column]
    pairs = [(owner[c] - 1, c - 1) for c in range(1, m + 1) if owner[c]]
    return sorted((c, r) for r, c in pairs) if flip else sorted(pairs)


#: Boxes on the smaller side of a scene up to which scenes are solved stacked; larger ones are solved one by one.
STACKED_AT_MOST = 8


def places(scene: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's box within its scene (by box), and the boxes of each scene; scene counts from 0, without gaps."""
    code = np.unique(box, return_inverse=True)[1]
    each, at = np.unique(scene * (code.max() + 1) + code, return_inverse=True)
    counts = np.bincount(each // (code.max() + 1))
    return at - (np.cumsum(counts) - counts)[scene], counts


def stacked_assignments(gain: np.ndarray) -> np.ndarray:
    """For each of the stacked matrices (scenes, rows, columns): which pairs of the highest total gain are chosen; gains of 0 are no
    pairs. best[mask] is the most that the rows so far gain with the columns of mask; all scenes take a step at once."""
    scenes, rows, columns = gain.shape
    masks, best = np.arange(1 << columns), np.zeros((scenes, 1 << columns))
    picks = np.full((rows, scenes, 1 << columns), -1, np.int8)
    for row in range(rows):
        after = best.copy()
        for column in range(columns):
            having = masks[masks >> column & 1 == 1]
            total = best[:, having ^ (1 << column)] + gain[:, row, column, None]
            better = total > after[:, having]
            after[:, having] = np.where(better, total, after[:, having])
            picks[row][:, having] = np.where(better, column, picks[row][:, having])
        best = after
    chosen, mask, every = np.zeros(gain.shape, bool), np.full(scenes, (1 << columns) - 1), np.arange(scenes)
    for row in range(rows - 1, -1, -1):
        pick = picks[row, every, mask].astype(int)
        at = np.flatnonzero(pick >= 0)
        chosen[at, row, pick[at]] = True
        mask[at] ^= 1 << pick[at]
    return chosen


def kept_pairs(scene: np.ndarray, gt: np.ndarray, det: np.ndarray, iou: np.ndarray) -> np.ndarray:
    """Which pairs an optimal matching of their scene keeps: the most pairs, then the highest total iou. Scenes whose smaller side
    has up to STACKED_AT_MOST boxes are solved together with those of like size, the others one by one."""
    (row, rows), (column, columns) = places(scene, gt), places(scene, det)
    flip = (rows < columns)[scene]  # the smaller side becomes the columns
    row, column = np.where(flip, column, row), np.where(flip, row, column)
    long, short = np.maximum(rows, columns), np.minimum(rows, columns)
    size = np.where(short <= STACKED_AT_MOST, short * 64 + np.ceil(np.log2(long)).astype(int), -1 - np.arange(len(short)))
    kept = np.zeros(len(scene), bool)
    by_size = np.argsort(size[scene], kind="stable")
    for at in np.split(by_size, np.flatnonzero(np.diff(size[scene][by_size])) + 1):
        own, number = np.unique(scene[at], return_inverse=True)
        gain = np.zeros((len(own), long[own].max(), short[own].max()))
        gain[number, row[at], column[at]] = short[own][number] + 1 + iou[at]
        if gain.shape[2] <= STACKED_AT_MOST:
            chosen = stacked_assignments(gain)
        else:
            chosen = np.zeros(gain.shape, bool)
            chosen[(0, *zip(*assignment(gain[0]), strict=True))] = True
        kept[at] = chosen[number, row[at], column[at]]
    return kept


def match_boxes(boxes: DataFrame, threshold: float = 0.5, key: str = "scene_id") -> DataFrame:
    """key, gt_id, det_id, iou of an optimal one-to-one matching per scene: the most pairs with iou at or above the threshold,
    then the highest total iou. Scenes without such a pair have no row."""
    if threshold <= 0:
        raise ValueError("expected a threshold above 0")
    pairs = pairwise_iou(boxes, key).where(F.col("iou") >= threshold)
    rivals = pairs.groupBy(key).agg((F.count("*") > F.least(F.countDistinct("gt_id"), F.countDistinct("det_id"))).alias("_rivals"))
    pairs = pairs.join(rivals, key)

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last scene of a batch may go on in the next one
        for batch in chain(batches, [None]):
            rows = held if batch is None else batch if held is None else pd.concat([held, batch], ignore_index=True)
            if rows is None or not len(rows):
                continue
            scene, gt, det, iou = (rows[x].to_numpy() for x in (key, "gt_id", "det_id", "iou"))
            starts = np.flatnonzero(np.r_[True, scene[1:] != scene[:-1]])
            whole = len(rows) if batch is None else starts[-1]
            held = None if batch is None else rows.iloc[whole:]
            if whole:
                number = np.cumsum(np.r_[True, scene[1:whole] != scene[: whole - 1]]) - 1
                yield rows.iloc[:whole][kept_pairs(number, gt[:whole], det[:whole], iou[:whole])]

    # a scene whose boxes have one partner each is matched already
    alone, contested = pairs.where(~F.col("_rivals")).drop("_rivals"), pairs.where("_rivals").drop("_rivals")
    solved = contested.repartition(key).sortWithinPartitions(key).mapInPandas(match, contested.schema)
    return alone.unionByName(solved)


#: Rows of whole scenes that a task takes together, and pairs of their boxes that it compares at once.
ROWS_TOGETHER, PAIRS_AT_ONCE = 200_000, 2_000_000


def near_pairs(scene: np.ndarray, truth: np.ndarray, sides: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (ground truth, detection) of the pairs of one scene with iou at or above the threshold. A row is a box: its scene, in
    order; whether it is ground truth; and its x1, y1, x2, y2. As in Spark, NaN is above any number."""
    gt, det = np.flatnonzero(truth), np.flatnonzero(~truth)
    first = np.searchsorted(scene[det], scene[gt])
    counts = np.searchsorted(scene[det], scene[gt], side="right") - first
    found = [(gt[:0], det[:0])]
    for own in np.split(np.arange(len(gt)), np.flatnonzero(np.diff(np.cumsum(counts) // PAIRS_AT_ONCE)) + 1):
        each = counts[own]
        a, b = np.repeat(gt[own], each), det[np.repeat(first[own] - np.cumsum(each) + each, each) + np.arange(each.sum())]
        p, q = sides[a].T, sides[b].T
        with np.errstate(all="ignore"):
            shared = np.maximum(np.fmin(p[2], q[2]) - np.maximum(p[0], q[0]), 0.0) * np.maximum(np.fmin(p[3], q[3]) - np.maximum(p[1], q[1]), 0.0)
            total = (p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - shared
            near = ~(shared / total < threshold) & (total != 0)
        found.append((a[near], b[near]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def most_pairs(scene: np.ndarray, gt: np.ndarray, det: np.ndarray, scenes: int) -> np.ndarray:
    """For each of the scenes the most of its pairs that share no box."""
    pairs = np.bincount(scene, minlength=scenes)
    once = lambda box: np.bincount(scene[np.unique(box, return_index=True)[1]], minlength=scenes)
    rivals = (pairs > np.minimum(once(gt), once(det)))[scene]  # else every box has one partner
    if rivals.any():
        own, number = np.unique(scene[rivals], return_inverse=True)
        kept = kept_pairs(number, gt[rivals], det[rivals], np.zeros(len(number)))
        pairs[own] = np.bincount(number[kept], minlength=len(own))
    return pairs


def matched_by_level(boxes: DataFrame, threshold: float, kept: Column, levels: int, key: str = "scene_id") -> DataFrame:
    """level, tp: for each level from 0 the size of the optimal matchings (see match_boxes) of ground truth and of the detections
    with kept > level, over all scenes. A row is a box; it is shuffled once, with its scene, for all levels.

    A scene is solved again only at levels that lose a pair."""
    if threshold <= 0:
        raise ValueError("expected a threshold above 0")
    above = F.when(F.col("side") == "gt", -1).when(F.col("side") == "det", kept)
    whole = F.col(key).isNotNull() & F.coalesce(above != 0, F.lit(False))
    for s in SIDES:
        whole = whole & F.col(s).isNotNull()
    rows = boxes.where(whole).select(key, above.cast("short").alias("_above"), *[F.col(s).cast("double").alias(s) for s in SIDES])

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        scene = np.cumsum(np.r_[True, (rows[key].to_numpy()[1:] != rows[key].to_numpy()[:-1])]) - 1
        above, n = rows["_above"].to_numpy(), scene[-1] + 1
        gt, det = near_pairs(scene, above < 0, rows[list(SIDES)].to_numpy(), threshold)
        before, size, totals = np.zeros(n, int), np.zeros(n, int), []
        for level in range(levels):
            there = above[det] > level
            pairs = np.bincount(scene[det[there]], minlength=n)
            anew = pairs != before
            own = there & anew[scene[det]]
            size = np.where(anew, most_pairs(scene[det[own]], gt[own], det[own], n), size)
            before = pairs
            totals.append(int(size.sum()))
        return pd.DataFrame({"level": np.arange(levels, dtype=np.int32), "tp": np.array(totals, np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= ROWS_TOGETHER:
                rows = pd.concat(held, ignore_index=True)
                scene = rows[key].to_numpy()
                last = int(np.flatnonzero(np.r_[True, scene[1:] != scene[:-1]])[-1])  # this scene may go on
                if last:
                    yield solve(rows.iloc[:last])
                held = [rows.iloc[last:]]
                n = len(held[0])
        if n:
            yield solve(pd.concat(held, ignore_index=True))

    parts = rows.repartition(key).sortWithinPartitions(key).mapInPandas(run, "level int, tp long")
    return parts.groupBy("level").agg(F.sum("tp").alias("tp"))


def transferred_labels(boxes: DataFrame, matches: DataFrame, labels: DataFrame, key: str = "scene_id") -> DataFrame:
    """key, det_id, label: the label of the matched ground truth (labels: key, gt_id, label), -100 without one."""
    detections = boxes.where("side = 'det'").select(key, F.col("box_id").alias("det_id"))
    named = matches.join(labels, [key, "gt_id"]).select(key, "det_id", "label")
    return detections.join(named, [key, "det_id"], "left").select(key, "det_id", F.coalesce("label", F.lit(-100)).alias("label"))


def detection_metrics(boxes: DataFrame, matches: DataFrame) -> DataFrame:
    """One row over all scenes: matched, missed, extra, precision, recall, f1 and mean_iou (null where undefined)."""
    counts = boxes.agg(F.count_if(F.col("side") == "gt").alias("gt"), F.count_if(F.col("side") == "det").alias("det"))
    own = matches.agg(F.count("*").alias("matched"), F.avg("iou").alias("mean_iou"))
    rows = counts.join(F.broadcast(own))
    m, gt, det = (F.col(x) for x in ("matched", "gt", "det"))
    return rows.select("matched", (gt - m).alias("missed"), (det - m).alias("extra"), ratio(m, det).alias("precision"), ratio(m, gt).alias("recall"), ratio(2 * m, gt + det).alias("f1"), "mean_iou")


def staged_filter(boxes: DataFrame, width: float, height: float, least_score: float, least_side: float) -> DataFrame:
    """boxes clamped to the image, with reason: the first stage that drops a box (low_confidence, invalid_geometry,
    outside_image, too_small), null for those that stay."""
    x1, y1, x2, y2 = (F.col(s) for s in SIDES)
    finite = F.greatest(*[F.abs(F.col(s)) for s in SIDES]) < float("inf")
    valid = finite & ~F.isnan(x1 + y1 + x2 + y2) & (x2 > x1) & (y2 > y1)
    clamp = lambda c, most: F.least(F.greatest(c, F.lit(0.0)), F.lit(most))
    rows = boxes.withColumn("_valid", F.coalesce(valid, F.lit(False))).withColumns({"x1": clamp(x1, width), "y1": clamp(y1, height), "x2": clamp(x2, width), "y2": clamp(y2, height)})
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    reason = F.when(~(F.coalesce(F.col("score"), F.lit(0.0)) >= least_score), "low_confidence").when(~F.col("_valid"), "invalid_geometry").when((w <= 0) | (h <= 0), "outside_image").when((w < least_side) | (h < least_side), "too_small")
    return rows.withColumn("reason", reason).drop("_valid")


def suppress(boxes: DataFrame, threshold: float, most: int, key: str = "scene_id") -> DataFrame:
    """Greedy suppression per scene: by score descending, then geometry, a box stays unless it overlaps one that stays by more
    than the threshold; of those the first `most`. Returns the rows of boxes with keep_rank from 0. The fold runs inside one
    aggregate per scene, whose boxes are few."""
    own = F.struct((-F.col("score")).alias("low"), *SIDES, "box_id", F.struct(*boxes.columns).alias("row"))
    scenes = boxes.groupBy(key).agg(F.array_sort(F.collect_list(own)).alias("_boxes"))

    def overlap(a: Column, b: Column) -> Column:
        width = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
        height = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
        each = [area(*(x[s] for s in SIDES)) for x in (a, b)]
        return F.coalesce(ratio(width * height, each[0] + each[1] - width * height), F.lit(0.0))

    none = F.filter("_boxes", lambda _: F.lit(False))
    kept = F.aggregate("_boxes", none, lambda kept, b: F.when(F.exists(kept, lambda k: overlap(k, b) > threshold), kept).otherwise(F.array_append(kept, b)))
    rows = scenes.select(F.posexplode(F.slice(kept, 1, most)).alias("keep_rank", "_box"))
    return rows.select("_box.row.*", "keep_rank")


def canonical_order(key: str = "scene_id"):
    """Window that orders a scene's boxes by center, corner, score and class-free id."""
    from pyspark.sql.window import Window as W

    return W.partitionBy(key).orderBy((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, *SIDES, F.col("score").desc(), "box_id")


def scaled(boxes: DataFrame, x: float, y: float) -> DataFrame:
    """Boxes times x and y: to and from unit squares, and between grids."""
    return boxes.withColumns({s: F.col(s) * F.lit(x if s[0] == "x" else y) for s in SIDES})
