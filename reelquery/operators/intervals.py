"""Temporal operators: segments, frames, interval merging and overlap, hysteresis alerts, window grids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from reelquery.functions.lineage import checkpoint
from reelquery.functions.prefix import running_totals

#: Seconds of a cell of the tree in which intervals meet.
CELL_SECONDS = 8.0
#: Seconds, and segments, of a chunk of a video that one task orders; results are the same for any.
CHUNK_SECONDS, CHUNK_SEGMENTS = 3_600.0, 4_096


def segment_bounds(df: DataFrame, length: str, segments: int) -> DataFrame:
    """df exploded to seg, first, last (exclusive): length units in `segments` parts at floor(i * length / segments). With
    fewer units than segments, each segment is the single unit that its start falls in."""
    n, i = F.col(length).cast("long"), F.col("seg").cast("long")
    rows = df.withColumn("seg", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))))
    first = F.floor(i * n / segments).cast("long")
    after = F.floor((i + 1) * n / segments).cast("long")
    return rows.withColumn("first", first).withColumn("last", F.when(n < segments, first + 1).otherwise(after))


def unit_segment_frames(df: DataFrame, frames: str, segments: int, unit: int = 16) -> DataFrame:
    """segment_bounds over units of `unit` frames, as frame ranges; the last is clamped to the number of frames."""
    rows = segment_bounds(df.withColumn("_units", F.ceil(F.col(frames) / unit).cast("long")), "_units", segments)
    return rows.select(*df.columns, "seg", (F.col("first") * unit).alias("first"), F.least(F.col("last") * unit, F.col(frames)).cast("long").alias("last"))


def frame_labels(videos: DataFrame, intervals: DataFrame, frames: str, fps: str, key: str = "video_id") -> DataFrame:
    """key, frame, label for every frame of every video: 1 if frame / fps lies in a half-open interval of the video. Each
    interval paints the frames between its ends; frames are made once and met by an equi-join."""
    grid = videos.select(key, fps, F.explode(F.sequence(F.lit(0).cast("long"), F.col(frames).cast("long") - 1)).alias("frame"))
    inside = intervals.join(videos.select(key, frames, fps), key)
    low, high = F.greatest(F.ceil(F.col("start_s") * F.col(fps)).cast("long"), F.lit(0)), F.least(F.ceil(F.col("end_s") * F.col(fps)).cast("long"), F.col(frames).cast("long")) - 1
    painted = inside.where(low <= high).select(key, F.explode(F.sequence(low, high)).alias("frame")).distinct().withColumn("label", F.lit(1))
    return grid.join(painted, [key, "frame"], "left").select(key, "frame", F.coalesce("label", F.lit(0)).alias("label"))


def project_scores(videos: DataFrame, frames: str, scores: str, mode: str = "repeat", key: str = "video_id") -> DataFrame:
    """key, frame, score: an array of segment scores stretched over the frames, by repetition, by linear interpolation
    between segment centers (flat beyond the outer ones), or by the whole units of 16 frames that each segment was read from
    (c3d_units), where segments of a short video that share their frames give these their mean."""
    if mode == "c3d_units":
        rows = videos.select(key, F.col(frames).cast("long").alias("_n"), F.posexplode(scores).alias("_i", "_x"), F.size(scores).cast("long").alias("_s"))
        units, i = F.ceil(F.col("_n") / 16).cast("long"), F.col("_i").cast("long")
        first = F.floor(i * units / F.col("_s")).cast("long")
        last = F.when(units < F.col("_s"), first + 1).otherwise(F.floor((i + 1) * units / F.col("_s")).cast("long"))
        ranges = rows.withColumn("_low", first * 16).withColumn("_high", F.least(last * 16, F.col("_n"))).groupBy(key, "_low", "_high").agg(F.avg("_x").alias("score"))
        return ranges.select(key, F.explode(F.sequence("_low", F.col("_high") - 1)).alias("frame"), "score")
    n, s = F.col(frames).cast("long"), F.size(scores)
    grid = videos.select(key, scores, n.alias("_n"), s.alias("_s"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("frame"))
    at = lambda i: F.element_at(scores, (i + 1).cast("int"))
    n, s, f = F.col("_n"), F.col("_s"), F.col("frame")
    if mode == "repeat":
        few = F.least(F.floor((f + 0.5) * s / n), s - 1)
        # the last segment whose start floor(i * n / s) is at or before the frame
        many = F.floor((f * s + s - 1) / n)
        value = at(F.when(n < s, few).otherwise(F.least(many, s - 1)))
    elif mode == "interpolate":
        x = (f + F.lit(0.5)) / n * s - F.lit(0.5)
        low = F.greatest(F.least(F.floor(x), s - 2), F.lit(0))
        share = F.greatest(F.least(x - low, F.lit(1.0)), F.lit(0.0))
        value = F.when(s == 1, at(F.lit(0))).otherwise(at(low) + (at(F.least(low + 1, s - 1)) - at(low)) * share)
    else:
        raise ValueError("mode must be repeat, interpolate or c3d_units")
    return grid.select(key, "frame", value.alias("score"))


def islands(rows: DataFrame, joins: Column, key: str, order: list[str], of: dict[str, Column]) -> DataFrame:
    """key, _chunk, _n (from 1), of: stretches of the rows of each (key, _chunk), in order, and what `of` aggregates of them; joins (null: no) says
    that a row goes on with what is before it. One shuffle and sort by (key, _chunk)."""
    inside = W.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = rows.withColumn("_goes_on", F.coalesce(joins, F.lit(False))).withColumn("_n", F.count_if(~F.col("_goes_on")).over(inside))
    return numbered.groupBy(key, "_chunk", "_n").agg(*[c.alias(name) for name, c in of.items()])


def merge_intervals(df: DataFrame, key: str = "video_id", chunk_seconds: float = CHUNK_SECONDS) -> DataFrame:
    """key, start_s, end_s: the union of each key's intervals; touching ones merge. A key's time is cut into chunks, which are
    merged on their own; so a long video is many tasks, and the result is the same for any chunk_seconds.

    What an earlier chunk reaches takes in the first islands of a chunk: they belong to the last island that begins, in
    whatever chunk, without being reached. Both are running maxima over one row a chunk."""
    rows = df.select(key, "start_s", "end_s").withColumn("_chunk", F.floor(F.col("start_s") / chunk_seconds))
    before = W.partitionBy(key, "_chunk").orderBy("start_s", "end_s").rowsBetween(W.unboundedPreceding, -1)
    own = islands(rows, F.col("start_s") <= F.max("end_s").over(before), key, ["start_s", "end_s"], {"start_s": F.min("start_s"), "end_s": F.max("end_s")})
    earlier = W.partitionBy(key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = own.groupBy(key, "_chunk").agg(F.max("end_s").alias("_top"), F.max("start_s").alias("_last")).withColumn("_reach", F.max("_top").over(earlier))
    begun = F.when(F.col("_reach").isNull() | (F.col("_last") > F.col("_reach")), F.col("_last"))
    chunks = chunks.withColumn("_begun", begun).select(key, "_chunk", "_reach", F.max("_begun").over(earlier).alias("_from"))
    name = F.when(F.col("start_s") <= F.col("_reach"), F.col("_from")).otherwise(F.col("start_s"))
    return own.join(chunks, [key, "_chunk"]).groupBy(key, name.alias("_island")).agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")).drop("_island")


def cover(first: Column, last: Column, levels: int) -> Column:
    """The nodes (level, node) of a binary tree over whole numbers that cover first .. last, each number once: two a level at
    most, so an interval has some 2 * levels nodes. It has fewer than 2**levels numbers."""
    level = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    low, high = lambda k: F.ceil(first / level(k)), lambda k: F.floor((last + 1) / level(k))
    at = lambda k: F.filter(
        F.array(F.struct(k.alias("level"), F.when((low(k) < high(k)) & (low(k) % 2 != 0), low(k)).alias("node")), F.struct(k.alias("level"), F.when((low(k) < high(k)) & (high(k) % 2 != 0), high(k) - 1).alias("node"))),
        lambda x: x["node"].isNotNull(),
    )
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))


def ancestors(point: Column, levels: int) -> Column:
    """The nodes (level, node) up to a level that hold a whole number."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("level"), F.floor(point / F.call_function("shiftleft", F.lit(1).cast("long"), k)).alias("node")))


def overlap_join(left: DataFrame, right: DataFrame, key: str = "video_id", cell_seconds: float = CELL_SECONDS) -> DataFrame:
    """Overlapping pairs of half-open intervals of one key: key, a_start, a_end, b_start, b_end, overlap.

    Of two that overlap, one begins in the other (of equal starts, the right one in the left one), so a pair is found once: as
    a start that lies in an interval. Intervals are covered by nodes of a binary tree over cells of cell_seconds, and a start
    by the nodes above its cell, up to the level of the longest interval. So the join is by equal nodes, an interval has rows
    as the logarithm of its length, and what is joined in vain shares a cell."""
    cell = lambda x: F.floor(F.col(x) / cell_seconds)
    a = left.select(key, F.col("start_s").alias("a_start"), F.col("end_s").alias("a_end")).where("a_start < a_end")
    b = right.select(key, F.col("start_s").alias("b_start"), F.col("end_s").alias("b_end")).where("b_start < b_end")
    spans = a.select((cell("a_end") - cell("a_start")).alias("cells")).unionByName(b.select((cell("b_end") - cell("b_start")).alias("cells")))
    levels = (spans.agg(F.max("cells")).first()[0] or 0).bit_length()
    covered = lambda df, x, y: df.select("*", F.inline(cover(cell(x), cell(y), levels)))
    raised = lambda df, x: df.select("*", F.inline(ancestors(cell(x), levels)))
    nodes = [key, "level", "node"]
    right_in_left = covered(a, "a_start", "a_end").join(raised(b, "b_start"), nodes).where("a_start <= b_start AND b_start < a_end")
    left_in_right = raised(a, "a_start").join(covered(b, "b_start", "b_end"), nodes).where("b_start < a_start AND a_start < b_end")
    pairs = right_in_left.unionByName(left_in_right)
    return pairs.select(key, "a_start", "a_end", "b_start", "b_end", (F.least("a_end", "b_end") - F.greatest("a_start", "b_start")).alias("overlap"))


def temporal_false_alert(alerts: DataFrame, events: DataFrame, videos: DataFrame, key: str = "video_id") -> DataFrame:
    """key, false_seconds (alerted outside events), negative_seconds (duration outside events, at least 0). videos has key
    and duration; alerts and events are merged first, once each."""
    alerts, events = checkpoint(merge_intervals(alerts, key)), checkpoint(merge_intervals(events, key))
    seconds = lambda df, name: df.groupBy(key).agg(F.sum(F.col("end_s") - F.col("start_s")).alias(name))
    shared = overlap_join(alerts, events, key).groupBy(key).agg(F.sum("overlap").alias("shared"))
    rows = videos.join(seconds(alerts, "alerted"), key, "left").join(seconds(events, "event"), key, "left").join(shared, key, "left").fillna(0.0, ["alerted", "event", "shared"])
    return rows.select(key, (F.col("alerted") - F.col("shared")).alias("false_seconds"), F.greatest(F.col("duration") - F.col("event"), F.lit(0.0)).alias("negative_seconds"))


def suspicious_runs(segments: DataFrame, threshold: float, key: str = "video_id", chunk_segments: int = CHUNK_SEGMENTS) -> DataFrame:
    """key, start_s, end_s, top: runs of segments at or above threshold, merged in segment order where one starts no later
    than the one before it ends. A key is cut into chunks of segments; what crosses their borders is carried, so a long
    video is many tasks."""
    good = segments.where(F.col("score") >= threshold).withColumn("_chunk", F.floor(F.col("seg") / chunk_segments))
    before = F.lag("end_s").over(W.partitionBy(key, "_chunk").orderBy("seg"))
    of = {"seg": F.min("seg"), "_first": F.min_by("start_s", "seg"), "_end": F.max_by("end_s", "seg"), "start_s": F.min("start_s"), "end_s": F.max("end_s"), "top": F.max("score")}
    own = islands(good, F.col("start_s") <= before, key, ["seg"], of)
    earlier = W.partitionBy(key).orderBy("_chunk")
    chunks = own.groupBy(key, "_chunk").agg(F.min_by("_first", "seg").alias("_first"), F.max_by("_end", "seg").alias("_end"), F.max("seg").alias("_last"), F.count("*").alias("_runs"))
    chunks = chunks.withColumn("_carried", F.coalesce(F.col("_first") <= F.lag("_end").over(earlier), F.lit(False)))
    begun = F.when((F.col("_runs") > 1) | ~F.col("_carried"), F.col("_last"))
    chunks = chunks.withColumn("_begun", begun).select(key, "_chunk", "_carried", F.max("_begun").over(earlier.rowsBetween(W.unboundedPreceding, -1)).alias("_from"))
    name = F.when(F.col("_carried") & (F.col("_n") == 1), F.col("_from")).otherwise(F.col("seg"))
    return own.join(chunks, [key, "_chunk"]).groupBy(key, name.alias("_run")).agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.max("top").alias("top")).drop("_run")


def grid_windows(frames: DataFrame, width: int, margin: int, key: str = "video_id") -> DataFrame:
    """key, start, kind: tumbling windows of whole width whose frames are all labelled 1 (violent), or all 0 without a label 1
    within margin frames of them (normal). frames has key, frame, label from frame 0 without gaps.

    Frames are aggregated to windows; a window with a label 1 marks the windows that its first and last such frame are near
    to, and the marks meet the windows in a second aggregate, so no task orders a video."""
    at = lambda x: F.floor(x / width).cast("long") * width
    positive = F.when(F.col("label") == 1, F.col("frame").cast("long"))
    grouped = frames.groupBy(key, at(F.col("frame")).alias("start")).agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("ones"), F.count_if(F.col("label") == 0).alias("zeros"), F.min(positive).alias("_low"), F.max(positive).alias("_high"))
    near = F.sequence(at(F.col("_low") - width - margin) + width, at(F.col("_high") + margin), F.lit(width).cast("long"))
    own = F.struct("start", "n", "ones", "zeros", F.lit(0).alias("marked"))
    none = F.lit(0).cast("long")
    marks = F.transform(F.coalesce(near, F.array().cast("array<bigint>")), lambda s: F.struct(s.alias("start"), none.alias("n"), none.alias("ones"), none.alias("zeros"), F.lit(1).alias("marked")))
    met = grouped.select(key, F.inline(F.concat(F.array(own), marks))).groupBy(key, "start").agg(*[F.max(c).alias(c) for c in ("n", "ones", "zeros", "marked")])
    kind = F.when(F.col("ones") == width, "violent").when((F.col("zeros") == width) & (F.col("marked") == 0), "normal")
    return met.where(F.col("n") == width).withColumn("kind", kind).where("kind IS NOT NULL").select(key, "start", "kind")


def evenly(df: DataFrame, k: int | Column, key: str | list[str], order: str) -> DataFrame:
    """k evenly spaced rows of each key in the given order (the middles of k equal stretches); all if there are fewer. order is
    numeric; k may be a column that is constant within a key. Positions are running counts over ranges of the order, so no
    task orders a key."""
    by = [key] if isinstance(key, str) else key
    most = F.lit(k) if isinstance(k, int) else k
    rows = running_totals(df.withColumn("_one", F.lit(1).cast("long")), order, ["_one"], by)
    rows = rows.join(df.groupBy(*by).agg(F.count("*").alias("_n")), by)
    wanted = F.transform(F.sequence(F.lit(0), most - 1), lambda i: F.floor((i + F.lit(0.5)) * F.col("_n") / most).cast("long"))
    return rows.where((F.col("_n") <= most) | F.array_contains(wanted, F.col("cum__one") - 1)).select(*df.columns)


def centered_frames(center: Column, first: Column, last: Column, before: int = 5, after: int = 4) -> Column:
    """Frame numbers center - before .. center + after, clamped to [first, last)."""
    return F.transform(F.sequence(F.lit(-before), F.lit(after)), lambda o: F.greatest(first, F.least(last - 1, center + o)))


def top_windows(segments: DataFrame, threshold: float, k: int = 3, key: str = "video_id") -> DataFrame:
    """The k best distinct intervals of each key at or above threshold, by (score descending, segment): rank from 1."""
    best = W.partitionBy(key, "start_s", "end_s").orderBy(F.col("score").desc(), "seg")
    rows = segments.where(F.col("score") >= threshold).withColumn("_first", F.row_number().over(best)).where("_first = 1")
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.col("score").desc(), "seg"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).drop("_first")


#: Scores whose moving average one array folds; longer stretches are folded piece by piece.
FOLDED_AT_ONCE = 256


def levels(values: Column, initial: Column, following: Callable[[Column, Column], Column]) -> Column:
    """initial, and for each value what it makes of the level before."""
    return F.aggregate(values, F.array(initial), lambda out, x: F.array_append(out, following(F.element_at(out, -1), x)))


def moving_average(rows: DataFrame, alpha: float, keys: list[str], at: str, score: str, piece: int = FOLDED_AT_ONCE) -> DataFrame:
    """rows and level: alpha * score + (1 - alpha) * the level before, in the order of at (0, 1, ... within keys); the first
    level is the first score.

    Averaging over n scores maps the level before them to (1 - alpha)**n times it plus a shift, and such maps chain. So each
    piece of a stretch is folded to its map, the maps before a piece give the level that it begins with, and the pieces are
    then folded on their own: no array holds a long stretch."""
    cut, first = [*keys, "_piece"], F.col("_piece") == 0
    step = lambda level, x: alpha * x + (1 - alpha) * level
    carried = [at, *[c for c in rows.columns if c not in (*keys, at)]]  # in order of at, which is never repeated
    pieces = rows.withColumn("_piece", F.expr(f"{at} div {piece}")).groupBy(*cut).agg(F.array_sort(F.collect_list(F.struct(*carried))).alias("_own"))
    scores = F.transform("_own", lambda x: x[score])
    # the first piece begins with its own first score, as if that had been the level already
    start = F.when(first, F.get(scores, F.lit(0))).otherwise(0.0)
    mapped = F.struct("_piece", F.when(first, 0.0).otherwise(F.pow(F.lit(1 - alpha), F.size("_own"))).alias("scale"), F.aggregate(scores, start, step).alias("shift"))
    maps = pieces.select(*keys, mapped.alias("_map")).groupBy(*keys).agg(F.array_sort(F.collect_list("_map")).alias("_maps"))
    begins = maps.select(*keys, F.posexplode(levels(F.col("_maps"), F.lit(0.0), lambda level, m: m["scale"] * level + m["shift"])).alias("_n", "_begin"))
    begun = pieces.join(begins.select(*keys, F.col("_n").cast("long").alias("_piece"), "_begin"), cut)
    found = F.slice(levels(scores, F.when(first, F.get(scores, F.lit(0))).otherwise(F.col("_begin")), step), 2, piece)
    joined = F.zip_with("_own", found, lambda own, level: F.struct(*[own[c].alias(c) for c in carried], level.alias("level")))
    return begun.select(*keys, F.inline(joined)).select(*rows.columns, "level")


def hysteresis_alerts(segments: DataFrame, on: float = 0.5, off: float = 0.5, min_duration: float = 0.0, alpha: float = 1.0, key: str = "video_id") -> DataFrame:
    """key, start_s, end_s, decision_time: alerts of a causal moving average with on and off levels and persistence.

    A gap between intervals closes an alert and restarts the average. An alert starts where the average reaches on, ends
    where it falls below off, and is decided at the end of the first interval by which it has lasted min_duration. Gaps cut
    a key's intervals into stretches; in a stretch an interval is on if the last average at or above on, or below off, up
    to it was at or above on, and a run of intervals that are on is an alert."""
    if not 0 <= off <= on <= 1 or min_duration < 0 or not 0 < alpha <= 1:
        raise ValueError("expected 0 <= off <= on <= 1, min_duration >= 0 and 0 < alpha <= 1")
    stretch = [key, "_stretch"]
    whole = W.partitionBy(key).orderBy("start_s", "end_s", "score")
    rows = segments.select(key, "start_s", "end_s", "score").withColumn("_gap", F.coalesce(F.col("start_s") > F.lag("end_s").over(whole), F.lit(True)))
    rows = rows.withColumn("_stretch", F.sum(F.col("_gap").cast("long")).over(whole.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("_at", (F.row_number().over(W.partitionBy(*stretch).orderBy("start_s", "end_s", "score")) - 1).cast("long"))
    rows = rows.withColumn("level", F.col("score")) if alpha == 1 else moving_average(rows, alpha, stretch, "_at", "score")
    order = W.partitionBy(*stretch).orderBy("_at")
    decisive = F.when(F.col("level") >= on, True).when(F.col("level") < off, False)
    rows = rows.withColumn("_on", F.coalesce(F.last(decisive, ignorenulls=True).over(order), F.lit(False)))
    turns = F.coalesce(F.col("_on") != F.lag("_on").over(order), F.lit(True))
    rows = rows.withColumn("_run", F.sum(turns.cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("_since", F.first("start_s").over(W.partitionBy(*stretch, "_run").orderBy("_at")))
    lasted = F.when(F.col("end_s") - F.col("_since") >= min_duration, F.struct("_at", "end_s"))
    runs = rows.groupBy(*stretch, "_run", "_on", "_since").agg(F.max(F.struct("_at", "end_s")).alias("_last"), F.min(lasted).alias("_decided"))
    runs = runs.withColumn("_next", F.lead("_since").over(W.partitionBy(*stretch).orderBy("_run")))
    alerts = runs.where("_on AND _decided IS NOT NULL")
    return alerts.select(key, F.col("_since").alias("start_s"), F.coalesce("_next", "_last.end_s").alias("end_s"), F.col("_decided.end_s").alias("decision_time"))


def segment_bag(units: DataFrame, segments: int, key: str = "video_id") -> DataFrame:
    """key, seg, vector: the mean of the unit vectors of each segment, scaled to length 1. units has key, unit (from 0) and
    vector; dimensions are averaged as rows, so no task holds a video's matrix."""
    count = units.groupBy(key).agg((F.max("unit") + 1).alias("_n"))
    bounds = segment_bounds(count, "_n", segments).select(key, "seg", F.explode(F.sequence("first", F.col("last") - 1)).alias("unit"))
    parts = bounds.join(units, [key, "unit"]).select(key, "seg", F.posexplode("vector").alias("dim", "x"))
    means = parts.groupBy(key, "seg", "dim").agg(F.avg("x").alias("x"))
    bags = means.groupBy(key, "seg").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("_v"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, v: a + v["x"] * v["x"]))
    return bags.select(key, "seg", F.transform("_v", lambda v: v["x"] / F.greatest(norm, F.lit(1e-12))).alias("vector"))


def mil_objective(bags: DataFrame, sparsity: float = 8e-5, smoothness: float = 8e-5, margin: float = 1.0) -> DataFrame:
    """ranking, sparsity, smoothness and total of paired bags: rows have pair, seg, abnormal and normal scores."""
    step = F.col("abnormal") - F.lag("abnormal").over(W.partitionBy("pair").orderBy("seg"))
    per = bags.withColumn("_step", step).groupBy("pair").agg(
        F.greatest(margin - F.max("abnormal") + F.max("normal"), F.lit(0.0)).alias("hinge"), F.sum("abnormal").alias("total_score"), F.coalesce(F.sum(F.col("_step") * F.col("_step")), F.lit(0.0)).alias("rough")
    )
    means = per.agg(F.avg("hinge").alias("ranking"), F.avg("total_score").alias("sparsity"), F.avg("rough").alias("smoothness"))
    return means.withColumn("total", F.col("ranking") + sparsity * F.col("sparsity") + smoothness * F.col("smoothness"))
