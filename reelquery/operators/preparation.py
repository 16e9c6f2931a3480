"""Preparing data sets end to end: files, labels and box annotations become records and scenes, and an audit of clips. What
breaks a rule is listed with a code; the prepare_ functions raise over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelquery.operators.intervals import centered_frames
from reelquery.operators.studies import behavior_class
from reelquery.sources.manifests import require_none

# Folder names (lower case) of abnormal and normal categories, and of files that belong to another task.
ABNORMAL = ("abuse", "arrest", "arson", "assault", "burglary", "explosion", "fighting", "roadaccidents", "robbery", "shooting", "shoplifting", "stealing", "vandalism")
NORMAL = (
    "normal", "normal_videos", "normalvideos", "training-normal-videos-part-1", "training-normal-videos-part-2",
    "training_normal_videos_anomaly", "testing_normal_videos_anomaly", "testing_normal_videos",
)
SKIPPED = ("normal_videos_for_event_recognition", "normal_videos_event")
# Classes of human behaviour in the order of their numbers, and categories outside them.
BEHAVIORS = ("Normal", "Abuse", "Assault", "Fighting", "Robbery", "Vandalism")
OTHER_CATEGORIES = ("Arrest", "Arson", "Accident", "RoadAccidents", "Burglary", "Explosion", "Shooting", "Stealing", "Shoplifting")
# Classes of group activities in the order of their numbers; action 1 of an annotation is no class, 2 the first.
ACTIVITIES = ("crossing", "waiting", "queueing", "walking", "talking")
SPLITS = ("train", "val", "test")


def stem(name: Column) -> Column:
    """The last part of a path, without its suffix."""
    return F.regexp_replace(F.substring_index(name, "/", -1), r"(?<=.)[.][^.]*$", "")


def recording(name: Column) -> Column:
    """The recording that a file's or folder's name tells by an encoder suffix, in lower case; null if it tells none."""
    found = F.regexp_extract(stem(name), r"(?i)^(.+\d+)_x264(?:[_-].*)?$", 1)
    return F.when(found != "", F.lower(found))


def with_source(files: DataFrame, mapping: DataFrame | None) -> DataFrame:
    """files and source: the mapped recording (mapping: name, source), or else the one that the name tells."""
    if mapping is None:
        return files.withColumn("source", recording(F.col("name")))
    given = mapping.select("name", F.lower("source").alias("_given"))
    return files.join(given, "name", "left").withColumn("source", F.coalesce("_given", recording(F.col("name")))).drop("_given")


def first_code(cases: list[tuple[Column, str]]) -> Column:
    """The code of the first case that holds; null if none does. A null condition does not hold."""
    return F.coalesce(*[F.when(F.coalesce(when, F.lit(False)), F.lit(code)) for when, code in cases])


def folder_records(files: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """name, video_id, source, category, label, code of files (name: a path below the root) whose folders name a category: the
    first folder that does counts, label is 1 for an abnormal one. Files in a folder of SKIPPED are left out. code is
    unknown_category or unknown_source where a record can't be made."""
    folders = F.split("name", "/")
    folders = F.slice(folders, 1, F.size(folders) - 1)
    rows = files.select("name", folders.alias("_f")).where(~F.exists("_f", lambda x: F.lower(x).isin(*SKIPPED)))
    rows = rows.withColumn("category", F.get(F.filter("_f", lambda x: F.lower(x).isin(*ABNORMAL, *NORMAL)), F.lit(0)))
    rows = with_source(rows, mapping)
    code = first_code([(F.col("category").isNull(), "unknown_category"), (F.col("source").isNull(), "unknown_source")])
    return rows.select("name", F.regexp_replace("name", r"(?<=[^/])[.][^./]*$", "").alias("video_id"), "source", "category", F.lower("category").isin(*ABNORMAL).cast("int").alias("label"), code.alias("code"))


def labelled_records(files: DataFrame, labels: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """name, source, category, label, code of files (name) and their labels (name, label, category, source; the last two may be
    null or blank). Either side must be complete: code is missing_label or missing_file for what only one side has,
    repeated_label, unknown_label or unknown_source for what gives no record. A blank category is the file's folder."""
    blank = lambda c: F.when(F.trim(c) != "", F.col(c))
    given = labels.groupBy("name").agg(F.count("*").alias("_n"), F.min("label").alias("label"), F.min(blank("category")).alias("_category"), F.min(F.lower(blank("source"))).alias("_source"))
    rows = files.select("name", F.lit(True).alias("_there")).join(given, "name", "full")
    folder = F.get(F.reverse(F.split("name", "/")), F.lit(1))
    rows = with_source(rows, mapping).withColumn("source", F.coalesce("_source", "source")).withColumn("category", F.coalesce("_category", folder))
    code = first_code([
        (F.col("_there").isNull(), "missing_file"), (F.col("_n").isNull(), "missing_label"), (F.col("_n") > 1, "repeated_label"),
        (~F.coalesce(F.col("label").isin(0, 1), F.lit(False)), "unknown_label"), (F.col("source").isNull(), "unknown_source"),
    ])
    return rows.select("name", "source", "category", "label", code.alias("code"))


def prepared(records: DataFrame) -> DataFrame:
    """The records without their code; raises if any has one."""
    require_none(records.where("code IS NOT NULL").select("name", "code"), "records can't be prepared")
    return records.drop("code")


def visible(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """boxes (x, y, w, h in pixels) and left, top, right, bottom of what the image shows, clipped (whether that is less)."""
    inner = boxes.withColumn("left", F.greatest(F.lit(0), "x")).withColumn("top", F.greatest(F.lit(0), "y")).withColumn("right", F.least(F.lit(width), F.col("x") + F.col("w"))).withColumn("bottom", F.least(F.lit(height), F.col("y") + F.col("h")))
    return inner.withColumn("clipped", (F.col("left") != F.col("x")) | (F.col("top") != F.col("y")) | (F.col("right") != F.col("x") + F.col("w")) | (F.col("bottom") != F.col("y") + F.col("h")))


def box_corrections(boxes: DataFrame, width: int, height: int, every: int = 10) -> DataFrame:
    """sequence, line, frame, raw and clipped box of boxes that reach beyond the image, and whether a scene uses them."""
    rows = visible(boxes, width, height).where("clipped AND w > 0 AND h > 0 AND left < right AND top < bottom")
    return rows.select("sequence", "line", "frame", "x", "y", "w", "h", "left", "top", "right", "bottom", ((F.col("frame") % every == 1) & (F.col("action") != 1)).alias("selected"))


def sequence_violations(frames: DataFrame, boxes: DataFrame, splits: DataFrame, width: int, height: int, every: int = 10, strict: bool = True) -> DataFrame:
    """sequence, frame (null: the sequence as a whole), code of what keeps sequences from being prepared.

    frames has sequence, frame (one row a file); boxes sequence, line, frame, x, y, w, h, action; splits sequence, split. Only
    sequences of a split are looked at. Frames must run from 1 without gaps or repeats; a line needs whole numbers, a frame
    from 1, an action of 1 to 6, and a box with an area, inside the image (strict) or at least partly visible; no box
    comes twice in a frame; every centre needs an actor with a class, every sequence a centre, and no centre lies beyond
    the frames. Each check is an aggregate over a sequence or a frame; no window is needed to find a gap."""
    kept = splits.select("sequence").distinct()
    both = splits.groupBy("sequence").agg(F.count_distinct("split").alias("n"), F.count("*").alias("rows"))
    both = both.select("sequence", F.lit(None).cast("long").alias("frame"), F.when(F.col("n") > 1, "crosses_splits").when(F.col("rows") > 1, "repeated_sequence").alias("code"))

    clocks = frames.groupBy("sequence", "frame").agg(F.count("*").alias("n")).groupBy("sequence").agg(F.max("n").alias("copies"), F.count("*").alias("n"), F.min("frame").alias("low"), F.max("frame").alias("high"))
    lines = visible(boxes.join(kept, "sequence", "left_semi"), width, height)
    centre = F.col("frame") % every == 1
    at = lines.groupBy("sequence", "frame").agg(F.count_if(F.col("action") != 1).alias("actors"))
    centres = at.where(centre).groupBy("sequence").agg(F.max("frame").alias("last"))
    whole = kept.join(clocks, "sequence", "left").join(centres, "sequence", "left")
    codes = [
        (F.col("n").isNull(), "no_frames"), (F.col("copies") > 1, "repeated_frame"), ((F.col("low") != 1) | (F.col("high") != F.col("n")), "missing_frames"),
        (F.col("last").isNull(), "no_scenes"), (F.col("last") > F.col("high"), "center_beyond_frames"),
    ]
    listed = lambda cases: F.explode(F.array_compact(F.array(*[F.when(when, F.lit(code)) for when, code in cases])))
    whole = whole.select("sequence", F.lit(None).cast("long").alias("frame"), listed(codes).alias("code"))

    area = (F.col("w") > 0) & (F.col("h") > 0)
    seen = (F.col("left") < F.col("right")) & (F.col("top") < F.col("bottom"))
    broken = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in ("frame", "x", "y", "w", "h", "action")])
    own = [(broken, "broken_line"), (F.col("frame") < 1, "invalid_frame"), (~F.col("action").between(1, 6), "unknown_action"), (~area, "empty_box"), (area & ~seen, "invisible_box")]
    own += [(area & seen & F.col("clipped"), "outside_image")] if strict else []
    by_line = lines.select("sequence", "frame", listed(own).alias("code")).distinct()
    twice = lines.where(~broken).groupBy("sequence", "frame", "left", "top", "right", "bottom").agg(F.count("*").alias("n")).where("n > 1").select("sequence", "frame", F.lit("duplicate_box").alias("code")).distinct()
    empty = at.where(centre & (F.col("actors") == 0)).select("sequence", "frame", F.lit("no_actors").alias("code"))
    parts = [both.where("code IS NOT NULL"), whole, by_line, twice, empty]
    return reduce(DataFrame.unionByName, [p.withColumn("frame", F.col("frame").cast("long")) for p in parts])


def sequence_scenes(frames: DataFrame, boxes: DataFrame, splits: DataFrame, width: int, height: int, every: int = 10) -> DataFrame:
    """sequence, frame, clip_id, split, group_label, actors, frame_indices: a scene of every `every`-th frame (from 1) that has an
    actor with a class. actors, in the order of lines, have the visible box in unit coordinates and the action - 2 as label;
    group_label is the most frequent label, on ties the smallest; frame_indices are ten frames around the centre."""
    rows = visible(boxes.join(splits.select("sequence").distinct(), "sequence", "left_semi"), width, height).where((F.col("frame") % every == 1) & F.col("action").between(2, 6) & (F.col("left") < F.col("right")) & (F.col("top") < F.col("bottom")))
    unit = lambda c, size: (F.col(c) / size).alias({"left": "x1", "top": "y1", "right": "x2", "bottom": "y2"}[c])
    actor = F.struct("line", unit("left", width), unit("top", height), unit("right", width), unit("bottom", height), (F.col("action") - 2).cast("int").alias("label"))
    found = rows.groupBy("sequence", "frame").agg(F.array_sort(F.collect_list(actor)).alias("_a"))
    votes = F.transform(F.array(*map(F.lit, range(len(ACTIVITIES)))), lambda c: F.struct(F.size(F.filter("_a", lambda a: a["label"] == c)).alias("n"), (-c).alias("c")))
    actors = F.transform("_a", lambda a: F.struct(a["x1"].alias("x1"), a["y1"].alias("y1"), a["x2"].alias("x2"), a["y2"].alias("y2"), a["label"].alias("label")))
    last = frames.groupBy("sequence").agg(F.max("frame").alias("_last"))
    parts = splits.groupBy("sequence").agg(F.min("split").alias("split"))
    rows = found.join(parts, "sequence").join(last, "sequence")
    return rows.select(
        "sequence", "frame", F.concat_ws(":", F.col("sequence").cast("string"), F.lpad(F.col("frame").cast("string"), 4, "0")).alias("clip_id"), "split", (-F.array_max(votes)["c"]).cast("int").alias("group_label"),
        actors.alias("actors"), centered_frames(F.col("frame"), F.lit(1), F.col("_last") + 1).alias("frame_indices"),
    )


def prepare_sequences(frames: DataFrame, boxes: DataFrame, splits: DataFrame, width: int, height: int, every: int = 10, strict: bool = True) -> DataFrame:
    """sequence_scenes(), after raising over sequence_violations()."""
    require_none(sequence_violations(frames, boxes, splits, width, height, every, strict), "sequences can't be prepared")
    return sequence_scenes(frames, boxes, splits, width, height, every)


def scene_counts(scenes: DataFrame) -> DataFrame:
    """split, kind, value, n over scenes (sequence, split, group_label, actors): for each of SPLITS its sequences, scenes and
    actors (value is empty) and how many actors and scenes have each class, zeros included."""
    spark = scenes.sparkSession
    one = lambda kind, value, n: F.struct(F.lit(kind).alias("kind"), value.alias("value"), n.cast("long").alias("n"))
    named = lambda number: F.get(F.array(*map(F.lit, ACTIVITIES)), number)
    blank = F.lit("")
    facts = F.concat(
        F.array(one("scenes", blank, F.lit(1)), one("actors", blank, F.size("actors")), one("group_class", named(F.col("group_label")), F.lit(1))),
        F.transform("actors", lambda a: one("actor_class", named(a["label"]), F.lit(1))),
    )
    counts = scenes.select("split", F.inline(facts)).groupBy("split", "kind", "value").agg(F.sum("n").alias("n"))
    sources = scenes.groupBy("split").agg(F.count_distinct("sequence").alias("n")).select("split", F.lit("sequences").alias("kind"), blank.alias("value"), "n")
    grid = [(s, kind, "") for s in SPLITS for kind in ("sequences", "scenes", "actors")] + [(s, kind, c) for s in SPLITS for kind in ("actor_class", "group_class") for c in ACTIVITIES]
    wanted = spark.createDataFrame(grid, "split string, kind string, value string")
    return wanted.join(counts.unionByName(sources), ["split", "kind", "value"], "left").select("split", "kind", "value", F.coalesce("n", F.lit(0)).alias("n"))


def crowded(scenes: DataFrame, most: int) -> DataFrame:
    """clip_id, actors of scenes with more than `most` actors."""
    return scenes.select("clip_id", F.size("actors").alias("actors")).where(F.col("actors") > most)


def clip_audit(clips: DataFrame, labels: DataFrame) -> DataFrame:
    """name, clip_id, source, category, binary_label, group_label, selected, reason, code and the other columns of clips (name:
    category/recording/clip, sha256, readable). labels: clip_id, category, label, one a clip.

    reason says why a clip is not selected: unreadable_video, missing_or_invalid_annotation or excluded_category. code says
    what forbids an audit: repeated_clip, source_disagreement (the clip's and its folder's recording differ, or neither
    is known), category_disagreement, unknown_category, abnormal_normal."""
    parts = F.split("name", "/")
    rows = clips.select("*", stem(F.col("name")).alias("clip_id"), F.get(parts, F.lit(0)).alias("category"), recording(F.col("name")).alias("source"), recording(F.get(F.reverse(parts), F.lit(1))).alias("_parent"))
    copies = rows.groupBy("clip_id").agg(F.count("*").alias("_copies")).where("_copies > 1")
    given = labels.select("clip_id", F.col("category").alias("_category"), F.col("label").alias("binary_label"), F.lit(True).alias("_labelled"))
    rows = rows.join(given, "clip_id", "left").join(copies, "clip_id", "left")
    group = behavior_class(F.col("category"), F.col("binary_label"), list(BEHAVIORS), list(OTHER_CATEGORIES))
    rows = rows.withColumn("group_label", F.when(F.col("_labelled"), group))
    labelled = F.coalesce("_labelled", F.lit(False))
    readable = F.coalesce("readable", F.lit(False))
    reason = F.when(~readable, "unreadable_video").when(~labelled, "missing_or_invalid_annotation").when(F.col("group_label").isNull(), "excluded_category")
    code = first_code([
        (F.col("_copies").isNotNull(), "repeated_clip"), (F.col("source").isNull() | ~F.col("source").eqNullSafe(F.col("_parent")), "source_disagreement"),
        (labelled & ~F.col("_category").eqNullSafe(F.col("category")), "category_disagreement"), (labelled & ~F.col("category").isin(*BEHAVIORS, *OTHER_CATEGORIES), "unknown_category"),
        ((F.col("category") == "Normal") & (F.col("binary_label") == 1), "abnormal_normal"),
    ])
    own = [c for c in clips.columns if c != "name"]
    return rows.select("name", "clip_id", "source", "category", "binary_label", "group_label", reason.isNull().alias("selected"), reason.alias("reason"), code.alias("code"), *own)


def audit_counts(audited: DataFrame) -> DataFrame:
    """kind, value, n of audited clips (width, height, fps beside the columns of clip_audit()): totals, readable and unreadable
    clips, sources, categories, binary labels, classes of selected clips, reasons of the others, and resolutions and frame
    rates of readable clips. All but the sources are one grouping of exploded facts."""
    fact = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    readable = F.coalesce("readable", F.lit(False))
    blank = F.lit("")
    facts = F.array_compact(F.array(
        fact("total", blank), fact("readable", F.when(readable, "yes").otherwise("no")), fact("category", F.col("category")), fact("binary_label", F.coalesce(F.col("binary_label").cast("string"), F.lit("none"))),
        F.when(F.col("selected"), fact("selected_class", F.get(F.array(*map(F.lit, BEHAVIORS)), F.col("group_label")))), F.when(~F.col("selected"), fact("exclusion", F.col("reason"))),
        F.when(readable, fact("resolution", F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string")))), F.when(readable, fact("fps", F.col("fps"))),
    ))
    counts = audited.select(F.inline(facts)).groupBy("kind", "value").agg(F.count("*").alias("n"))
    sources = audited.agg(F.count_distinct("source").alias("n")).select(F.lit("sources").alias("kind"), blank.alias("value"), "n")
    return counts.unionByName(sources)


def labels_without_clips(clips: DataFrame, labels: DataFrame) -> DataFrame:
    """clip_id of labels that no clip has."""
    return labels.select("clip_id").distinct().join(clips.select(stem(F.col("name")).alias("clip_id")), "clip_id", "left_anti")
