"""Mixing sources to target weights by a low-discrepancy schedule over shuffled blocks of equally many words."""

from __future__ import annotations

from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window as W

from reelquery.llm.common import checkpoint, text_bytes

#: Weights of the sources in code point order, repeating; share of all words that the mix takes; passes over a source.
WEIGHTS, SHARE, PASSES = (5, 2, 1), 1.5, 2
#: Words of a block (a source's last block may be shorter).
BLOCK = 512
#: Documents or slots that one task ranks, on average; sources with more are dealt over several tasks.
RANKED_AT_ONCE = 512
#: Cells of the unit interval in which slots look for their source; a source lies in as many cells as it covers.
CELLS = 1_024
#: Fractional part of the golden ratio.
GOLDEN = 0.6180339887498949


@F.arrow_udf(LongType())
def n_words(text: pa.Array) -> pa.Array:
    return pa.array([0 if b is None else len(b.split()) for b in text_bytes(text)], pa.int64())


def sources_of(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES, block: int = BLOCK) -> DataFrame:
    """A row per source: sid, source, source_size, docs, target, words (the target in whole words), blocks, slots.

    Targets are share of all words, dealt by weight; none is above passes times its source's size, and what that cuts off
    is dealt again by weight. In order of size per weight the sources that reach their limit come first, so two running
    sums give the common level of the others."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    per = per.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") - 1) % len(weights) + 1)
    per = per.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(passes))
    everywhere = W.partitionBy()
    order = W.orderBy(F.col("limit") / F.col("weight"), "sid")
    per = per.withColumn("total", F.lit(share) * F.sum("source_size").over(everywhere))
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    per = per.withColumn("full", F.col("limit") * rest <= (F.col("total") - before) * F.col("weight"))
    level = F.try_divide(F.col("total") - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).over(everywhere), F.sum(F.when(~F.col("full"), F.col("weight"))).over(everywhere))
    per = per.withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(level * F.col("weight")))
    words = F.least(F.round("target").cast("long"), F.col("source_size") * passes)
    per = per.withColumn("words", words).withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    whole, rest_words = F.expr("words div greatest(source_size, 1)"), F.col("words") % F.greatest(F.col("source_size"), F.lit(1))
    slots = whole * F.col("blocks") + F.ceil(rest_words / block).cast("long")
    return per.withColumn("slots", slots).select("sid", "source", "source_size", "docs", "target", "words", "blocks", "slots")


def prefix(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """keys and before: the sum of value over the source's chunks before this one."""
    sums = rows.groupBy(*keys).agg(F.sum(value).alias("n"))
    return sums.select(*keys, (F.sum("n").over(W.partitionBy("sid").orderBy("chunk")) - F.col("n")).alias("before"))


def schedule(sources: DataFrame, n_sources: int, n_slots: int) -> DataFrame:
    """slot, sid, rank: which source each slot of the mix takes its next block from.

    Slot i stands at the fractional part of (i + 1) times the golden ratio; the cumulative numbers of slots map that point
    to a source, so every stretch of the mix has each source near its share. A source's slots are ranked 0, 1, ...; ranks
    beyond its number of slots fall out, and ranks it has not reached close the mix."""
    cells = max(CELLS, 4 * n_sources)
    order = W.orderBy("sid")
    low = (F.sum("slots").over(order) - F.col("slots")) / n_slots
    high = F.sum("slots").over(order) / n_slots
    spans = sources.where("slots > 0").select("sid", "slots", low.alias("low"), high.alias("high"))
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))))
    at = (F.col("id") + 1) * F.lit(GOLDEN)
    points = sources.sparkSession.range(n_slots).select(F.col("id").alias("slot"), (at - F.floor(at)).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * cells))
    hits = points.join(spans, "cell").where("u >= low AND u < high").select("slot", "sid", F.expr(f"slot div {RANKED_AT_ONCE}").alias("chunk"))
    inside = F.row_number().over(W.partitionBy("sid", "chunk").orderBy("slot")) - 1
    ranked = hits.withColumn("inside", inside).join(prefix(hits, ["sid", "chunk"], F.lit(1)), ["sid", "chunk"]).select("slot", "sid", (F.col("before") + F.col("inside")).alias("rank"))
    counts = hits.groupBy("sid").agg(F.count("*").alias("has"))
    need = sources.where("slots > 0").select("sid", "slots")
    missing = need.join(counts, "sid", "left").withColumn("has", F.coalesce("has", F.lit(0))).where("has < slots")
    closing = missing.select("sid", F.explode(F.sequence("has", F.col("slots") - 1)).alias("rank")).select((n_slots + F.col("rank")).alias("slot"), "sid", "rank")
    return ranked.join(need, "sid").where("rank < slots").select("slot", "sid", "rank").unionByName(closing)


def positions(sized: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """row, doc_id, size, sid, start: where each document begins in its source's shuffled stream of words. The shuffle is the
    order of md5(seed:doc_id), or of the text's md5 for rows without doc_id; a large source is cut into chunks of that
    order, so no task holds a whole source."""
    known = sources.select("sid", F.col("source").alias("of"), "docs")
    rows = sized.withColumn("mark", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.col("digest"), F.lit(""))).cast("binary")))
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("of")))
    share = F.conv(F.substring("mark", 1, 8), 16, 10).cast("double") / float(2**32)
    rows = rows.withColumn("chunk", F.floor(share * F.ceil(F.col("docs") / RANKED_AT_ONCE)))
    inside = F.sum("size").over(W.partitionBy("sid", "chunk").orderBy("mark", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    return rows.withColumn("inside", inside).join(prefix(rows, ["sid", "chunk"], F.col("size")), ["sid", "chunk"]).select("row", "doc_id", "size", "sid", (F.col("before") + F.col("inside")).alias("start"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES, block: int = BLOCK, seed: int = 7, row: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, placed documents, mix). The mix has slot, sid, pass, row, doc_id, start, size, from_word, n_words: read in
    order of slot, then start, it is the mixed stream. Words are [^\\x20\\x09-\\x0D]+; a null text has none.

    row is a key of each row of docs: the column that `row` names, or else a number given here.

    A null source is a source of its own, after all others. Documents without words are in no slot. Repeated rows are
    documents of their own. Empty tables give empty results; extra columns are ignored."""
    key = F.col(row) if row else F.monotonically_increasing_id()
    digest = F.when(F.col("doc_id").isNull(), F.md5(F.col("text").cast("string").cast("binary")))
    sized = checkpoint(docs.select(key.alias("row"), F.col("doc_id").cast("long"), F.col("source").cast("string"), digest.alias("digest"), n_words(F.col("text").cast("string")).alias("size")))
    sources = checkpoint(sources_of(sized, weights, share, passes, block))
    totals = sources.agg(F.count("*").alias("n"), F.sum("slots").alias("slots")).first()
    placed = checkpoint(positions(sized, sources, seed))
    slots = schedule(sources, totals["n"], totals["slots"] or 0).join(sources, "sid")
    slots = slots.withColumn("pass", F.expr("rank div blocks")).withColumn("block", F.col("rank") % F.col("blocks"))
    low = F.col("block") * block
    take = F.least(F.lit(block), F.col("source_size") - low, F.col("words") - F.col("pass") * F.col("source_size") - low)
    slots = slots.select("slot", "sid", "pass", "block", low.alias("low"), (low + take).alias("high"))
    parts = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
    first, last = F.greatest("low", "start"), F.least("high", F.col("start") + F.col("size"))
    spans = parts.join(slots, ["sid", "block"]).where(last > first)
    return sources, placed, spans.select("slot", "sid", "pass", "row", "doc_id", "start", "size", (first - F.col("start")).alias("from_word"), (last - first).alias("n_words"))


def taken_words(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many of each document's words the mix takes, repeats counted.

    A row per row of docs, in no order: null and empty texts have size 0 and are not taken from; rows with null or repeated
    doc_id are documents of their own; a null source is a source of its own. A text of any length is counted whole. An empty
    table gives no rows; extra columns, whatever their names, are ignored."""
    sources, placed, spans = mix(docs, **settings)
    taken = spans.groupBy("sid", "start").agg(F.sum("n_words").alias("taken"))  # a document with words has its start alone
    rows = placed.where("size > 0").join(taken, ["sid", "start"], "left").select("doc_id", "size", "sid", F.coalesce("taken", F.lit(0)).alias("taken"))
    rows = rows.unionByName(placed.where("size = 0").select("doc_id", "size", "sid", F.lit(0).cast("long").alias("taken")))
    return rows.join(sources.select("sid", "source_size", "target"), "sid").select("doc_id", "size", "source_size", "target", "taken")


def keep_mixed(docs: DataFrame, **settings) -> DataFrame:
    """The rows of the mix: each as often as a pass takes at least half of its words (0, 1, ... times). A source's last pass
    takes the beginning of its shuffled stream, so it cuts one document at most: a source's kept words miss its target by
    no more than half of one document. Rows without words are kept once, as no weight concerns them. Rows without doc_id and
    rows of equal doc_id are documents of their own. An empty table gives no rows; all columns are kept."""
    # kept with their keys, which must not change between uses
    key = next(name for name in (f"_row_{k}" for k in count()) if name not in {c.lower() for c in docs.columns})
    rows = checkpoint(docs.withColumn(key, F.monotonically_increasing_id()))
    _, placed, spans = mix(rows, row=key, **settings)
    per_pass = spans.groupBy("row", "pass").agg(F.sum("n_words").alias("n"), F.first("size").alias("size"))
    copies = per_pass.where("2 * n >= size").groupBy("row").agg(F.count("*").alias("copies"))
    copies = copies.unionByName(placed.where("size = 0").select("row", F.lit(1).cast("long").alias("copies")))
    of = checkpoint(copies.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row"))
    return rows.alias("d").join(of.alias("c"), F.col(f"d.{key}") == F.col("c.row")).select("d.*").drop(key)
