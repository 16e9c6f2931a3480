"""Near-duplicate groups: exact Jaccard join of word shingles through count vectors and an R-tree over them."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelquery.functions.lineage import checkpoint, settled
from reelquery.llm.common import map_texts, text_bytes
from reelquery.operators.graph import linked_roots

WIDTH = 5
#: Two sets link when DEN * intersection >= NUM * union.
NUM, DEN = 80, 100
#: Groups that shingles are hashed into: the dimensions of a count vector.
GROUPS = 256
#: Cells of the sketch of frequent shingles (log2): a broadcast of that many 32-bit counters, whatever the input.
SKETCH_BITS, SKETCH_PARTS, SUMMED_AT_ONCE = 20, 64, 256
#: Sets that share an indexed shingle: up to so many are paired at once, more go through the R-tree.
PAIRED_AT_ONCE = 16
#: Rounds of the R-tree: at first only the best pairs of each group so far, which mostly joins what belongs together; the
#: last round (None) checks every pair between groups that may link.
ROUNDS = (2, None)
#: Postings of an index partition; occurrences, beyond the usual ones of a cell, from which a shingle's postings are dealt by set.
POSTINGS, HOT = 1_000_000, 100_000
#: Points of an R-tree leaf, points that meet in a task, pairs that one tile of sets checks on average, fewest tiles.
LEAF, POINTS, PARTNERS, TILES = 32, 1_024, 256, 32
#: Bits of the bitmap of documents whose sets are needed again, and its parts; rows up to which a small side is broadcast
#: (24 bytes each).
BITMAP_BITS, BITMAP_PARTS, BROADCAST_ROWS = 24, 128, 300_000
#: Odd 64-bit multipliers of the shingle hash.
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def word_hash():
    """A 64-bit hash of words that all workers share: Python's own where its seed is fixed, as Spark fixes it for workers."""
    if os.environ.get("PYTHONHASHSEED", "random") != "random":
        return hash
    return lambda word: xxhash.xxh3_64_intdigest(word) - 2**63


def shingles(text: bytes | None, hashed) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct WIDTH-word shingles; of its whole sequence if it has fewer words."""
    words = text.lower().split() if text else []  # bytes.lower() lowers A-Z alone
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashed, words), np.int64, len(words)).view(np.uint64)
    width = min(WIDTH, len(h))
    n = len(h) - width + 1
    x = np.full(n, width, np.uint64)
    for k in range(width):
        x = (x ^ (x >> np.uint64(29))) + h[k : k + n]
        x *= MULTIPLIERS[k]
    x ^= x >> np.uint64(32)
    return np.unique(x)


def needed(n, m):
    """The least intersection of linked sets of n and m shingles: DEN i >= NUM (n + m - i)."""
    return -(-NUM * (n + m) // (NUM + DEN))


def indexed(n: int) -> int:
    """How many of a set's first shingles, in any common order, are indexed: linked sets share one of them."""
    return n - -(-NUM * n // DEN) + 1


def key_of(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - 2**63


def packed(counts: np.ndarray) -> bytes:
    """A count vector in the narrowest unsigned integers that hold it."""
    top = counts.max()
    return counts.astype("u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4").tobytes()


def vectors(column) -> np.ndarray:
    kinds = {GROUPS: "u1", 2 * GROUPS: "<u2", 4 * GROUPS: "<u4"}
    return np.stack([np.frombuffer(x, kinds[len(x)]).astype(np.int64) for x in column]) if len(column) else np.empty((0, GROUPS), np.int64)


SETS = "kind int, doc_id long, n long, key long, vec binary"


def sets_of(docs: DataFrame) -> DataFrame:
    """kind 0: doc_id, n, key (of the whole set; null if empty) and its count vector; kind 1: parts of the task's sketch, the
    counts of its shingles by hash cell (key: which part, vec: its packed counts, n: on part 0, the task's postings)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SETS))

    def run(batches):
        hashed, cells, postings = word_hash(), np.zeros(1 << SKETCH_BITS, np.uint32), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows: list[tuple] = []
                for doc_id, text in zip(part.column(0).to_pylist(), text_bytes(part.column(1)), strict=True):
                    found = shingles(text, hashed)
                    if len(found):
                        postings += indexed(len(found))
                        np.add.at(cells, (found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
                        rows.append((0, doc_id, len(found), key_of(found), packed(np.bincount((found & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS))))
                    else:
                        rows.append((0, doc_id, 0, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
        packs = [zlib.compress(x.tobytes(), 1) for x in np.split(cells, SKETCH_PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([1] * SKETCH_PARTS, [None] * SKETCH_PARTS, [postings] + [0] * (SKETCH_PARTS - 1), range(SKETCH_PARTS), packs), schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, SETS)


def sketch_of(made: DataFrame) -> tuple[np.ndarray, int]:
    """The sum of all tasks' sketches, and how many postings the sets have at most. Each part is summed in a tree, so a task
    reads at most SUMMED_AT_ONCE of them."""

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.int64)
        for x in part["vec"]:
            total += np.frombuffer(zlib.decompress(x), np.uint32)
        vec = zlib.compress(np.minimum(total, 2**31 - 1).astype(np.uint32).tobytes(), 1)
        return pd.DataFrame({"at": [part["at"].iloc[0]], "key": [part["key"].iloc[0]], "n": [part["n"].sum()], "vec": [vec]})

    rows, many = made.where("kind = 1").select(F.spark_partition_id().alias("at"), "key", "n", "vec"), made.rdd.getNumPartitions()
    while many > 1:
        rows, many = rows.withColumn("at", F.expr(f"CAST(at div {SUMMED_AT_ONCE} AS INT)")).groupBy("at", "key").applyInPandas(add, "at int, key long, n long, vec binary"), -(-many // SUMMED_AT_ONCE)
    parts = rows.collect()
    sketch = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.int32)
    for part in parts:
        sketch[part["key"]] = np.frombuffer(zlib.decompress(part["vec"]), np.int32)
    return sketch.ravel(), sum(part["n"] for part in parts)


def postings_of(docs: DataFrame, sketch: np.ndarray, parts: int, hot: int) -> DataFrame:
    """part, and packed arrays of (shingle hash, key, n): a row for each index partition and batch of documents.

    A set is indexed by its first shingles in the order (frequency in the sketch, hash), so what many documents share
    comes last. Copies within a batch are indexed once. Shingles of cells with hot or more occurrences are dealt by the
    set instead, over as many parts beyond the others, so none of them fills a task."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def one():
        hashed, frequent = word_hash(), shared.value

        def work(_, texts):
            seen: set[int] = set()
            hashes, keys, sizes, dealt = [], [], [], []
            for text in texts:
                found = shingles(text, hashed)
                n = len(found)
                key = key_of(found)
                if not n or key in seen:
                    continue
                seen.add(key)
                often = frequent[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.argsort(often, kind="stable")[: indexed(n)]
                first = found[order]  # found is in the order of the hashes
                hashes.append(first)
                keys.append(np.full(len(first), key, np.int64))
                sizes.append(np.full(len(first), n, np.uint32))
                dealt.append(np.where(often[order] < hot, (first % np.uint64(parts)).astype(np.int64), parts + key % parts))
            if not hashes:
                return {"part": [], "hashes": [], "keys": [], "sizes": []}
            h, k, s, part = map(np.concatenate, (hashes, keys, sizes, dealt))
            order = np.argsort(part, kind="stable")
            at, starts = np.unique(part[order], return_index=True)
            cut = lambda x: [y.tobytes() for y in np.split(x[order], starts[1:])]
            h = (h >> np.uint64(32)).astype(np.uint32)  # with the part, enough to tell shingles apart; a clash is one more candidate
            return {"part": at.tolist(), "hashes": cut(h), "keys": cut(k), "sizes": cut(s)}

        return work

    return map_texts(docs, one, "part long, hashes binary, keys binary, sizes binary")


def pairs_in_part(parts: int):
    """Of an index partition: pairs (a, b; run null) of sets that share an indexed shingle and may link by size; for runs of
    more than PAIRED_AT_ONCE sets, and for what is dealt by the set, the run's members instead (a, and their size as b)."""

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        at = int(group["part"].iloc[0])
        join = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in group[name]])
        h, k, s = join("hashes", np.uint32).astype(np.int64) << 31 | min(at, parts), join("keys", np.int64), join("sizes", np.uint32).astype(np.int64)
        order = np.lexsort((k, s, h))
        h, k, s = h[order], k[order], s[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
        h, k, s = h[fresh], k[fresh], s[fresh]
        lengths = np.diff(np.append(np.flatnonzero(np.append(True, h[1:] != h[:-1])), len(h)))
        few = np.repeat((lengths <= PAIRED_AT_ONCE) & (at < parts), lengths)
        a, b = [], []
        for step in range(1, PAIRED_AT_ONCE):
            i = np.flatnonzero((h[step:] == h[:-step]) & few[step:] & (DEN * s[:-step] >= NUM * s[step:]))
            a.append(k[i])
            b.append(k[i + step])
        a, b = np.concatenate(a), np.concatenate(b)
        found = pd.DataFrame({"run": pd.array([None] * len(a), "Int64"), "a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates(["a", "b"])
        return pd.concat([found, pd.DataFrame({"run": pd.array(h[~few], "Int64"), "a": k[~few], "b": s[~few]})])

    return pairs


def star_pairs(members: DataFrame) -> DataFrame:
    """Pairs of each member of a run (run, key, n) with the run's smallest set of its size class: within a class, sizes
    differ by no more than linked sets' may. The smallest is an aggregate, so no task holds a run."""
    sized = members.withColumn("size_class", F.floor(F.log("n") / F.log(F.lit(DEN / NUM))))
    least = sized.groupBy("run", "size_class").agg(F.min(F.struct("n", "key")).alias("least"))
    return sized.join(least, ["run", "size_class"]).where("key <> least.key").select(F.least("key", "least.key").alias("a"), F.greatest("key", "least.key").alias("b"))


def bounded(pairs: DataFrame) -> DataFrame:
    """The pairs (with na, nb, va, vb) whose overlap can suffice: it is at most the sum of their coordinate minima."""

    @F.pandas_udf("boolean")
    def may_link(na: pd.Series, nb: pd.Series, va: pd.Series, vb: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(vectors(va), vectors(vb)).sum(1) >= needed(na.to_numpy(), nb.to_numpy()))

    return pairs.where(may_link("na", "nb", "va", "vb"))


class Tree:
    """A packed R-tree of two levels over count vectors: leaves of LEAF neighbouring points with their bounding boxes."""

    def __init__(self, points: pd.DataFrame):
        points = points.sort_values(["label", "n", "key"], ignore_index=True)
        self.keys, self.labels, self.n = (points[x].to_numpy() for x in ("key", "label", "n"))
        vec = vectors(points["vec"])
        self.vec = vec.astype(np.uint16) if vec.max() < 1 << 16 else vec  # narrow integers are compared faster
        cuts = np.arange(0, len(points), LEAF)
        self.leaves = [slice(c, c + LEAF) for c in cuts]
        self.high = np.maximum.reduceat(vec, cuts)
        self.least, self.most = np.minimum.reduceat(self.n, cuts), np.maximum.reduceat(self.n, cuts)
        self.label = [self.labels[x][0] if (self.labels[x] == self.labels[x][0]).all() else None for x in self.leaves]

    def pairs(self, other: Tree) -> pd.DataFrame:
        """Points (a, b) of different labels (la, lb) whose overlap can suffice, and by what factor it may (room); boxes that
        can't reach it are never opened."""
        found = []
        for i, leaf in enumerate(self.leaves):
            reach = np.minimum(self.high[i], other.high).sum(1) >= needed(self.least[i], other.least)
            reach &= (NUM * self.least[i] <= DEN * other.most) & (NUM * other.least <= DEN * self.most[i])
            for j in np.flatnonzero(reach):
                if self.label[i] is not None and self.label[i] == other.label[j]:
                    continue
                n, m = self.n[leaf][:, None], other.n[other.leaves[j]][None, :]
                x, y = np.nonzero((NUM * n <= DEN * m) & (NUM * m <= DEN * n) & (self.labels[leaf][:, None] != other.labels[other.leaves[j]][None, :]))
                x, y = x + leaf.start, y + other.leaves[j].start
                overlap = np.minimum(self.vec[x], other.vec[y]).sum(1, dtype=np.int64)
                good = overlap >= needed(self.n[x], other.n[y])
                x, y, room = x[good], y[good], overlap[good] / needed(self.n[x[good]], other.n[y[good]])
                found.append(pd.DataFrame({"a": self.keys[x], "b": other.keys[y], "la": self.labels[x], "lb": other.labels[y], "room": room}))
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"a": [], "b": [], "la": [], "lb": [], "room": []}).astype("int64")


def tree_pairs(best: int | None):
    """Pairs (a < b) of a block of a run's outsiders against a block of its members. With best, only those that are among
    the best pairs of one of their labels."""

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["outside"]], group[~group["outside"]]
        if left.empty or right.empty:
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        found = Tree(left).pairs(Tree(right))
        if best is not None and len(found):
            found = found.sort_values(["room", "a", "b"], ascending=[False, True, True], ignore_index=True)
            sides = pd.DataFrame({"label": np.concatenate([found["la"], found["lb"]]), "at": np.tile(np.arange(len(found)), 2)}).sort_values("at", kind="stable")
            found = found.loc[np.unique(sides[sides.groupby("label").cumcount() < best]["at"])]
        a, b = found["a"].to_numpy(np.int64), found["b"].to_numpy(np.int64)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    return pairs


def run_candidates(members: DataFrame, points: DataFrame, best: int | None = None) -> DataFrame:
    """Pairs of sets of different labels that share a large run (members: run, key, label) and may link.

    Runs that are one group already are skipped, and of runs with the same members one is taken. What a run's largest group
    does not hold are its outsiders; only they are compared with all members, in blocks of about POINTS / 2 points of each
    side with their count vectors (points: key, n, vec). With best, a task gives only the best pairs of each label."""
    groups = members.groupBy("run", "label").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("key")).alias("mark"))
    facts = groups.groupBy("run").agg(F.sum("size").alias("all"), F.bit_xor("mark").alias("mark"), F.max(F.struct("size", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    open_ = facts.groupBy("all", "mark").agg(F.min(F.struct("run", "top")).alias("own")).select("all", "own.run", "own.top")
    block = lambda n: F.greatest(F.ceil(n / (POINTS // 2)), F.lit(1)).cast("int")
    known = open_.select("run", F.col("top.label").alias("inside"), block(F.col("all")).alias("members"), block(F.col("all") - F.col("top.size")).alias("outsiders"))
    rows = members.join(known, "run").join(points.select("key", "n", "vec"), "key")
    place = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = rows.select("run", place(F.col("members")).alias("two"), every("outsiders").alias("one"), F.lit(False).alias("outside"), "key", "label", "n", "vec")
    left = rows.where("label <> inside").select("run", every("members").alias("two"), place(F.col("outsiders")).alias("one"), F.lit(True).alias("outside"), "key", "label", "n", "vec")
    return right.unionByName(left).groupBy("run", "one", "two").applyInPandas(tree_pairs(best), "a long, b long").distinct()


def sets_in_question(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key and sorted shingle hashes of the sets in wanted (key, id: the smallest doc_id with that set), in one further pass
    over the texts. A bitmap of bounded size says which documents to take apart again; where it errs, that only takes time."""
    spark = docs.sparkSession
    cells, words = 1 << BITMAP_BITS, 1 << (BITMAP_BITS - 5)
    chunk = words // BITMAP_PARTS

    def bits(part: pd.DataFrame) -> pd.DataFrame:
        field = np.zeros(chunk, np.int64)
        at = part["at"].to_numpy()
        np.bitwise_or.at(field, (at >> 5) % chunk, np.int64(1) << (at & 31))
        return pd.DataFrame({"part": [part["part"].iloc[0]], "bits": [field.tobytes()]})

    at = wanted.select(F.pmod(F.xxhash64("id"), F.lit(cells)).alias("at")).distinct().withColumn("part", F.col("at").bitwiseAND(F.lit(~31)) / (32 * chunk))
    bitmap = np.zeros((BITMAP_PARTS, chunk), np.int64)
    for row in at.select("at", F.floor("part").alias("part")).groupBy("part").applyInPandas(bits, "part long, bits binary").collect():
        bitmap[row["part"]] = np.frombuffer(row["bits"], np.int64)
    shared = spark.sparkContext.broadcast(bitmap.ravel())

    def one():
        hashed, field = word_hash(), shared.value

        def work(places, texts):
            out = {"key": [], "hashes": []}
            for at, text in zip(places, texts, strict=True):
                if field[at >> 5] >> (at & 31) & 1:
                    found = shingles(text, hashed)
                    out["key"].append(key_of(found))
                    out["hashes"].append(found.tobytes())
            return out

        return work

    place = F.pmod(F.xxhash64("doc_id"), F.lit(cells))
    return checkpoint(map_texts(docs.where("doc_id IS NOT NULL").select(place, "text"), one, "key long, hashes binary"))


def few(df: DataFrame, rows: int) -> DataFrame:
    """df for a join: broadcast if its number of rows says that it is small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def verified(pairs: DataFrame, rows: int, store: DataFrame) -> DataFrame:
    """Of so many pairs (a, b: keys) those whose sets link. The pairs are dealt over tiles, those of a frequent set over
    several, and a set goes once to every tile that needs it."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("chunks"))
    tile = F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("chunks"))), F.lit(max(TILES, rows // PARTNERS)))
    tiled, _ = settled(pairs.join(many, "a").select("a", "b", tile.alias("tile")))
    wanted, n = settled(tiled.select(F.col("tile").alias("of_tile"), F.explode(F.array("a", "b")).alias("key")).distinct())
    sets = store.join(few(wanted, n), "key").select("of_tile", "key", "hashes")

    def check(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        of = {i: np.frombuffer(h, np.uint64) for i, h in zip(sets["key"], sets["hashes"], strict=True)}
        keep = []
        for a, b in zip(pairs["a"], pairs["b"], strict=True):
            x, y = of[a], of[b]
            both = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(both >= needed(len(x), len(y)))
        return pairs.loc[keep, ["a", "b"]]

    return settled(tiled.groupBy("tile").cogroup(sets.groupBy("of_tile")).applyInPandas(check, "a long, b long"))[0]


def near_duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) for every document.

    Words are lower-cased (A-Z) and parted at ASCII white space. Null texts and texts without words have no shingles and are
    groups of their own, whose component_id is their doc_id. Rows without doc_id link with nothing and have no component_id.
    Repeated rows are one document, and rows that share a doc_id but not their text are linked by their texts alone. A text
    of any length is one set. An empty table gives no rows; extra columns are ignored.

    Equal sets are one point. Linked sets share one of their first shingles in a common order (rare ones first), so an
    index of these finds every candidate; the count vectors bound its overlap before the sets are compared. Where many sets
    share an indexed shingle, only the smallest of a size class is paired with the others at first; the R-tree then finds
    what may link beyond the groups so formed. No pair that may link is left out, and none of a group's pairs is needed twice."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = checkpoint(sets_of(texts))
    sketch, total = sketch_of(made)
    sets = made.where("kind = 0").select("doc_id", "n", "key", "vec")
    points = checkpoint(sets.where("doc_id IS NOT NULL AND key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("id"), F.min("n").alias("n"), F.min("vec").alias("vec")))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // POSTINGS))
    usual = 2 * int(sketch.mean())  # what a cell holds by chance is not hot
    found = checkpoint(postings_of(texts.where("doc_id IS NOT NULL"), sketch, parts, usual + hot).groupBy("part").applyInPandas(pairs_in_part(parts), "run long, a long, b long"))
    members, n_members = settled(found.where("run IS NOT NULL").select("run", F.col("a").alias("key"), F.col("b").alias("n")))
    of = lambda x: points.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("vec").alias(f"v{x}"))
    paired = found.where("run IS NULL").select("a", "b").unionByName(star_pairs(members)).distinct()
    pairs, n_pairs = settled(bounded(paired.join(of("a"), "a").join(of("b"), "b")).select("a", "b"))
    keys, n_keys = settled(members.select("key").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("key"))).distinct())
    wanted, n_keys = settled(points.join(few(keys, n_keys), "key", "left_semi"))
    store = sets_in_question(texts, wanted.select("key", "id"))
    links = verified(pairs, n_pairs, store)
    labels = linked_roots(links)
    for best in ROUNDS if n_members else ():
        named = members.join(labels, members["key"] == labels["id"], "left").select("run", "key", F.coalesce("root", "key").alias("label"))
        more, n_more = settled(run_candidates(named, wanted, best).join(pairs, ["a", "b"], "left_anti"))
        if n_more:
            links = settled(links.unionByName(verified(more, n_more, store)))[0]
            labels = linked_roots(links)
            pairs = settled(pairs.unionByName(more))[0]
    linked = wanted.select("key", "id").join(labels.withColumnRenamed("id", "key"), "key")
    least = linked.groupBy("root").agg(F.min("id").alias("least"))
    of_key, n_linked = settled(linked.join(least, "root").select("key", "least"))
    named = points.select("key", "id").join(few(of_key, n_linked), "key", "left").select("key", F.coalesce("least", "id").alias("component"))
    rows = sets.where("doc_id IS NOT NULL AND key IS NOT NULL").join(named, "key").select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return rows.unionByName(sets.where("doc_id IS NULL OR key IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_text_each(docs: DataFrame) -> DataFrame:
    """docs with one row for each doc_id: of rows that share one, that with the smallest text (nulls first), then by its
    other columns as JSON. Rows without doc_id stay. Where no doc_id is repeated, only ids are shuffled."""
    repeated = checkpoint(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return docs
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(F.col("text"), F.to_json(row))
    again = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, order).alias("_row")).select("_row.*")
    return docs.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(again)


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id. Rows that share a doc_id are one document,
    that with the smallest text. Rows without doc_id, and each null or empty text, stay. An empty table gives no rows; extra
    columns are kept."""
    docs = one_text_each(docs)
    gone = near_duplicates(docs).where("doc_id <> component_id").select("doc_id")
    return docs.join(gone.distinct(), "doc_id", "left_anti").select(*docs.columns)
