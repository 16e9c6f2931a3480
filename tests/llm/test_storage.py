"""Mixing, packing, archives and shards."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from reelquery.llm import mixing, packing, sharding, warc

DOCS = "doc_id long, text string, source string"


def water_fill(sizes, weights, total):
    """Targets by bisection on the common level."""
    low, high = 0.0, 1e12
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * s, level * w) for s, w in zip(sizes, weights, strict=True)) < total else (low, level)
    return [min(2 * s, high * w) for s, w in zip(sizes, weights, strict=True)]


def sample(spark, seed=0):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.randint(0, 900), rng.choice(["a", "b", "b", "b", "c", "é", None])) for i in range(300)]
    return spark.createDataFrame(rows + [(7_000, None, "a"), (7_001, "only one", "z")], DOCS), rows


def test_mix_reaches_its_targets(spark):
    df, _ = sample(spark)
    found = mixing.taken_words(df.withColumn("sid", F.lit(1)).withColumn("size", F.lit(9))).toPandas().merge(df.select("doc_id", "source").toPandas(), on="doc_id")
    found["source"] = found["source"].fillna("\U0010ffff")
    per = found.groupby("source").agg(size=("size", "sum"), taken=("taken", "sum"), target=("target", "first"), said=("source_size", "first")).sort_index()
    assert (per["size"] == per["said"]).all()
    want = water_fill(per["size"].tolist(), [(5, 2, 1)[i % 3] for i in range(len(per))], 1.5 * per["size"].sum())
    assert per["target"].tolist() == pytest.approx(want)
    assert (abs(per["taken"] - per["target"]) <= 1).all() and (found["taken"] <= 2 * found["size"]).all()
    again = mixing.taken_words(df.repartition(9)).toPandas().sort_values("doc_id")["taken"].tolist()
    assert again == found.sort_values("doc_id")["taken"].tolist()


def test_every_stretch_of_the_mix_has_the_shares(spark):
    rows = [(i, "w " * 512, "a" if i < 400 else "b") for i in range(800)]
    _, _, spans = mixing.mix(spark.createDataFrame(rows, DOCS), weights=(3, 1), share=0.5)
    by = spans.groupBy("slot").agg(F.first("sid").alias("sid")).orderBy("slot").toPandas()["sid"].to_numpy()
    share = (by == 1).mean()
    for low in range(0, len(by) - 100, 37):
        assert abs((by[low : low + 100] == 1).mean() - share) < 0.05


def test_mix_edge_tables(spark):
    df, _ = sample(spark)
    assert mixing.taken_words(df.limit(0)).count() == 0
    assert mixing.taken_words(spark.createDataFrame([(1, None, None), (1, None, None)], DOCS)).select("taken").distinct().collect()[0][0] == 0
    extra = ["copies", "of", "_row_of_mix", "_row_0", "_ROW_1", "row", "key"]
    kept = mixing.keep_mixed(df.withColumns({name: F.lit(1) for name in extra}))
    assert kept.columns == [*df.columns, *extra]
    counts = Counter(r[0] for r in kept.select("doc_id").collect())
    assert max(counts.values()) <= 2 and counts[7_000] == 1


def test_mix_keeps_rows_without_and_with_repeated_ids(spark):
    df, rows = sample(spark)
    blank = df.withColumn("n", F.col("doc_id")).withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    counts = Counter(r[0] for r in mixing.keep_mixed(blank).select("n").collect())
    words = {i: len((t or "").split()) for i, t, _ in [*rows, (7_000, None, "a"), (7_001, "only one", "z")]}
    assert all(counts[i] == 1 for i, n in words.items() if n == 0) and max(counts.values()) <= 2
    taken = lambda odd: sum(words[i] * k for i, k in counts.items() if i % 2 == odd)
    # half of the words have no id, and the mix takes 1.5 times all words, here as far as two passes reach
    assert taken(1) > 0.5 * sum(n for i, n in words.items() if i % 2) and 1.3 < (taken(0) + taken(1)) / sum(words.values()) < 1.7
    all_null = df.withColumn("n", F.col("doc_id")).withColumn("doc_id", F.lit(None).cast("long"))
    assert {r[0] for r in mixing.keep_mixed(all_null, share=2.0).select("n").collect()} == set(words)
    # an id on two rows, each taken twice
    twice = spark.createDataFrame([(1, "w " * 700, "a"), (1, "v " * 700, "a")], DOCS)
    assert Counter(r[0][0] for r in mixing.keep_mixed(twice, share=2.0).select("text").collect()) == {"w": 2, "v": 2}


def test_kept_words_meet_the_targets_but_for_half_a_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    size = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda x: x != "")).alias("size")
    largest = {r["source"]: r["n"] for r in docs.select("source", size).groupBy("source").agg(F.max("size").alias("n")).collect()}
    kept = {r["source"]: r["n"] for r in mixing.keep_mixed(docs).select("source", size).groupBy("source").agg(F.sum("size").alias("n")).collect()}
    targets = mixing.taken_words(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.first("target").alias("target")).collect()
    for r in targets:
        assert abs(kept.get(r["source"], 0) - r["target"]) <= largest[r["source"]] / 2 + 1


def test_packed_counts_are_whole_and_tight():
    rng = random.Random(2)
    stock = Counter(rng.choice([rng.randint(1, 2048), rng.randint(1, 300)]) for _ in range(5_000))
    bins = packing.pack_counts(dict(stock))
    used = Counter()
    for sizes, times in bins:
        assert sum(sizes) <= 2048
        for size in sizes:
            used[size] += times
    assert used == stock
    least = -(-sum(k * v for k, v in stock.items()) // 2048)
    assert sum(times for _, times in bins) <= least * 1.01 + 1


def naive_best_two(stock, length):
    """Best-two-fit piece by piece over plain lists: [sizes of a bin], bin after bin."""
    left, bins = sorted(stock, reverse=True), []
    while left:
        own = []
        while True:
            gap = length - sum(own)
            fit = next((x for x in left if x <= gap), None)
            if fit is not None:
                own.append(fit)
                left.remove(fit)
                continue
            room = gap + min(own)
            pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if min(own) < a + b <= room] if gap else []
            if not pairs:
                break
            _, a, b = max(pairs, key=lambda p: (p[0], -min(p[1:])))
            left.remove(a)
            left.remove(b)
            left.append(min(own))
            left.sort(reverse=True)
            own.remove(min(own))
            own += [a, b]
        bins.append(sorted(own, reverse=True))
    return bins


@pytest.mark.parametrize("seed", range(12))
def test_packing_against_a_naive_packer(seed):
    rng = random.Random(seed)
    length = rng.choice([20, 50])
    stock = [rng.randint(1, length if seed % 2 else length // 2) for _ in range(rng.randint(1, 60))]
    got = [sizes for sizes, times in packing.pack_counts(dict(Counter(stock)), length) for _ in range(times)]
    want = naive_best_two(stock, length)
    assert sorted(x for b in got for x in b) == sorted(stock) and all(sum(b) <= length for b in got)
    assert got == want


def test_ids_of_odd_words():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, cache = Tokenizer.from_file(path), packing.word_ids(path)
    words = ["(été)", "don't,", "'tis", "x's", "a'b", "--", "a.b", "naïve%%%", "ÉCOLE,", "É", "É", "x1,", "…x", "x…,", "“q”", "ß.", "ſ", "µ,", "ª", "İstanbul", "ﬁ,", "<|endoftext|>", "<|ENDOFTEXT|>,", "(<|startoftext|>", "x<|endoftext|>y", "w" * 300, "中文,", "a\u00a0b", "a\u0301", "(a\u0301)", "q,'s"]
    for word in words:
        assert np.frombuffer(cache[word.encode()], "<u4").tolist() == whole.encode(word, add_special_tokens=False).ids, word


def library_ids(words):
    import public_tokenizers
    from tokenizers import Tokenizer

    return [x.ids for x in Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode_batch([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]


def test_plain_words_take_ranks_and_others_the_library():
    ids = packing.WordIds(packing.tokenizer_path(packing.TOKENIZER))
    letters, marks = packing.plain_characters()
    assert {x.lower() for x in letters} <= set(letters) and not set(letters) & set(marks)
    rng = random.Random(5)
    alphabet = [*"aabcdeeghilmnorst0129ABÉ", *letters, *marks, "'s", "'LL", "n't", "tion", "The"]
    plain = [x + y for x in "a1'Я" for y in letters + marks] + ["".join(rng.choices(alphabet, k=rng.randint(1, 14))) for _ in range(30_000)]
    plain = [w.encode() for w in plain if not any(token in w for token in ids.added)]
    library, ids.library = ids.library, None  # so none of these needs it
    assert ids.encode(pa.array(plain, pa.binary())).to_pylist() == library_ids(plain)

    ids.library = library
    odd = [f"x{chr(k)}y".encode() for k in range(0x21, 0x3100) if chr(k) not in "\u0085\u00a0"] + [b"\xff\xfe", b"ab\xe2", b"\x00", b"a\x00", b"", b"w" * 999, b"<|endoftext|>", b"the"]
    assert ids.encode(pa.array(odd, pa.binary())).to_pylist() == library_ids(odd)
    few = odd[::97] + odd[-8:]
    ids.ranks = None  # as for a vocabulary of another kind
    assert ids.encode(pa.array(few, pa.binary())).to_pylist() == library_ids(few)


def test_every_piece_encodes_as_itself():
    """What ranks rest on: with one merge a piece, each after those of its parts, and no piece that merges otherwise."""
    import json

    from tokenizers import Tokenizer, models

    path = packing.tokenizer_path(packing.TOKENIZER)
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocab, merges = model["vocab"], [tuple(x) for x in model["merges"]]
    assert [vocab[a + b] for a, b in merges] == list(range(512, 512 + len(merges))) and len(vocab) == 512 + len(merges)
    assert all(max(vocab[a], vocab[b]) < vocab[a + b] for a, b in merges)
    for suffix in ({"end_of_word_suffix": "</w>"}, {}):
        bare = Tokenizer(models.BPE(vocab, merges, **suffix))
        pieces = [x for x in vocab if x.endswith("</w>") == bool(suffix)]
        assert [x.ids for x in bare.encode_batch([x.removesuffix("</w>") for x in pieces])] == [[vocab[x]] for x in pieces]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_ids_of_texts_by_white_space(kind):
    ids = packing.word_ids(packing.tokenizer_path(packing.TOKENIZER))
    texts = [None, "", " ", *[f"ab{chr(k)}cd" for k in range(128)], " \t a\u00a0b  \x0b\x0c\r\n", "c\u2028d e\u0085f", "same same\nsame"]
    flat, edges = ids.of_texts(pa.array(texts, kind))
    assert [flat[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == library_ids([(x or "").encode() for x in texts])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, kind)], names=["doc_id", "text"])
    for limit in (1, 40, 10**6):
        parts = list(packing.parts_by_bytes(batch, limit))
        assert sum((p.column(0).to_pylist() for p in parts), []) == list(range(len(texts)))
        assert all(sum(len((x or "").encode()) for x in p.column(1).to_pylist()[:-1]) <= limit for p in parts)
    assert [p.num_rows for p in packing.parts_by_bytes(batch.slice(0, 0), 9)] in ([], [0])


def test_two_replace_the_smallest():
    counts = np.zeros(11, np.int64)
    counts[[3, 4]] = 1
    assert packing.best_two(counts, 7, 5) == (3, 4) and packing.best_two(counts, 6, 5) is None and packing.best_two(counts, 7, 7) is None


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [None, "", " \n", "Hello, world! It's 12,5 don't.", "ÉCOLE  naïve x ǆ İ", "<|endoftext|> a", "word " * 5_000, "a " * 2_047, "a " * 2_046] + ["the same words here"] * 700
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("length", F.lit(1))
    rows = packing.pack(df).collect()
    by, seats = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        seats[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by[i], key=lambda r: r["piece"])
        assert [r["start"] for r in pieces] == list(range(0, len(ids), 2048)) and sum(r["length"] for r in pieces) == len(ids)
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for own in seats.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(seats) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    assert packing.pack(df.limit(0)).count() == 0


def test_real_documents_pack_tightly(spark):
    found = packing.pack(spark.read.parquet(f"{SF}/documents.parquet")).agg(F.countDistinct("sequence_id").alias("n"), F.sum("length").alias("tokens")).first()
    assert found["n"] <= found["tokens"] / 2048 * 1.01 + 1


FAKE = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nrest"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives_round_trip(spark):
    htmls = [None, "", "<p>é</p>", FAKE, "WARC/1.1\r\n" * 50, "<p>é</p>", "", "y" * 300_000, FAKE]
    df = pages(spark, [(i, "http://x/a b\r\nWARC-Type: revisit" if i == 2 else None, h) for i, h in enumerate(htmls)])
    rows = {r["page_id"]: r for r in warc.archive_round_trip(df.withColumn("digest", F.lit(1)).withColumn("first", F.lit(1)).repartition(3)).collect()}
    assert len(rows) == len(htmls)
    for i, html in enumerate(htmls):
        payload = (html or "").encode()
        first = min(j for j, h in enumerate(htmls) if (h or "") == (html or ""))
        r = rows[i]
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == i else ("revisit", first))
    assert warc.archive_round_trip(df.limit(0)).count() == 0
    before = {(r["page_id"], r["record_type"], r["refers_to"]) for r in rows.values()}
    warc.BROADCAST_REVISITS, kept = -1, warc.BROADCAST_REVISITS
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(df).collect()} == before
    warc.BROADCAST_REVISITS = kept
    assert warc.archive_round_trip(pages(spark, [(1, "u", "a"), (1, "u", "a"), (None, None, "a")])).count() == 3


def test_chain_stops_at_a_broken_record(spark, tmp_path):
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n"
    good = b"".join(head % (i, 3, b"abc") for i in range(5))
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(good + b"junk" + head % (9, 3, b"abc")))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b" " + good))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(good[:-10]))
    (tmp_path / "d.warc.gz").write_bytes(gzip.compress(b""))
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    found = Counter(r["archive"].rsplit("/")[-1] for r in rows)
    assert found == {"a.warc.gz": 5, "c.warc.gz": 4}


def test_archives_of_many_members_and_plain_ones(spark, tmp_path):
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n"
    own = [head % (i, 3, b"abc") for i in range(5)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, own)) + bytes(100))
    (tmp_path / "b.warc").write_bytes(b"".join(own))
    (tmp_path / "c.txt").write_bytes(b"".join(own))
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r["archive"].rsplit("/")[-1], r["page_id"]) for r in rows) == [(x, i) for x in ("a.warc.gz", "b.warc") for i in range(5)]
    for bad in (gzip.compress(own[0]) + b"junk", gzip.compress(own[0]) + gzip.compress(own[1])[:-9]):
        with pytest.raises((EOFError, gzip.BadGzipFile)):
            warc.inflated(bad)


def brute_shards(rows, limit):
    marks = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) for i, _ in rows}

    def split(own, depth):
        if sum(b for _, b in own) <= limit or len({marks[i] for i, _ in own}) == 1:
            return {i: format(marks[i] >> (60 - depth), f"0{depth}b") if depth else "" for i, _ in own}
        bit = lambda i: marks[i] >> (59 - depth) & 1
        return split([x for x in own if not bit(x[0])], depth + 1) | split([x for x in own if bit(x[0])], depth + 1) if own else {}

    return split(rows, 0)


@pytest.mark.parametrize("limit", [10, 300, 5_000, 10**9])
def test_shards_against_recursion(spark, limit):
    rng = random.Random(limit)
    rows = [(i, rng.choice([0, 5, 50, 400])) for i in range(200)]
    df = spark.createDataFrame([(i, "x" * b) for i, b in rows], "doc_id long, text string").withColumn("depth", F.lit(1)).withColumn("h", F.lit(1))
    found = sharding.shards_of(df, limit, step=3).collect()
    assert {r["doc_id"]: r["shard"] for r in found} == brute_shards(rows, limit)
    sizes = Counter()
    for r in found:
        sizes[r["shard"]] += r["bytes"]
    assert all(sizes[r["shard"]] == r["shard_bytes"] for r in found)


def test_shards_of_rows_that_cannot_be_parted(spark):
    df = spark.createDataFrame([(1, "x" * 100)] * 5 + [(2, None), (None, "é"), (None, "")], "doc_id long, text string")
    rows = sharding.shards_of(df, 10).collect()
    assert len(rows) == 8 and {r["shard_bytes"] for r in rows if r["doc_id"] == 1} == {500}
    assert sharding.shards_of(df.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, f"{i:03d}" * 10) for i in range(100)], df.schema)
    assert max(r["shard_bytes"] for r in sharding.shards_of(nameless, 300).collect()) <= 300
