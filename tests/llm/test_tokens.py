"""Encoding, decoding, alignment of two tokenizers, and periodic runs."""

import hashlib
import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from reelquery.llm import alignment, encoding, queries, runs

WORD_BPE = "word_bpe_49k.json"
ODD = [None, "", " \n\t", "Hello, world! It's 12,5 don't.", "ÉCOLE  naïve x ǆ İ ß", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "a b    x\x1cy\x85z", "á e ́x", "中文 🙂🙂 � ▁x", "w" * 3_000, "word Word WORD, " * 4_000, "\x00 \x0b\x0c\r\n", "ΣΑΣ σας"]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def documents(spark, texts, **extra):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return df.withColumns({name: F.lit(1) for name in extra or ("chunk", "ids", "part", "mark", "runs", "words", "collapsed")})


@lru_cache
def library(name=WORD_BPE):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize("chunk_bytes", [16_000_000, 200])
def test_encoding_and_decoding_as_the_library(spark, chunk_bytes):
    tokenizer = library()
    found = {r["doc_id"]: r for r in encoding.decode(encoding.encode(documents(spark, ODD), chunk_bytes=chunk_bytes)).collect()}
    assert len(found) == len(ODD)
    for i, text in enumerate(ODD):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert found[i]["ids"] == ids, text
        assert found[i]["text"] == tokenizer.decode(ids, skip_special_tokens=False), text


def test_encoding_of_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "a"), (None, None)], "doc_id long, text string")
    rows = sorted((r["doc_id"] or 0, r["text"]) for r in encoding.decode(encoding.encode(df)).collect())
    assert rows == [(0, ""), (0, "a</w>"), (1, "a</w> b</w>"), (1, "a</w> b</w>"), (1, "c</w>")]
    assert encoding.encode(df.limit(0)).count() == 0 and encoding.decode(encoding.encode(df.limit(0))).count() == 0


def test_decoding_of_ids_without_pieces(spark):
    df = spark.createDataFrame([(1, [320, 99_999, 321]), (2, None), (3, []), (4, [-1])], "doc_id long, ids array<int>")
    tokenizer = library()
    assert {r["doc_id"]: r["text"] for r in encoding.decode(df).collect()} == {1: tokenizer.decode([320, 321]), 2: "", 3: "", 4: ""}


def test_words_that_do_not_match_the_texts_fail():
    texts = pa.Table.from_batches([encoding.rows_of(encoding.TEXTS, [(0, 7, 2, [1], [2], encoding.squeeze(np.array([0, 1])))])])
    ids = [(0, 8, encoding.squeeze(np.array([0, 1])), encoding.squeeze(np.array([1, 1])), encoding.squeeze(np.array([5, 6])))]
    with pytest.raises(RuntimeError, match="another order"):
        encoding.join_by_position(texts, pa.Table.from_batches([encoding.rows_of(encoding.IDS, ids)]))


def test_each_distinct_word_is_encoded_once(spark):
    plan = encoding.encode(documents(spark, ODD))._jdf.queryExecution().toString()
    assert plan.count("MapInArrow") >= 3 and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_op11_on_documents(spark):
    tokenizer = library()
    found = {r["doc_id"]: r for r in queries.op11_distinct_word_table(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    for doc_id, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        r = found[doc_id]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))


def brute_runs(words, least=12):
    """Every stretch of equal words at distance q, for each q, that no smaller distance explains."""
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        k = 0
        while k + q < n:
            start = k
            while k + q < n and words[k] == words[k + q]:
                k += 1
            length = k - start + q
            own = words[start : start + length]
            if length >= max(least, 2 * q) and not any(all(own[i] == own[i + p] for i in range(length - p)) for p in range(1, q)):
                out.append((start, length, q))
            k += k == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    rng = random.Random(3)
    for _ in range(1_500):
        letters = rng.choice(["a", "ab", "abc", "abcde"])
        words = [rng.choice(letters) for _ in range(rng.randint(0, 50))]
        if rng.random() < 0.5:
            words[5:5] = [rng.choice(letters) for _ in range(rng.randint(1, 12))] * rng.randint(2, 8)
        least = rng.choice([1, 2, 6, 12])
        assert runs.runs_of(words, least) == brute_runs(words, least), (words, least)


def test_runs_of_famous_words():
    a, b = "a", "ab"
    while len(b) < 700:
        a, b = b, b + a
    thue = [k.bit_count() & 1 for k in range(5_000)]  # equal hashes of different stretches, as these are modulo 2^64
    assert runs.runs_of(list(b)) == brute_runs(list(b))
    assert runs.runs_of(thue[:1_500]) == brute_runs(thue[:1_500])
    folded = thue[:4_096] + [2] + thue[:4_096] + [3] + [1 - x for x in thue[:4_096]]
    for i, j in ((0, 4_097), (0, 8_194), (4_097, 8_194), (1_024, 5_121 + 1_024)):
        x = runs.Extension(np.array(folded))
        want = next((k for k in range(len(folded) - j) if folded[i + k] != folded[j + k]), len(folded) - j)
        assert x.right(i, j) == want and x.right(i, j) == want


def test_long_runs_are_linear():
    assert runs.runs_of(["a"] * 200_000) == [(0, 200_000, 1)]
    block = [str(k) for k in range(3_000)]
    assert runs.runs_of(["x"] + block * 50) == [(1, 150_000, 3_000)]


def test_runs_and_collapsed_texts(spark):
    texts = [None, "", "a b c", "x " * 12, "say it " * 6 + "again", " pre\n" + "one two three\t" * 5 + "one end", "x " * 11]
    rows = {r["doc_id"]: r for r in runs.periodic_runs(documents(spark, texts)).collect()}
    assert [rows[i]["collapsed"] for i in range(len(texts))] == ["", "", "a b c", "x", "say it again", "pre one two three end", " ".join("x" * 11)]
    assert [tuple(x) for x in rows[5]["runs"]] == [(1, 16, 3)] and rows[4]["n_words"] == 13 and rows[6]["runs"] == []
    assert runs.periodic_runs(documents(spark, texts).limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "y " * 20), (1, "y " * 20), (None, "y")], "doc_id long, text string")
    assert sorted((len(r["runs"]), r["collapsed"]) for r in runs.periodic_runs(twice).collect()) == [(0, "y"), (1, "y"), (1, "y")]


def test_op13_on_documents(spark):
    found = {r["doc_id"]: r for r in queries.op13_lyndon_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    repeated = 0
    for doc_id, text in docs:
        words, h = (text or "").encode().split(), zlib.crc32(str(doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            repeated += 1
        elif n > 400:
            continue  # brute force is quadratic
        own = brute_runs(words) if n <= 1_500 else runs.runs_of(words)
        best = min(own, key=lambda r: (-r[1], r[0], r[2]), default=None)
        dropped = {i for start, length, q in own for i in range(start + q, start + length)}
        want = (len(own), *((*best, 1_000 * best[1] // best[2]) if best else (None,) * 4), sha("".join("%d,%d,%d\n" % r for r in own)), sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)))
        r = found[doc_id]
        assert tuple(r[c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) == want
    assert repeated > 50


def naive_alignment(text):
    """(ids of A, ids of B, groups) token by token, with the libraries themselves."""
    first, second = library("byte_bpe_50k.json"), sentence_pieces()
    first.encode_special_tokens = True
    if not text:
        return [], [], []
    letter = {c: k for k, c in enumerate(alignment.byte_letters())}
    a_ids, b_ids = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
    a_bytes = [bytes(letter[c] for c in first.id_to_token(k)) for k in a_ids]
    b_bytes = [bytes([int(second.id_to_piece(k)[3:5], 16)]) if second.is_byte(k) else second.id_to_piece(k).replace("▁", " ").encode() for k in b_ids]
    if {b"".join(a_bytes), b"".join(b_bytes)} != {b" " + text.encode()}:
        return [], [], []
    groups, i, j, x, y, own = [], 0, 0, 0, 0, ([], [])
    while i < len(a_ids) or j < len(b_ids):
        if x <= y:
            x, i = x + len(a_bytes[i]), i + 1
            own[0].append(a_ids[i - 1])
        else:
            y, j = y + len(b_bytes[j]), j + 1
            own[1].append(b_ids[j - 1])
        if x == y:
            groups.append(own)
            own = ([], [])
    return a_ids, b_ids, groups


@lru_cache
def sentence_pieces():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def expected_alignment(texts):
    """The rows of op12 for texts by number."""
    own = [naive_alignment(text) for text in texts]
    links = [[(a[-1], b[-1]) for a, b in groups] for _, _, groups in own]
    counts = Counter(pair for x in links for pair in x)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    for (a_ids, b_ids, groups), pairs in zip(own, links, strict=True):
        line = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        yield len(a_ids), len(b_ids), len(groups), len(pairs), sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs), sha(line) if groups else ""


ALIGNED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
STRANGE = [*ODD, "a" + " " * 400 + "b", "\n\n\n  x\n \n", "x<s></s><unk><0x41>", "xy" * 12_000, "don't 12,345 naïve▁", " leading", "trailing  "]


def scored(spark, df, **options):
    aligned = alignment.group_digests(df, **options)
    texts = aligned.where("slot IS NULL").select("chunk", "doc_id", *[c for c in ALIGNED if c not in ("n_best", "count_sum")], "links")
    return alignment.link_scores(texts, aligned.where("slot IS NOT NULL").select("chunk", "slot", "a", "b", "n"))


@pytest.mark.parametrize("chunk_bytes", [16_000_000, 10])
def test_alignment_against_token_by_token(spark, chunk_bytes):
    df = documents(spark, STRANGE, chunk=1, links=1, slot=1, a=1, b=1, n=1)
    found = {r["doc_id"]: tuple(r[c] for c in ALIGNED) for r in scored(spark, df, chunk_bytes=chunk_bytes).collect()}
    assert [found[i] for i in range(len(STRANGE))] == list(expected_alignment(STRANGE))


def test_alignment_of_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "same words"), (1, "same words"), (None, "other"), (2, None)], "doc_id long, text string")
    rows = sorted(((r["doc_id"] or 0), r["n_links"], r["count_sum"]) for r in scored(spark, df).collect())
    want = {x[3]: x[5] for x in expected_alignment(["same words", "same words", "other", None])}
    assert rows == sorted([(0, rows[0][1], want[rows[0][1]]), (1, rows[1][1], want[rows[1][1]]), (1, rows[1][1], want[rows[1][1]]), (2, 0, 0)])
    assert scored(spark, df.limit(0)).count() == 0


def test_owners_give_overlaps_and_cuts():
    rng = random.Random(4)
    for _ in range(300):
        total = rng.randint(0, 30)
        a, b = (np.diff(sorted({0, total, *rng.sample(range(total + 1), rng.randint(0, total // 2))})).astype(np.int64) for _ in range(2))
        spans = [[(int(e - s), int(e)) for s, e in zip(x, np.cumsum(x), strict=True)] for x in (a, b)]
        shared = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if max(s, t) < min(e, f)]
        assert [tuple(x) for x in alignment.overlaps(a, b).tolist()] == shared
        ends = [(i, j) for i, j in shared if spans[0][i][1] == spans[1][j][1]]
        assert [tuple(x) for x in np.stack(alignment.cuts(a, b), axis=1).tolist()] == ends


def test_aligned_groups_hold_all_tokens(spark):
    rows = alignment.align(documents(spark, STRANGE)).where("slot IS NULL").orderBy("doc_id").collect()
    for text, r in zip(STRANGE, rows, strict=True):
        a_ids, b_ids, groups = naive_alignment(text)
        assert (r["a_ids"], r["b_ids"]) == (a_ids, b_ids)
        assert [(a, b) for a, b in zip(r["a_sizes"], r["b_sizes"], strict=True)] == [(len(a), len(b)) for a, b in groups]


def test_op12_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = {r["doc_id"]: tuple(r[c] for c in ALIGNED) for r in queries.op12_byte_owner_arrays(spark, SF).collect()}
    assert found == {r["doc_id"]: want for r, want in zip(docs, expected_alignment([r["text"] for r in docs]), strict=True)}
