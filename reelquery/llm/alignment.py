"""Alignment of two tokenizers over the bytes of a text: which tokens overlap, where both end, and which ids end together."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.window import Window as W

from reelquery.llm.common import byte_letters, text_bytes
from reelquery.llm.packing import tokenizer_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text, and pairs of ids, after which a task begins a new chunk. What a chunk's texts and pairs need is held by one task.
CHUNK_BYTES, CHUNK_PAIRS = 16_000_000, 300_000
#: Bytes of text that are aligned at once; a longer text is aligned alone.
BATCH_BYTES = 1_000_000
INTS = pa.list_(pa.int32())
PAIRS = {"slot": pa.int32(), "a": pa.int32(), "b": pa.int32(), "n": pa.int64()}
ALIGNED = pa.schema({"chunk": pa.int64(), "doc_id": pa.int64(), "a_ids": INTS, "b_ids": INTS, "a_sizes": INTS, "b_sizes": INTS, "links": INTS} | PAIRS)
COUNTS = {name: pa.int64() for name in ("n_a", "n_b", "n_groups", "n_links")}
DIGESTS = pa.schema({"chunk": pa.int64(), "doc_id": pa.int64()} | COUNTS | {"groups_sha256": pa.string(), "links": INTS} | PAIRS)


class ByteLevel:
    """The byte-level vocabulary: ids of texts, and the bytes of ids. Strings of special tokens are plain text.

    Texts go through the ranks of the same vocabulary, which is some four times faster than its own library; words and white
    space so long that this would not end go through the library."""

    LONG = re.compile(r"\s{300}|\S{20000}")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        byte = {piece: k for k, piece in enumerate(byte_letters())}
        ranks = {bytes(byte[c] for c in piece): number for piece, number in vocabulary.items() if all(c in byte for c in piece)}
        special = {token.content: number for number, token in self.library.get_added_tokens_decoder().items()}
        ranks = {piece: number for piece, number in ranks.items() if number not in special.values()}
        self.ranks = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, number in ranks.items():
            self.bytes[number] = piece

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.library.encode(" " + x, add_special_tokens=False).ids if self.LONG.search(x) else self.ranks.encode_ordinary(" " + x) for x in texts]


class Pieces:
    """The sentence-piece vocabulary: ids of texts, which it begins with a space, and the bytes of ids."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        named = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(x[3:5], 16)]) if self.model.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(named)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


@lru_cache(maxsize=1)  # a Python worker keeps them from task to task
def vocabularies(a: str, b: str) -> tuple[ByteLevel, Pieces, np.ndarray, np.ndarray]:
    first, second = ByteLevel(tokenizer_path(a)), Pieces(tokenizer_path(b))
    return first, second, *(np.array([len(x) for x in v.bytes], np.int64) for v in (first, second))


def owners(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every byte the token that owns it, and whether it is the token's last."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.append(owner[1:] != owner[:-1], np.ones(min(1, len(owner)), bool))


def overlaps(a_sizes: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """The distinct pairs (token of A, token of B) that share bytes, in order, for tokens with these numbers of bytes."""
    (a, a_ends), (b, b_ends) = owners(a_sizes), owners(b_sizes)
    at = np.flatnonzero(a_ends | b_ends)
    return np.stack([a[at], b[at]], axis=1)


def cuts(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of A, and those of B, that end together: the owners of the bytes after which both owners change."""
    (a, a_ends), (b, b_ends) = owners(a_sizes), owners(b_sizes)
    at = np.flatnonzero(a_ends & b_ends)
    return a[at], b[at]


def flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids one after another, and where each text's ids end."""
    return np.array([x for own in ids for x in own], np.int32), np.cumsum(list(map(len, ids)), dtype=np.int64)


def cut_lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(values.astype(np.int32)))


def text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes | None]]]:
    """ids and texts, about BATCH_BYTES at a time."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            for doc_id, text in zip(part.column(0).to_pylist(), text_bytes(part.column(1)), strict=True):
                ids.append(doc_id)
                texts.append(text)
                size += len(text or b"")
                if size >= BATCH_BYTES or len(ids) == 2_048:
                    yield ids, texts
                    ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def rows_of(schema: pa.Schema, columns: dict, rows: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def aligned_rows(a: str, b: str, limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text, and at the end of a chunk a row per pair of ids that end together in it."""
    first, second, a_bytes, b_bytes = vocabularies(a, b)
    chunk, size, seen, counted = TaskContext.get().partitionId() << 32, 0, defaultdict(count().__next__), []

    def pair_rows() -> pa.RecordBatch:
        keys = np.fromiter(seen, np.int64, len(seen))
        n = np.zeros(len(seen), np.int64)
        for slots, own in counted:
            n[slots] += own
        return rows_of(ALIGNED, {"chunk": np.full(len(seen), chunk), "slot": np.arange(len(seen), dtype=np.int32), "a": (keys >> 32).astype(np.int32), "b": (keys & 0xFFFFFFFF).astype(np.int32), "n": n}, len(seen))

    for doc_ids, texts in text_batches(batches):
        own = [(text or b"").decode("utf-8", "replace") for text in texts]
        a_ids, b_ids = first.encode(own), second.encode(own)
        for k, text in enumerate(texts):
            whole = b" " + text if text else None
            if whole is None or b"".join(map(first.bytes.__getitem__, a_ids[k])) != whole or b"".join(map(second.bytes.__getitem__, b_ids[k])) != whole:
                a_ids[k], b_ids[k] = [], []
        (a_flat, a_ends), (b_flat, b_ends) = flat(a_ids), flat(b_ids)
        a_last, b_last = cuts(a_bytes[a_flat], b_bytes[b_flat])
        keys, slots, n = np.unique(a_flat[a_last].astype(np.int64) << 32 | b_flat[b_last], return_inverse=True, return_counts=True)
        numbers = np.fromiter(map(seen.__getitem__, keys.tolist()), np.int64, len(keys))
        counted.append((numbers, n))
        groups = np.searchsorted(a_last, a_ends)  # a text's groups end with its tokens
        yield rows_of(
            ALIGNED,
            {
                "chunk": np.full(len(texts), chunk),
                "doc_id": doc_ids,
                "a_ids": cut_lists(a_flat, a_ends),
                "b_ids": cut_lists(b_flat, b_ends),
                "a_sizes": cut_lists(np.diff(a_last, prepend=-1), groups),
                "b_sizes": cut_lists(np.diff(b_last, prepend=-1), groups),
                "links": cut_lists(numbers[slots], groups),
            },
            len(texts),
        )
        size += sum(len(text or b"") for text in texts)
        if size >= limit or len(seen) >= CHUNK_PAIRS:
            yield pair_rows()
            chunk, size, seen, counted = chunk + 1, 0, defaultdict(count().__next__), []
    if counted:
        yield pair_rows()


def align(docs: DataFrame, a: str = A, b: str = B, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Two kinds of rows. A row per text (slot is null): doc_id, a_ids and b_ids (its tokens), a_sizes and b_sizes (how many of
    them each group has), links (a number per group, of the pair of ids that end it). A row per chunk of texts and pair of ids
    (slot is its number in links): a, b and n, how often they end together in the chunk.

    A is encoded from a space and the text, B from the text, to which it adds the space; strings of special tokens are plain
    text. Owner arrays say for each byte which token it is of: consecutive distinct pairs of owners are overlaps, and where
    both owners change at once, both tokens end and a group is cut. Every token has bytes, so a group ends with one pair.

    Null and empty texts, and those whose tokens do not spell a space and the text, have no tokens; they keep their rows.
    Repeated rows and null or repeated doc_ids are aligned each. A text of any length is aligned whole. An empty table gives no
    rows; extra columns, whatever their names, are ignored."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(partial(aligned_rows, a, b, chunk_bytes), from_arrow_schema(ALIGNED))


def spelled(ids: pa.Array, sizes: np.ndarray) -> pa.Array:
    """ids in decimals, joined by commas group by group."""
    ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(ends, ids.cast(pa.string())), ",")


def digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            texts, pairs = batch.filter(pc.is_null(batch["slot"])), batch.filter(pc.is_valid(batch["slot"]))
            if pairs.num_rows:
                yield rows_of(DIGESTS, {name: pairs[name] for name in ("chunk", *PAIRS)}, pairs.num_rows)
            if not texts.num_rows:
                continue
            a_sizes, b_sizes = (texts[name].flatten().to_numpy(zero_copy_only=False) for name in ("a_sizes", "b_sizes"))
            groups = pc.binary_join_element_wise(spelled(texts["a_ids"].flatten(), a_sizes), spelled(texts["b_ids"].flatten(), b_sizes), "|")
            many = [pc.list_value_length(texts[name]).to_numpy(zero_copy_only=False) for name in ("a_ids", "b_ids", "a_sizes", "links")]
            lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many[2])), pa.int32()), groups), ";")
            marks = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in lines.to_pylist()]
            yield rows_of(DIGESTS, {"chunk": texts["chunk"], "doc_id": texts["doc_id"], "groups_sha256": marks, "links": texts["links"]} | dict(zip(COUNTS, many, strict=True)), texts.num_rows)


def group_digests(docs: DataFrame, a: str = A, b: str = B, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of align, with each text's ids and groups reduced to their numbers and the hash of `a1,a2|b1;a3|b2,b3` in the
    task that has aligned it: ids and groups, several times as long as the text, go nowhere."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(lambda batches: digest_rows(aligned_rows(a, b, chunk_bytes, batches)), from_arrow_schema(DIGESTS))


def link_counts(pairs: DataFrame) -> DataFrame:
    """a, b, count (how many links of all texts join them) and best (no other id of A has more links with b), from the pair
    rows of align. The window holds the ids that end with one id of B: at most the vocabulary of A."""
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(W.partitionBy("b")))


def link_scores(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """texts (doc_id, links, and what else they carry) with n_best and count_sum over their links. The counts of a chunk's
    pairs go back to the chunk: an id pair is one row of each chunk that has it, so no pair is hot."""
    found = pairs.select("chunk", "slot", "a", "b").join(link_counts(pairs), ["a", "b"]).select("chunk", "slot", "count", "best")
    carried = [name for name in texts.columns if name not in ("chunk", "links")]
    schema = texts.select(*carried).schema.add("n_best", "long").add("count_sum", "long")

    def run(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        sums = np.zeros((2, pairs.num_rows), np.int64)
        slots = pairs["slot"].to_numpy()
        sums[:, slots] = pairs["best"].to_numpy().astype(np.int64), pairs["count"].to_numpy()
        links = texts["links"].combine_chunks()
        ends = np.cumsum(pc.list_value_length(links).to_numpy(zero_copy_only=False))
        totals = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(sums[:, links.flatten().to_numpy(zero_copy_only=False)], axis=1)], axis=1)
        best, total = np.diff(totals[:, np.append(0, ends)], axis=1)
        return texts.select(carried).append_column("n_best", pa.array(best)).append_column("count_sum", pa.array(total))

    return texts.withColumnRenamed("chunk", "of").groupBy("of").cogroup(found.groupBy("chunk")).applyInArrow(run, schema)
