"""BPE encoding through a table of distinct words, and decoding through the table of pieces."""

from __future__ import annotations

import os
import zlib
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

from reelquery.llm.common import text_bytes
from reelquery.llm.packing import TOKENIZER, tokenizer_path

#: Bytes of text after which a task begins a new chunk. A chunk's texts meet its words' ids in one task, so this bounds it.
CHUNK_BYTES = 16_000_000
#: Words whose ids are put in place at once, and texts that are decoded at once.
PLACED_AT_ONCE, DECODED_AT_ONCE = 400_000, 512
#: Parts of the table of distinct words; all words of a part have the same hash, and are encoded by one task.
WORD_PARTS = 4096
TEXTS = pa.schema({"chunk": pa.int64(), "mark": pa.int64(), "entries": pa.int64(), "doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int32()), "numbers": pa.binary()})
WORDS = pa.schema({"part": pa.int32(), "chunk": pa.int64(), "mark": pa.int64(), "slots": pa.binary(), "words": pa.binary()})
IDS = pa.schema({"chunk": pa.int64(), "mark": pa.int64(), "slots": pa.binary(), "counts": pa.binary(), "ids": pa.binary()})


def squeeze(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, all lowest bytes first: small ones then compress to little more than a byte."""
    planes = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.Codec("zstd").compress(planes).to_pybytes()


def spread(packed: bytes) -> np.ndarray:
    """The numbers that squeeze packed."""
    size = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(packed[8:], size) if size else b"", np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


class Chunk:
    """The texts of a chunk as numbers of its distinct words; numbers go by frequency, ties by first occurrence."""

    def __init__(self):
        self.seen = defaultdict(count().__next__)
        self.doc_ids, self.lengths, self.parts, self.bytes = [], [], [], 0

    def add(self, doc_id, text: bytes | None) -> None:
        numbers = list(map(self.seen.__getitem__, (text or b"").split()))
        self.doc_ids.append(doc_id)
        self.lengths.append(len(numbers))
        self.parts.append(np.array(numbers, np.uint32))
        self.bytes += len(text or b"")

    def settle(self) -> tuple[np.ndarray, list[bytes], int]:
        """The texts' numbers, the words by number, and a mark of the words and their order."""
        numbers = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint32)
        order = np.argsort(-np.bincount(numbers, minlength=len(self.seen)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        words = list(self.seen)
        words = [words[k] for k in order.tolist()]
        return rank[numbers], words, zlib.crc32(b" ".join(words))


def chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, Chunk]]:
    """The chunks of a task and their keys: the task's partition, then its chunks in order."""
    key, chunk = TaskContext.get().partitionId() << 32, Chunk()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            for doc_id, text in zip(part.column(0).to_pylist(), text_bytes(part.column(1)), strict=True):
                chunk.add(doc_id, text)
                if chunk.bytes >= limit:
                    yield key, chunk
                    key, chunk = key + 1, Chunk()
    if chunk.doc_ids:
        yield key, chunk


def rows_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*rows, strict=True)) if rows else [[]] * len(schema), strict=True)), schema=schema)


def chunk_texts(limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per chunk: its texts as numbers of words."""
    for key, chunk in chunks(batches, limit):
        numbers, words, mark = chunk.settle()
        yield rows_of(TEXTS, [(key, mark, len(words), chunk.doc_ids, chunk.lengths, squeeze(numbers))])


def chunk_words(limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per chunk and part of the table of words: the chunk's words of that part and their numbers."""
    codec = pa.Codec("zstd")
    for key, chunk in chunks(batches, limit):
        _, words, mark = chunk.settle()
        part = np.fromiter((zlib.crc32(w) % WORD_PARTS for w in words), np.int64, len(words))
        order = np.argsort(part, kind="stable")
        edges = np.flatnonzero(np.diff(part[order], prepend=-1, append=WORD_PARTS))
        rows = []
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            slots = order[low:high]
            joined = b" ".join([words[k] for k in slots.tolist()])
            rows.append((int(part[slots[0]]), key, mark, squeeze(slots), len(joined).to_bytes(8, "little") + codec.compress(joined).to_pybytes()))
        yield rows_of(WORDS, rows)


def words_encoder(tokenizer: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Encodes every distinct word once. The rows of a part come one after another, so only its words are kept."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole, codec = Tokenizer.from_file(tokenizer_path(tokenizer)), pa.Codec("zstd")
        whole.no_truncation()
        whole.no_padding()
        known, current = {}, None
        for batch in batches:
            rows = []
            for part, chunk, mark, slots, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != current:
                    known, current = {}, part
                words = codec.decompress(packed[8:], int.from_bytes(packed[:8], "little")).to_pybytes().split()
                new = [w for w in words if w not in known]
                for word, found in zip(new, whole.encode_batch_fast([w.decode("utf-8", "replace") for w in new], add_special_tokens=False), strict=True):
                    known[word] = found.ids
                ids = list(map(known.__getitem__, words))
                flat = np.array([x for own in ids for x in own], np.uint32)
                rows.append((chunk, mark, slots, squeeze(np.array(list(map(len, ids)), np.uint32)), squeeze(flat)))
            yield rows_of(IDS, rows)

    return encode


def join_by_position(texts: pa.Table, found: pa.Table) -> pa.Table:
    """The ids of a chunk's texts: at every position those of its word."""
    doc_ids, ids = [], []
    for row in texts.to_pylist():
        entries = row["entries"]
        own = found.filter(pc.equal(found["mark"], row["mark"])).to_pylist()
        parts = [(spread(x["slots"]), spread(x["counts"]), spread(x["ids"])) for x in own]
        slots, counts, flat = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.uint32) for k in range(3))
        if len(slots) != entries:
            raise RuntimeError("the texts were read in another order the second time: write them to files first")
        first, many = np.zeros(entries, np.int64), np.zeros(entries, np.int64)
        many[slots] = counts
        first[slots] = np.cumsum(counts, dtype=np.int64) - counts
        numbers, placed = spread(row["numbers"]), [np.zeros(0, np.int32)]
        for at in range(0, len(numbers), PLACED_AT_ONCE):
            part = numbers[at : at + PLACED_AT_ONCE]
            each = many[part]
            ends = np.cumsum(each)
            placed.append(flat[np.repeat(first[part] - ends + each, each) + np.arange(ends[-1])].astype(np.int32))
        ends = np.append(0, np.cumsum(many[numbers]))
        edges = ends[np.append(0, np.cumsum(row["lengths"], dtype=np.int64))]
        doc_ids += row["doc_ids"]
        ids.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(placed))))
    return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.chunked_array(ids, pa.list_(pa.int32()))})


def encode(docs: DataFrame, tokenizer: str = TOKENIZER, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id and ids, the whole text as the vocabulary's tokenizer encodes it, without special tokens of its own.

    Texts are split into words [^\\x20\\x09-\\x0D]+, which such a tokenizer (one whose pre-tokenizer drops white space) encodes
    one by one; strings of special tokens inside words are encoded by it as well. A task reduces a chunk of texts to its
    distinct words; these meet in WORD_PARTS parts by hash, where each distinct word is encoded once; ids go back to the chunk
    and are put at the positions of their words. A word that is everywhere comes once from each chunk, so no key is hot.

    Every row gives a row: null and empty texts no ids, repeated rows and null or repeated doc_ids each their own. A long text
    is encoded whole, as a chunk of its own. An empty table gives no rows; extra columns, whatever their names, are ignored.
    The texts are read twice and must come in the same order, as from files; else the task fails rather than mix them up."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    words = texts.mapInArrow(partial(chunk_words, chunk_bytes), from_arrow_schema(WORDS)).repartition("part").sortWithinPartitions("part")
    ids = words.mapInArrow(words_encoder(tokenizer), from_arrow_schema(IDS))
    numbered = texts.mapInArrow(partial(chunk_texts, chunk_bytes), from_arrow_schema(TEXTS))
    return numbered.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(join_by_position, "doc_id long, ids array<int>")


@lru_cache(maxsize=2)  # a Python worker keeps it from task to task
def pieces(path: str) -> pa.Array:
    """The piece of every id, in the order of ids: as long as the vocabulary. A decoder of its own is not supported."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if tokenizer.decoder is not None:
        raise ValueError("the tokenizer has a decoder; pieces joined by spaces would not be its texts")
    named = {number: piece for piece, number in tokenizer.get_vocab(with_added_tokens=True).items()}
    return pa.array([named.get(k) for k in range(max(named) + 1)], pa.string())


def decode(encoded: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """encoded (doc_id, ids) and text: the pieces of the ids, special tokens included, joined by one space.

    Ids are joined with the table of pieces, which is as long as the vocabulary, by their number. Ids without a piece are left
    out, as the library does; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(tokenizer_path(tokenizer))
        for whole in batches:
            for at in range(0, whole.num_rows, DECODED_AT_ONCE):
                batch = whole.slice(at, DECODED_AT_ONCE)
                ids = batch.column("ids")
                flat = ids.flatten()
                named = table.take(pc.if_else(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(table))), flat, None))
                ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)))
                if named.null_count:
                    there = np.append(0, np.cumsum(named.is_valid().to_numpy(zero_copy_only=False)))
                    ends, named = there[ends], named.drop_null()
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), named), " ")
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, text], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
