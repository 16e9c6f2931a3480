"""Best-two-fit packing of documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial
from unicodedata import category, normalize

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.window import Window as W

from reelquery.llm.common import byte_letters, checkpoint

LENGTH, TOKENIZER, END = 2048, "word_bpe_49k.json", b"\0\0\0\0"
#: Pieces of one length that one task ranks, on average; a length with more pieces is dealt over several tasks.
RANKED_AT_ONCE = 256
#: Bytes of text whose distinct words are encoded together, words that are encoded at once, and characters above which a word is
#: left to the vocabulary's library.
TEXT_BYTES, WORDS_AT_ONCE, LONG_WORD = 16_000_000, 10_000, 200
PIECES = pa.schema({"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()})
#: How the vocabulary parts a word, and the end of its suffixed pieces.
PARTS, SUFFIX = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "</w>"


def plain_characters() -> tuple[str, str]:
    """Letters, and marks other than letters and digits, that normalizing keeps and lowering turns into one character each."""
    found = [x for x in map(chr, [*range(0x21, 0x500), *range(0x2010, 0x2028)]) if normalize("NFC", x) == x]
    letters = [x for x in found if category(x)[0] == "L" and len(x.lower()) == 1 and x.lower() < "\u0500" and x != "\u03a3"]  # sigma: lowered by its place
    return "".join(letters), "".join(x for x in found if category(x)[0] in "PS")


class WordIds:
    """The ids of words, many at a time.

    Such a vocabulary drops white space, so a text's ids are the ids of its words one after another. It also lowers case and
    parts letters, digits and marks. Plain words go through the ranks of the same vocabulary, in which byte 0 stands for
    the end of a part: a piece has one merge and encodes as itself, so merging by rank and merging by list agree. Words with
    other characters, with added tokens (found before case is lowered) or above LONG_WORD characters go through the library, and
    so do all words of a vocabulary of another kind."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder().values()
        self.added = [token.content for token in added]
        letters, marks = map(re.escape, plain_characters())
        self.other = re.compile(f"[^0-9\n{letters}{marks}]")
        self.parts = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[0-9]|[{marks}]+|\n")
        with open(path, encoding="utf-8") as file:
            kind = json.load(file)
        normal = [x["type"] for x in (kind["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        parted = json.dumps(PARTS) in json.dumps(kind["pre_tokenizer"]) and kind["model"].get("end_of_word_suffix") == SUFFIX
        self.ranks = None
        if normal and parted and not any(token.normalized for token in added):
            byte = {letter: k for k, letter in enumerate(byte_letters())}
            ranks = {bytes(byte[x] for x in piece.removesuffix(SUFFIX)) + b"\0" * piece.endswith(SUFFIX): number for piece, number in kind["model"]["vocab"].items()}
            self.ranks = tiktoken.Encoding("parts", pat_str="[^\0]+\0", mergeable_ranks=ranks, special_tokens={})
            self.line = ranks[b"\n\0"]

    def strange(self, text: str) -> bool:
        return self.ranks is None or self.other.search(text) is not None or any(token in text for token in self.added)

    def some(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and the ids one after another."""
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), b"\n")
        text = str(whole[0].as_buffer(), "utf-8", "replace")
        own = {}
        if self.strange(text) or pc.max(pc.binary_length(words)).as_py() > LONG_WORD:
            lines = text.split("\n")
            odd = [k for k, line in enumerate(lines) if len(line) > LONG_WORD or self.strange(line)]
            own = dict(zip(odd, [x.ids for x in self.library.encode_batch_fast([lines[k] for k in odd], add_special_tokens=False)], strict=True))
            text = "\n".join("" if k in own else line for k, line in enumerate(lines))
        if self.ranks is None:
            ids, counts = np.zeros(0, np.uint32), np.zeros(len(words), np.int64)
        else:
            ids = self.ranks.encode_to_numpy("\0".join([*self.parts.findall(text.lower()), "\n\0"]))
            ends = np.flatnonzero(ids == self.line)
            ids, counts = np.delete(ids, ends), np.diff(ends, prepend=-1) - 1
        if own:
            at, many = np.array(list(own)), np.array(list(map(len, own.values())))
            ids = np.insert(ids, np.repeat((np.cumsum(counts) - counts)[at], many), [x for found in own.values() for x in found])
            counts[at] = many
        return counts, ids.astype("<u4", copy=False)

    def encode(self, words: pa.Array) -> pa.ListArray:
        """The ids of each word, given as bytes."""
        found = [self.some(words.slice(at, WORDS_AT_ONCE)) for at in range(0, len(words), WORDS_AT_ONCE)]
        counts, ids = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.uint32()))

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin, with the end of the last. Of equal words, one
        is encoded."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))  # empty words at the edges of a text have no ids
        words = split.flatten().dictionary_encode()
        placed = self.encode(words.dictionary.cast(pa.binary())).take(words.indices)
        return placed.flatten().to_numpy(), placed.offsets.to_numpy()[split.offsets.to_numpy()]

    def __getitem__(self, word: bytes) -> bytes:
        """The ids of a word as little-endian unsigned 32-bit integers."""
        return self.some(pa.array([word], pa.binary()))[1].tobytes()


@lru_cache(maxsize=1)  # a Python worker keeps it from task to task
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def parts_by_bytes(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch of (id, text) that hold about limit bytes of text at most; a longer text may stand with others."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    total = int(size[-1]) if len(size) else 0
    share = np.maximum(size - 1, 0) * -(-total // limit) // max(1, total)
    edges = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(size)]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(low, high - low)


def cut_texts(length: int, tokenizer: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of (id, text)."""
    words = word_ids(tokenizer_path(tokenizer))
    for batch in batches:
        for part in parts_by_bytes(batch, TEXT_BYTES):
            ids, edges = words.of_texts(part.column(1))
            rows = []
            for doc_id, low, high in zip(part.column(0).to_pylist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                packed = ids[low:high].tobytes() + END
                for piece, at in enumerate(range(0, len(packed), 4 * length)):
                    own = packed[at : at + 4 * length]
                    rows.append((doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own)))
            yield pa.RecordBatch.from_pydict(dict(zip(PIECES.names, map(list, zip(*rows, strict=True)) if rows else [[]] * len(PIECES), strict=True)), schema=PIECES)


def tokenized_pieces(docs: DataFrame, length: int = LENGTH, tokenizer: str = TOKENIZER) -> DataFrame:
    """A row per piece: a document's token ids and an end id 0, cut every length ids. A null text counts as empty."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(partial(cut_texts, length, tokenizer), from_arrow_schema(PIECES))


def best_two(counts: np.ndarray, room: int, above: int) -> tuple[int, int] | None:
    """Two lengths in stock whose sum is the largest that is over above and at most room."""
    top = min(room - 1, len(counts) - 1)
    if top < 1:
        return None
    a = np.flatnonzero(counts[: top + 1] > 0)
    if not len(a):
        return None
    below = np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0))
    b = below[np.minimum(room - a, len(counts) - 1)]
    lone = (b == a) & (counts[a] < 2)
    b = np.where(lone, below[np.maximum(a - 1, 0)], b)
    total = np.where(b > 0, a + b, 0)
    best = int(total.argmax())
    return (int(a[best]), int(b[best])) if above < total[best] <= room else None


def pack_counts(stock: dict[int, int], length: int = LENGTH) -> list[tuple[list[int], int]]:
    """Best-two-fit over a stock of lengths: [(lengths of a sequence, how many such sequences)].

    A bin is filled greedily, each time with the longest piece that fits. When none fits, its smallest piece gives way to
    two unpacked pieces that fill the widened gap more tightly, as long as that fills the bin further. Equal stock packs
    equally, so a filling is repeated while the stock lasts: the work depends on the number of lengths, not of pieces."""
    counts = np.zeros(length + 1, np.int64)
    for size, n in stock.items():
        counts[size] = n
    out = []
    while counts.any():
        left, bin_, gap = counts.copy(), [], length
        while True:
            fits = np.flatnonzero(left[: gap + 1])
            if len(fits):
                bin_.append(int(fits[-1]))
                left[fits[-1]] -= 1
                gap -= int(fits[-1])
                continue
            smallest = min(bin_)
            pair = best_two(left, gap + smallest, smallest) if gap else None
            if pair is None:
                break
            bin_.remove(smallest)
            left[smallest] += 1
            for x in pair:
                bin_.append(x)
                left[x] -= 1
            gap += smallest - sum(pair)
        used = np.bincount(bin_, minlength=length + 1)
        times = int((counts[used > 0] // used[used > 0]).min())
        counts -= used * times
        out.append((sorted(bin_, reverse=True), times))
    return out


def placing(fillings: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> (first rank, first sequence, copies per sequence, offset) of each filling that uses it."""
    rank: dict[int, int] = {}
    rows: dict[int, list] = {}
    first = 0
    for bin_, times in fillings:
        at = 0
        for size in dict.fromkeys(bin_):
            copies = bin_.count(size)
            rows.setdefault(size, []).append((rank.get(size, 0), first, copies, at))
            rank[size] = rank.get(size, 0) + copies * times
            at += copies * size
        first += times
    return {size: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for size, r in rows.items()}


def ranked_by_length(pieces: DataFrame, counts: dict[int, int], length: int) -> DataFrame:
    """pieces and rank: 0, 1, ... within each length. A frequent length is dealt over many chunks by a hash, and a chunk's
    ranks start where the chunks before it end, so no task holds all pieces of a length."""
    chunks = F.array(*[F.lit(-(-counts.get(x, 0) // RANKED_AT_ONCE) or 1) for x in range(1, length + 1)])
    dealt = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.element_at(chunks, F.col("length").cast("int"))))
    before = dealt.groupBy("length", "chunk").agg(F.count("*").alias("n")).select("length", "chunk", (F.sum("n").over(W.partitionBy("length").orderBy("chunk")) - F.col("n")).alias("before"))
    inside = F.row_number().over(W.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32"))
    return dealt.withColumn("inside", inside).join(before, ["length", "chunk"]).withColumn("rank", F.col("before") + F.col("inside") - 1).drop("chunk", "before", "inside")


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str = TOKENIZER) -> DataFrame:
    """Every document's pieces with their sequence_id and offset; sequences hold at most length tokens, gapless from 0.

    Null or empty texts are a single end token. Documents beyond length are cut into whole sequences and a rest; nothing
    else is cut, dropped or padded. Repeated rows are packed as often as they occur. An empty table gives no rows; extra
    columns are ignored. Only the histogram of piece lengths (at most length numbers) reaches the driver."""
    pieces = checkpoint(tokenized_pieces(docs, length, tokenizer))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    place = placing(pack_counts(counts, length))

    @F.pandas_udf("sequence_id long, offset long")
    def seat(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, rank = size.to_numpy(), rank.to_numpy()
        sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for x in np.unique(size):
            here = size == x
            start, first, copies, at = place[int(x)]
            k = np.searchsorted(start, rank[here], "right") - 1
            turn = rank[here] - start[k]
            sequence[here] = first[k] + turn // copies[k]
            offset[here] = at[k] + turn % copies[k] * x
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    seated = ranked_by_length(pieces, counts, length).withColumn("seat", seat("length", "rank"))
    return seated.select("doc_id", "piece", "start", "length", "ids_crc32", "seat.sequence_id", "seat.offset")
