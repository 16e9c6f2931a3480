"""Quality rules: counts of a text, and the divergence of its distributions from language references."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelquery.llm.common import checkpoint, fold_texts, map_texts
from reelquery.llm.rowfilter import where_text

#: Base rules: fewest words, and the percentage of words in repeated three-word windows above which a text fails.
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = b"#*$%&|<>"
#: Divergence rules: the Jensen-Shannon distance (base 2) of the character classes above which a text is rejected; that of
#: the common words is WORDS_DISTANCE plus WORDS_NOISE / sqrt(words), since a short text's histogram is the noisier; and the
#: fewest characters or words for a histogram to be judged at all.
CHARS_DISTANCE, CHARS_GUARD = 0.28, 200
WORDS_DISTANCE, WORDS_NOISE, WORDS_GUARD = 0.2, 2.2, 50
#: A word is common in a language if it makes up this share of its words (so at most 1 / share are); a language has a
#: reference if it has this many words, whatever its share of the corpus.
COMMON_SHARE, LANGUAGE_WORDS = 0.002, 20_000
#: Character classes: upper-case, other ASCII vowels, other ASCII consonants, digits, white space, ending and joining
#: punctuation, other ASCII, other characters (by their first UTF-8 byte).
CLASSES = 8
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def class_table() -> bytes:
    table = np.full(256, 6, np.uint8)
    table[[x for x in range(256) if chr(x).isascii() and chr(x).isupper()]] = 0
    table[list(range(97, 123))] = 2
    table[list(b"aeiouy")] = 1
    table[list(b"0123456789")] = 3
    table[list(b" \t\n\x0b\x0c\r")] = 4
    table[list(b".,;:!?'\"()-")] = 5
    table[192:] = 7
    table[128:192] = CLASSES  # continuation bytes: no character of their own
    return table.tobytes()


TABLE = class_table()


def char_classes(text: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(text.translate(TABLE), np.uint8), minlength=CLASSES + 1)[:CLASSES]


#: ASCII letters in lower case, and punctuation that parts words; symbols and digits stay in their words, which makes those unusual.
PLAIN = bytes(x + 32 if 65 <= x <= 90 else 32 if x in b".,;:!?'\"()-" else x for x in range(256))
#: Odd multipliers that combine the hashes of a window's words.
WINDOW = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def base_counts(text: bytes) -> tuple[list[bytes], tuple[int, int, int, int, int]]:
    """The words of a text, and the numbers in COUNTS."""
    words = text.split()
    continuation = text.translate(None, delete=bytes(range(128)) + bytes(range(192, 256)))
    spaces = len(text) - sum(map(len, words))
    symbols = len(text) - len(text.translate(None, delete=SYMBOLS))
    seen: set[bytes] = set()
    again = 0
    for line in text.split(b"\n") if b"\n" in text else ():
        if line in seen:
            again += bool(line.split())
        seen.add(line)
    n = len(words)
    repeated = 0
    if n > 3:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)  # 64-bit hashes: equal words, equal windows
        windows = h[:-2] * WINDOW[0] + h[1:-1] * WINDOW[1] + h[2:] * WINDOW[2]
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        if same.any():
            twice = np.zeros(n - 2, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            inside = np.zeros(n, bool)
            for k in range(3):
                inside[k : k + n - 2] |= twice
            repeated = int(inside.sum())
    return words, (n, len(text) - len(continuation) - spaces, symbols, again, repeated)


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat > MOST_REPEATED * n_words


def distance(counts: np.ndarray, reference: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms: the root of the divergence in bits, 0 to 1."""
    p, q = counts / counts.sum(), reference / reference.sum()
    m = (p + q) / 2
    part = lambda x: float(np.sum(x[x > 0] * np.log2(x[x > 0] / m[x > 0])))
    return float(np.sqrt(max(0.0, (part(p) + part(q)) / 2)))


def reference_counts(docs: DataFrame) -> DataFrame:
    """lang, kind (0: character class, 1: word without punctuation, 2: all words), item, n over all texts with a language that pass the base rules."""

    def one():
        classes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(CLASSES, np.int64))
        by: dict[str, Counter] = defaultdict(Counter)
        total: Counter = Counter()

        def add(langs, texts):
            for lang, text in zip(langs, texts, strict=True):
                _, (n, *_, repeated) = base_counts(text)
                if not base_failed(n, repeated):
                    classes[lang] += char_classes(text)
                    total[lang] += n
                    by[lang].update(text.translate(PLAIN).split())

        def rows():
            found = [(lang, 0, str(i), int(n)) for lang, c in classes.items() for i, n in enumerate(c)]
            found += [(lang, 2, "", n) for lang, n in total.items()]
            found += [(lang, 1, w.decode("utf-8", "replace"), n) for lang, c in by.items() for w, n in c.items()]
            for held in (classes, total, by):
                held.clear()
            return dict(zip(("lang", "kind", "item", "n"), map(list, zip(*found)) if found else [[]] * 4, strict=True))

        return add, lambda: sum(map(len, by.values())), rows

    return fold_texts(docs, one, "lang string, kind int, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


def references(docs: DataFrame, common_share: float = COMMON_SHARE, language_words: int = LANGUAGE_WORDS) -> list[dict]:
    """Per language of at least language_words words: its character classes, its common words, and their counts (last: all
    other words). At most CLASSES + 1 / common_share rows a language reach the driver, whatever the size of the corpus."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    counted = checkpoint(reference_counts(rows))
    per_lang = counted.where("kind = 2").groupBy("lang").agg(F.sum("n").alias("words"))
    large = per_lang.where(F.col("words") >= language_words).select("lang", "words")
    found = counted.join(F.broadcast(large), "lang").where((F.col("kind") == 0) | (F.col("kind") == 1) & (F.col("n") >= F.lit(common_share) * F.col("words"))).collect()
    out = []
    for lang in sorted({r["lang"] for r in found}):
        own = [r for r in found if r["lang"] == lang]
        classes = np.zeros(CLASSES, np.int64)
        for r in own:
            if r["kind"] == 0:
                classes[int(r["item"])] = r["n"]
        words = sorted((r["item"], r["n"]) for r in own if r["kind"] == 1)
        counts = np.array([n for _, n in words] + [max(0, own[0]["words"] - sum(n for _, n in words))], float)
        out.append({"lang": lang, "classes": classes.astype(float), "words": [w.encode() for w, _ in words], "counts": counts})
    return out


def divergences(n_words: int, words: list[bytes], classes: np.ndarray, refs: list[dict]) -> list[tuple[str, float, float]]:
    """(language, distance of character classes, distance of common words) for each reference. The last bin of the words'
    histogram is what the n_words of the text have besides common words."""
    counts = Counter(words)
    out = []
    for ref in refs:
        common = np.array([counts.get(w, 0) for w in ref["words"]], float)
        histogram = np.append(common, max(0.0, n_words - common.sum()))
        out.append((ref["lang"], distance(classes, ref["classes"]), distance(histogram, ref["counts"])))
    return out


LIMITS = (CHARS_DISTANCE, CHARS_GUARD, WORDS_DISTANCE, WORDS_NOISE, WORDS_GUARD)
NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "nearest", "chars_distance", "words_distance"]


def verdict_on(text: bytes | None, lang: str | None, refs: list[dict], limits: tuple = LIMITS) -> tuple:
    """The values of NAMES after doc_id for one text, said to be in lang."""
    chars_limit, chars_guard, words_base, words_noise, words_guard = limits
    _, counts = base_counts(text or b"")
    failed = base_failed(counts[0], counts[4])
    if failed or not refs:
        return (*counts, failed, not failed, None, None, None)
    classes = char_classes(text)
    found = divergences(counts[0], text.translate(PLAIN).split(), classes, refs)
    words_limit = words_base + words_noise / counts[0] ** 0.5
    chars, many = classes.sum() >= chars_guard, counts[0] >= words_guard
    near = any((not chars or c <= chars_limit) and (not many or w <= words_limit) for _, c, w in found)
    kept = near or all(ref["lang"] != lang for ref in refs)  # no reference of its own language: not judged
    return (*counts, failed, kept, *min(found, key=lambda x: (x[1] / chars_limit + x[2] / words_limit, x[0])))


def judge(docs: DataFrame, refs_from: DataFrame | None = None, limits: tuple = LIMITS) -> DataFrame:
    """doc_id, the counts of COUNTS, base_failed, kept, and the nearest language with its two distances.

    A text that passes the base rules is kept if some language has both its character classes and its common words within
    the limits; a histogram of fewer characters or words than its guard is not judged. References come from all texts of
    refs_from (by default docs) that have a language and pass the base rules. Where the document's own language has no
    reference, or lang is null or missing, being far from the other languages says nothing: the base rules decide alone,
    and the nearest language and its distances are information only. A null text has no words and fails. Repeated rows are
    judged each; an empty table gives no rows; extra columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(references(refs_from if refs_from is not None else docs))

    def one():
        refs = shared.value

        def work(keys, texts):
            rows = [(key["doc_id"], *verdict_on(text, key["lang"], refs, limits)) for key, text in zip(keys, texts, strict=True)]
            return dict(zip(NAMES, map(list, zip(*rows)) if rows else [[]] * len(NAMES), strict=True))

        return work

    schema = "doc_id long, " + COUNTS + ", base_failed boolean, kept boolean, nearest string, chars_distance double, words_distance double"
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), lang.cast("string").alias("lang"))
    return map_texts(docs.select(key.alias("key"), F.col("text").cast("string")), one, schema)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, in one pass after the references, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(references(docs))
    return where_text(docs, lambda: lambda texts, langs: [verdict_on(text, lang, shared.value)[6] for text, lang in zip(texts, langs, strict=True)], "lang")
