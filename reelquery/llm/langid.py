"""Language identification: word log frequencies first, backing off to shorter and shorter character n-grams."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelquery.llm.common import WordCache, checkpoint, map_texts

#: Labelled documents that the model is fitted on, at most: those with the smallest hash of their id.
SAMPLE_DOCS = 8_000
#: Orders of character n-grams, longest first; an unseen word is scored by the first order that knows any of its n-grams.
ORDERS = (5, 4, 3, 2, 1)
#: Share of an order's occurrences that an entry of the model must have (so an order has at most 1 / share entries), and
#: occurrences that a word must have.
LEAST_SHARE, LEAST_COUNT = 2e-6, 3
UNKNOWN = "und"
#: ASCII characters that are no letters become spaces; bytes of other characters stay.
LETTERS = bytes(x if x >= 128 or 97 <= x <= 122 else 32 for x in range(256))


def letter_words(text: bytes) -> list[bytes]:
    """Lower-case words of letters, parted at every other ASCII character."""
    return text.decode("utf-8", "replace").lower().encode().translate(LETTERS).split()


def grams(word: bytes, order: int) -> list[str]:
    """The character n-grams of a word with its borders; order 1 has no borders."""
    text = word.decode("utf-8", "replace")
    if order > 1:
        text = f"^{text}$"
    return [text[i : i + order] for i in range(len(text) - order + 1)]


def sampled(train: DataFrame, most: int = SAMPLE_DOCS) -> DataFrame:
    """At most about `most` rows of train: those whose hash of the id is among the smallest (rows with equal ids stay together)."""
    mark = F.xxhash64("doc_id")
    limit = train.select(mark.alias("h")).orderBy("h").limit(most).agg(F.max("h")).first()[0]
    return train.where(mark <= limit) if limit is not None else train.limit(0)


def gram_counts(train: DataFrame, orders: tuple[int, ...]) -> DataFrame:
    """lang, kind (0: word, else the order), gram, n: summed over tasks."""

    def one():
        def work(langs, texts):
            by: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(langs, texts, strict=True):
                by[lang].update(letter_words(text))
            rows = []
            for lang, words in by.items():
                rows += [(lang, 0, w.decode("utf-8", "replace"), n) for w, n in words.items()]
                for order in orders:
                    found: Counter = Counter()
                    for w, n in words.items():
                        for g in grams(w, order):
                            found[g] += n
                    rows += [(lang, order, g, n) for g, n in found.items()]
            return dict(zip(("lang", "kind", "gram", "n"), map(list, zip(*rows)) if rows else [[]] * 4, strict=True))

        return work

    return map_texts(train, one, "lang string, kind int, gram string, n long").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))


def fit(train: DataFrame, orders: tuple[int, ...] = ORDERS) -> dict:
    """The model: languages, and per kind gram -> log probability per language (add-one smoothed)."""
    counted = checkpoint(gram_counts(train, orders))
    totals = {(r["lang"], r["kind"]): r["n"] for r in counted.groupBy("lang", "kind").agg(F.sum("n").alias("n")).collect()}
    langs = sorted({lang for lang, _ in totals})
    whole = Counter()
    for (_, kind), n in totals.items():
        whole[kind] += n
    least = F.element_at(F.create_map(*[F.lit(x) for kind, n in whole.items() for x in (kind, max(LEAST_COUNT, n * LEAST_SHARE))]), F.col("kind")) if whole else F.lit(0.0)
    frequent = counted.groupBy("kind", "gram").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")).where(F.col("n") >= least)
    tables: dict[int, dict] = {kind: {} for kind in (0, *orders)}
    for r in frequent.select("kind", "gram", "by").collect():
        tables[r["kind"]][r["gram"]] = r["by"]
    model: dict = {"langs": langs, "tables": {}, "prior": None}
    for kind, table in tables.items():
        base = np.array([totals.get((lang, kind), 0) + len(table) + 1 for lang in langs], float)
        model["tables"][kind] = {g: np.log((np.array([by.get(lang, 0) for lang in langs], float) + 1) / base).astype(np.float32) for g, by in table.items()}
    if langs:
        shares = np.array([totals.get((lang, 0), 0) + 1 for lang in langs], float)
        model["prior"] = np.log(shares / shares.sum())
    return model


def scorer(model: dict, orders: tuple[int, ...] = ORDERS):
    """word -> log likelihoods per language: of the word if known, else the mean of its longest known n-grams, else zeros."""
    words, nothing = model["tables"][0], np.zeros(len(model["langs"]), np.float32)

    def make(cache: WordCache, word: bytes) -> np.ndarray:
        known = words.get(word.decode("utf-8", "replace"))
        if known is not None:
            return known
        for order in orders:
            table = model["tables"][order]
            hits = [table[g] for g in grams(word, order) if g in table]
            if hits:
                return np.mean(hits, axis=0, dtype=np.float32)
        return nothing

    return WordCache(make)


def identify(docs: DataFrame, train: DataFrame, sample_docs: int = SAMPLE_DOCS, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """doc_id, lang_pred, score for every document. Only doc_id and text of docs are read.

    train has doc_id, lang and text; rows with a null among them are not learned from. lang_pred is a learned language, or
    `und` with score 0 if the text is null, has no letter, or nothing was learned. score is the posterior probability of
    the predicted language; ties go to the language first by code point. Repeated rows are scored each; extra columns are
    ignored. The model has a bounded number of entries (LEAST_SHARE), so it is broadcast."""
    usable = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    # a small sample may lie in few files: deal it out
    sample = sampled(usable, sample_docs).select(F.col("lang").cast("string"), F.col("text").cast("string")).repartition(docs.sparkSession.sparkContext.defaultParallelism)
    model = fit(sample, orders)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one():
        langs, prior = shared.value["langs"], shared.value["prior"]
        cache = scorer(shared.value, orders)

        def work(ids, texts):
            best, score = [], []
            for text in texts:
                found = letter_words(text) if text and langs else []
                # bytes of other characters count as letters only where the text has a letter
                if not found or not any(map(str.isalpha, text.decode("utf-8", "replace"))):
                    best.append(UNKNOWN)
                    score.append(0.0)
                    continue
                total = np.sum(list(map(cache.__getitem__, found)), axis=0, dtype=np.float64) + prior
                cache.trim()
                odds = np.exp(total - total.max())
                top = int(odds.argmax())
                best.append(langs[top])
                score.append(float(odds[top] / odds.sum()))
            return {"doc_id": ids, "lang_pred": best, "score": score}

        return work

    return map_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), one, "doc_id long, lang_pred string, score double")
