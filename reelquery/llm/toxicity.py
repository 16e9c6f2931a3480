"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelquery.llm.common import checkpoint, map_texts
from reelquery.llm.rowfilter import where_text

#: Labelled documents that the odds are fitted on, at most: those with the smallest hash of their id.
SAMPLE_DOCS = 40_000
#: Weight of the Dirichlet prior as a share of all counts, and the z-score that a token's log-odds need, above or below zero.
PRIOR_SHARE, LEAST_Z = 0.1, 3.0
#: Share of all counts that a counted token must have: the lexicon has at most 1 / share tokens.
LEAST_SHARE = 1e-5
#: What a token costs a passage whose log-odds are not known to differ from zero.
DRIFT = -0.25
#: Expected number of background segments of that score or more (E-value) below which a segment is significant.
SIGNIFICANT = 0.05
#: ASCII characters that are neither letters nor digits part tokens; bytes of other characters belong to tokens.
TOKENS = bytes(x if x >= 128 or 97 <= x <= 122 or 48 <= x <= 57 else 32 for x in range(256))
#: Range of the evidence that calibration tells apart.
EVIDENCE = (-30.0, 60.0)
FEATURES = "doc_id long, tokens long, best double, evidence double, segments array<struct<first: int, last: int, score: double>>, score double"


def tokens_of(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().translate(TOKENS).split()


def token_counts(labelled: DataFrame) -> DataFrame:
    """token, a and b: in how many toxic and other documents of labelled (toxic, text) a token stands. Counting documents keeps one long document from making a token toxic."""

    def one():
        def work(labels, texts):
            docs = {0: Counter(), 1: Counter()}
            for label, text in zip(labels, texts, strict=True):
                docs[label].update(set(tokens_of(text)))
            rows = [(w.decode("utf-8", "replace"), docs[1][w], docs[0][w]) for w in docs[0].keys() | docs[1].keys()]
            return dict(zip(("token", "a", "b"), map(list, zip(*rows)) if rows else [[]] * 3, strict=True))

        return work

    return map_texts(labelled, one, "token string, a long, b long").groupBy("token").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def log_odds(labelled: DataFrame, prior_share: float = PRIOR_SHARE, least_z: float = LEAST_Z) -> dict[str, tuple[float, float]]:
    """token -> (log-odds of toxic against other documents, share of the tokens of other documents).

    The odds have an informative Dirichlet prior (Monroe, Colaresi and Quinn 2008): each class's counts are smoothed by the
    token's share of all tokens. Tokens whose log-odds are within least_z standard errors of zero are left out."""
    counted = checkpoint(token_counts(labelled))
    a_all, b_all = counted.agg(F.sum("a"), F.sum("b")).first()
    if not a_all or not b_all:
        return {}
    prior, whole = (F.col("a") + F.col("b")) * prior_share, (a_all + b_all) * prior_share
    odds = lambda x, total: F.log((F.col(x) + prior) / (total + whole - F.col(x) - prior))
    z = F.col("odds") / F.sqrt(1 / (F.col("a") + prior) + 1 / (F.col("b") + prior))
    common = F.col("a") + F.col("b") >= LEAST_SHARE * (a_all + b_all)
    found = counted.withColumn("odds", odds("a", a_all) - odds("b", b_all)).where((F.abs(z) >= least_z) & common)
    return {r["token"]: (r["odds"], r["b"] / b_all) for r in found.collect()}


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (Ruzzo and Tompa 1999) of a sequence of scores, as (first, last, sum). Linear: sums are
    running, and segments begin and end at positive scores."""
    at = np.flatnonzero(score > 0)
    after = np.cumsum(score)[at]
    found: list[list] = []  # [first, last, sum before, sum after]
    for position, low, high in zip(at.tolist(), (after - score[at]).tolist(), after.tolist(), strict=True):
        new = [position, position, low, high]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high in found]


def decay(lexicon: dict[str, tuple[float, float]], drift: float = DRIFT) -> float:
    """lambda of the extreme-value law: the positive root of sum p(s) exp(lambda s) = 1 over background token scores."""
    s, p = np.array(list(lexicon.values()), float).reshape(-1, 2).T
    rest = max(0.0, 1 - p.sum())

    def excess(x: float) -> float:
        return float((p * np.exp(np.minimum(x * s, 600))).sum() + rest * math.exp(x * drift) - 1)

    low, high = 1e-3, 8.0
    if excess(high) <= 0:
        return high
    if excess(low) >= 0:
        return low
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return low


def segment_finder(odds: dict[str, float]):
    """find(text) -> (number of tokens, its maximal segments). A token scores its log-odds, or DRIFT if it has none."""
    known = {w.encode(): x for w, x in odds.items()}

    def find(text: bytes | None) -> tuple[int, list[tuple[int, int, float]]]:
        words = tokens_of(text) if text else []
        score = np.fromiter((known.get(word, DRIFT) for word in words), float, len(words))
        return len(words), maximal_segments(score)

    return find


def evidence_of(n: int, scores: list[float], rate: float, factor: float, significant: float = SIGNIFICANT) -> tuple[float, list[bool]]:
    """Evidence of a text of n tokens with segments of these scores, and which segments are significant.

    A segment of score S is expected E = factor * n * exp(-rate * S) times in a background text of that length. evidence
    adds up ln(1 / E) over the segments with E below significant, and is ln(1 / E) of the best where none is (of a score
    of zero where there is no segment)."""
    space = math.log(factor * max(n, 1))
    values = [rate * s - space for s in scores]
    sure = [x > -math.log(significant) for x in values]
    return (sum(x for x, yes in zip(values, sure, strict=True) if yes) if any(sure) else max(values, default=-space)), sure


def scorer(model: dict):
    """features(text) -> (tokens, best, evidence, significant segments, score) under a fitted model."""
    find, slope, shift = segment_finder(model["odds"]), model["slope"], model["shift"]

    def features(text: bytes | None) -> tuple:
        n, found = find(text)
        evidence, sure = evidence_of(n, [x[2] for x in found], model["rate"], model["factor"])
        x = min(max(evidence, EVIDENCE[0]), EVIDENCE[1]) * slope + shift
        passages = [{"first": a, "last": b, "score": s} for (a, b, s), yes in zip(found, sure, strict=True) if yes]
        return n, max((x[2] for x in found), default=0.0), evidence, passages, 1 / (1 + math.exp(min(max(-x, -700.0), 700.0)))

    return features


def platt(evidence: DataFrame) -> tuple[float, float]:
    """Slope and intercept of a logistic regression of toxic on evidence, by Newton steps over evidence rounded to tenths
    within EVIDENCE: at most 901 groups reach the driver, however many rows are labelled."""
    step = F.round(F.least(F.greatest("evidence", F.lit(EVIDENCE[0])), F.lit(EVIDENCE[1])), 1).alias("x")
    rows = evidence.groupBy(step).agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).orderBy("x").collect()
    if not rows or not 0 < sum(r["toxic"] for r in rows) < sum(r["n"] for r in rows):
        return 0.0, -20.0
    x, n, y = (np.array([r[k] for r in rows], float) for k in ("x", "n", "toxic"))
    design, beta = np.stack([x, np.ones_like(x)]), np.array([0.0, math.log(y.sum() / (n - y).sum())])
    ridge = np.array([1e-2, 1e-4])  # a little: classes may be separable
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(beta @ design, -40, 40)))
        move = np.linalg.solve((design * (n * p * (1 - p))) @ design.T + np.diag(ridge), design @ (y - n * p) - ridge * beta)
        beta += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def fit(train: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict:
    """The model: odds of the lexicon's tokens, rate and factor of the extreme-value law, slope and shift of the calibration.

    train holds the documents (doc_id, text) whose labels may be learned, labels has doc_id and toxic (0 or 1; other rows
    and nulls are ignored; a document labelled both ways counts as toxic). Learning uses the labelled documents with the
    smallest hash of their id (ties by id), sample_docs at most, so their labels are a bounded broadcast. Copies of a text
    count once for the odds, or their every word would seem to go with their label. The factor is the likeliest one for
    the best segments of the documents that are not toxic: n * exp(-rate * best) of a background text is exponential with
    that rate. Without labels of both kinds every score is nearly 0."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    ids = train.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    known = checkpoint(known.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs))
    labelled = checkpoint(train.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).join(F.broadcast(known), "doc_id"))
    firsts = labelled.groupBy("toxic", F.xxhash64("text").alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    lexicon = log_odds(labelled.join(F.broadcast(firsts), "doc_id", "left_semi").select("toxic", "text"))
    odds, rate = {w: x for w, (x, _) in lexicon.items()}, decay(lexicon)

    def one():
        find = segment_finder(odds)

        def work(toxic, texts):
            rows = [find(text) for text in texts]
            return {"toxic": toxic, "tokens": [n for n, _ in rows], "scores": [[x[2] for x in found] for _, found in rows]}

        return work

    cut = checkpoint(map_texts(labelled.select("toxic", "text"), one, "toxic int, tokens long, scores array<double>"))
    best = F.coalesce(F.array_max("scores"), F.lit(0.0))
    background = cut.where("toxic = 0 AND tokens > 0").agg(F.count("*").alias("n"), F.sum(F.col("tokens") * F.exp(-rate * best)).alias("x")).first()
    factor = background["n"] / background["x"] if background["n"] else 1.0
    values = F.transform("scores", lambda s: rate * s - F.log(factor * F.greatest("tokens", F.lit(1))))
    sure = F.filter(values, lambda x: x > -math.log(SIGNIFICANT))
    alone = F.coalesce(F.array_max(values), -F.log(factor * F.greatest("tokens", F.lit(1))))
    evidence = F.when(F.size(sure) > 0, F.aggregate(sure, F.lit(0.0), lambda a, x: a + x)).otherwise(alone)
    slope, shift = platt(cut.select("toxic", evidence.alias("evidence")))
    return {"odds": odds, "rate": rate, "factor": factor, "slope": slope, "shift": shift}


def score_toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score (0 to 1), predicted (score >= 0.5), and what the score rests on: tokens, best (the highest segment
    score), evidence, and the significant segments in token positions.

    Null and empty texts have no segment and score as such texts do; a text of any length is scored whole, in one linear
    scan. Touching segments of equal sums stay apart. Repeated rows are scored each; an empty table gives no rows; extra
    columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one():
        features = scorer(shared.value)

        def work(ids, texts):
            rows = [(doc_id, *features(text)) for doc_id, text in zip(ids, texts, strict=True)]
            return dict(zip(("doc_id", "tokens", "best", "evidence", "segments", "score"), map(list, zip(*rows)) if rows else [[]] * 6, strict=True))

        return work

    return map_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), one, FEATURES).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs that are not predicted toxic, in one pass without a shuffle. Null and empty texts are judged as
    score_toxicity scores them; repeated rows stay each; an empty table gives no rows; all columns are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one():
        features = scorer(shared.value)
        return lambda texts: [features(text)[4] < 0.5 for text in texts]

    return where_text(docs, one)
