"""Quality rules, language identification and toxicity."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SF, TABLES
from pyspark.sql import functions as F

from reelquery.llm import langid, quality, toxicity
from reelquery.llm.common import fold

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, t in enumerate(texts)], DOCS)


def naive_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        again += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(inside)


TEXTS = [None, "", " \n\t", "a", "a b c a b c", "x\nx\n\n\nx\n \n ", "é ü ß # $ 中文", "the cat sat " * 40, "w" * 50_000, " ".join(map(str, range(30_000)))]


def test_counts_against_naive_ones(spark):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("abcde") for _ in range(rng.randint(1, 60))) for _ in range(30)]
    rows = quality.judge(docs(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = naive_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_keeps_good_and_rejects_junk(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    found = quality.judge(table).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("NOT base_failed")
    good = found.where("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    junk = found.where("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good == 1.0 and junk < 0.1


def test_verdicts_against_naive_ones(spark):
    """kept of every document, from references and distances by their definitions."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    joined = str.maketrans({c: " " for c in ".,;:!?'\"()-"} | {chr(x): chr(x + 32) for x in range(65, 91)})

    def classes(text):
        found = Counter()
        for c in text:
            found[0 if "A" <= c <= "Z" else 1 if c in "aeiouy" else 2 if "a" <= c <= "z" else 3 if c in "0123456789" else 4 if c in " \t\n\x0b\x0c\r" else 5 if c in ".,;:!?'\"()-" else 6 if c.isascii() else 7] += 1
        return [found[k] for k in range(8)]

    def far(x, y):
        p, q = [[v / sum(z) for v in z] for z in (x, y)]
        half = lambda u: sum(v * math.log2(v / ((a + b) / 2)) for v, a, b in zip(u, p, q, strict=True) if v > 0)
        return math.sqrt(max(0.0, (half(p) + half(q)) / 2))

    base = {r["doc_id"]: naive_counts(r["text"]) for r in rows}
    fine = {i for i, n in base.items() if n[0] >= 50 and 100 * n[4] <= 50 * n[0]}
    refs = {}
    for lang in {r["lang"] for r in rows} - {None}:
        own = [r for r in rows if r["lang"] == lang and r["doc_id"] in fine]
        total, words = sum(base[r["doc_id"]][0] for r in own), Counter(w for r in own for w in r["text"].translate(joined).split())
        if total >= quality.LANGUAGE_WORDS:
            common = [w for w, n in words.items() if n >= quality.COMMON_SHARE * total]
            refs[lang] = [sum(x) for x in zip(*(classes(r["text"]) for r in own), strict=True)], common, [words[w] for w in common] + [max(0, total - sum(words[w] for w in common))]
    assert len(refs) == 4
    for r in quality.judge(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        text, lang = next((x["text"], x["lang"]) for x in rows if x["doc_id"] == r["doc_id"])
        want = r["doc_id"] in fine
        if want and lang in refs:
            n, counts, chars = base[r["doc_id"]][0], Counter(text.translate(joined).split()), classes(text)
            limit = 0.2 + 2.2 / math.sqrt(n)
            hist = lambda common: [counts[w] for w in common] + [max(0, n - sum(counts[w] for w in common))]  # noqa: E731, B023
            want = any((len(text) < 200 or far(chars, c) <= 0.28) and far(hist(common), k) <= limit for c, common, k in refs.values())
        assert r["kept"] == want, r["doc_id"]


def test_quality_edge_tables(spark):
    assert quality.judge(docs(spark, []).withColumn("kept", F.lit(1)).withColumn("nearest", F.lit("x"))).count() == 0
    twice = docs(spark, ["a"]).unionByName(docs(spark, ["a"]))
    assert quality.judge(twice).count() == 2
    table = spark.read.parquet(f"{SF}/documents.parquet").withColumn("kept", F.lit(True)).withColumn("size", F.lit(1))
    kept = quality.keep_good(table)
    assert kept.columns == table.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in quality.judge(table).where("kept").select("doc_id").collect()}


def test_documents_of_languages_without_reference_are_not_judged(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    english, french = table.where("lang = 'en'"), table.where("lang = 'fr' AND quality = 1")
    good = {r[0] for r in quality.judge(french).where("NOT base_failed").select("doc_id").collect()}
    junk = english.where("quality = 0").select("doc_id")
    rare, unknown = french.where("doc_id % 20 = 0").withColumn("lang", F.lit("fr")), french.where("doc_id % 20 <> 0").withColumn("lang", F.lit(None).cast("string"))
    for other in (rare, unknown):
        docs = english.unionByName(other)
        assert [r["lang"] for r in quality.references(docs)] == ["en"]
        want = {r[0] for r in other.select("doc_id").collect()} & good
        assert want and want <= {r[0] for r in quality.keep_good(docs).select("doc_id").collect()}
        found = quality.judge(docs)
        assert want == {r[0] for r in found.join(other.select("doc_id"), "doc_id").where("kept").select("doc_id").collect()}
        assert found.join(junk, "doc_id").where("NOT base_failed").agg(F.avg(F.col("kept").cast("int"))).first()[0] < 0.1


def test_a_small_share_of_the_corpus_is_enough_for_a_reference(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    english, french = table.where("lang = 'en'").select("lang", "text"), table.where("lang = 'fr' AND doc_id % 2 = 0").select("lang", "text")
    docs = english.unionByName(french)
    for _ in range(5):
        english = english.unionByName(english)
    many = english.unionByName(french)
    assert [r["lang"] for r in quality.references(many)] == [r["lang"] for r in quality.references(docs)] == ["en", "fr"]


def test_distance_is_a_distance():
    a, b = np.array([1.0, 2, 3]), np.array([3.0, 0, 1])
    assert quality.distance(a, a) == 0 and quality.distance(a, b) == pytest.approx(quality.distance(b, a))
    assert quality.distance(np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1.0)


def test_languages_of_held_out_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.identify(table, table.where(fold("doc_id") != 0)).join(table.select("doc_id", "lang"), "doc_id").where(fold("doc_id") == 0)
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_language_scores_against_python(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["tha", "teh", "cat"] if lang == "aa" else ["les", "tes", "chat"]) + rng.choice(["", "s", "é"]) for _ in range(12)), lang, "s", 0) for i in range(30) for lang in ("aa", "bb")]
    train = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], DOCS)
    counts = {kind: {"aa": Counter(), "bb": Counter()} for kind in (0, *langid.ORDERS)}
    for _, text, lang, *_ in rows:
        for word in text.split():
            counts[0][lang][word] += 1
            for order in langid.ORDERS:
                framed = word if order == 1 else f"^{word}$"
                counts[order][lang].update(framed[k : k + order] for k in range(len(framed) - order + 1))
    tables = {}
    for kind, by in counts.items():
        entries = {g for g in by["aa"].keys() | by["bb"].keys() if by["aa"][g] + by["bb"][g] >= langid.LEAST_COUNT}
        tables[kind] = {g: [math.log((by[x][g] + 1) / (sum(by[x].values()) + len(entries) + 1)) for x in ("aa", "bb")] for g in entries}
    words = [sum(counts[0][x].values()) + 1 for x in ("aa", "bb")]

    def score(text):
        total = [math.log(w / sum(words)) for w in words]
        for word in text.split():
            found = [tables[0][word]] if word in tables[0] else []
            for order in () if found else langid.ORDERS:
                framed = word if order == 1 else f"^{word}$"
                found = [tables[order][g] for g in (framed[k : k + order] for k in range(len(framed) - order + 1)) if g in tables[order]]
                if found:
                    break
            total = [t + (sum(f[x] for f in found) / len(found) if found else 0) for x, t in enumerate(total)]
        odds = [math.exp(t - max(total)) for t in total]
        return "ab"[odds[1] > odds[0]] * 2, max(odds) / sum(odds)

    texts = ["that", "lest chat", "tehé cats zzz", "xyz", "chatte", "q t"]
    for r in langid.identify(docs(spark, texts), train).collect():
        lang, value = score(texts[r["doc_id"]])
        assert (r["lang_pred"], r["score"]) == (lang, pytest.approx(value, rel=1e-4))


def test_language_edge_cases(spark):
    train = docs(spark, ["the cat and the dog and the bird", "the house and the tree"] * 3).unionByName(docs(spark, ["le chat et le chien et la maison"] * 5, "fr")).unionByName(docs(spark, [None, "x"], None))
    rows = langid.identify(docs(spark, [None, "", "123 !?", "the", "le chiennes", "中文", "the " * 20_000]).withColumn("score", F.lit(1)), train).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in rows[:5]] == ["und", "und", "und", "en", "fr"] and rows[6]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in rows) and rows[5]["lang_pred"] in ("en", "fr")
    assert [r["lang_pred"] for r in langid.identify(docs(spark, ["the"]), train.limit(0)).collect()] == ["und"]
    assert langid.identify(docs(spark, []), train).count() == 0


def test_predictions_ignore_labels(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    train = table.where(fold("doc_id") != 0)
    one = langid.identify(table, train).orderBy("doc_id").collect()
    assert one == langid.identify(table.withColumn("lang", F.lit("xx")), train).orderBy("doc_id").collect()


@pytest.mark.parametrize("seed", range(20))
def test_maximal_segments_against_the_definition(seed):
    """Recursively: the best segment is maximal, then those of what is left of it and right of it."""
    rng = random.Random(seed)
    n = rng.randint(1, 30)
    scores = [rng.choice([1, 2, 3]) if rng.random() < 0.35 else rng.choice([-1, -2, 0]) for _ in range(n)]

    def best(low, high):
        found = None
        for i in range(low, high):
            for j in range(i + 1, high + 1):
                s = sum(scores[i:j])
                if s > 0 and (found is None or s > found[0] or (s == found[0] and j - i < found[2] - found[1])):
                    found = (s, i, j)
        return [] if found is None else best(low, found[1]) + [found] + best(found[2], high)

    got = toxicity.maximal_segments(np.array(scores, float))
    assert sorted(s for *_, s in got) == sorted(s for s, *_ in best(0, n))
    assert all(sum(scores[a : b + 1]) == s for a, b, s in got)


def test_toxicity_against_python(spark):
    """Odds, extreme-value law and scores, each from its definition."""
    rng = random.Random(4)
    bad, good, plain = ["idiot", "stupid", "moron"], ["kind", "thanks", "lovely"], [f"w{i}" for i in range(40)]

    def text(toxic):
        words = rng.choices(plain, k=rng.randint(5, 60))
        for _ in range(rng.randint(1, 4)):
            words.insert(rng.randrange(len(words)), rng.choice(bad if toxic or rng.random() < 0.02 else good))
        return " ".join(words)

    toxic = [int(i % 4 == 0) for i in range(400)]
    texts = [text(y) for y in toxic]
    model = toxicity.fit(docs(spark, texts), spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int"))
    a, b = (Counter(w for t, y in zip(texts, toxic, strict=True) if y == want for w in set(t.split())) for want in (1, 0))
    all_a, all_b = sum(a.values()), sum(b.values())
    odds = {}
    for w in a.keys() | b.keys():
        prior, whole = 0.1 * (a[w] + b[w]), 0.1 * (all_a + all_b)
        x = math.log((a[w] + prior) / (all_a + whole - a[w] - prior)) - math.log((b[w] + prior) / (all_b + whole - b[w] - prior))
        if abs(x) >= 3 * math.sqrt(1 / (a[w] + prior) + 1 / (b[w] + prior)):
            odds[w] = x
    assert model["odds"].keys() == odds.keys() >= set(bad + good) and all(abs(model["odds"][w] - x) < 1e-9 for w, x in odds.items())
    shares = {w: b[w] / all_b for w in odds}
    law = sum(p * math.exp(model["rate"] * odds[w]) for w, p in shares.items()) + (1 - sum(shares.values())) * math.exp(model["rate"] * toxicity.DRIFT)
    assert abs(law - 1) < 1e-6

    def best_of(words):
        scores = [odds.get(w, toxicity.DRIFT) for w in words]
        return max([0.0] + [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)])

    clean = [t.split() for t, y in zip(texts, toxic, strict=True) if not y]
    assert model["factor"] == pytest.approx(len(clean) / sum(len(w) * math.exp(-model["rate"] * best_of(w)) for w in clean))
    rows = toxicity.score_toxicity(docs(spark, texts), model).orderBy("doc_id").collect()
    assert sum(r["predicted"] == y for r, y in zip(rows, toxic, strict=True)) > 0.95 * len(rows)
    for r, t in zip(rows, texts, strict=True):
        words = t.split()
        space = math.log(model["factor"] * len(words))
        assert r["best"] == pytest.approx(best_of(words))
        passages = [sum(odds.get(w, toxicity.DRIFT) for w in words[p["first"] : p["last"] + 1]) for p in r["segments"]]
        assert passages == pytest.approx([p["score"] for p in r["segments"]]) and all(model["rate"] * s - space > -math.log(0.05) for s in passages)
        evidence = sum(model["rate"] * s - space for s in passages) if passages else model["rate"] * best_of(words) - space
        assert r["evidence"] == pytest.approx(evidence)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-(min(max(evidence, -30), 60) * model["slope"] + model["shift"]))))


def test_long_clean_text_has_a_score():
    model = {"odds": {"bad": 3.0}, "rate": 1.0, "factor": 1.0, "slope": 50.0, "shift": -20.0}
    assert toxicity.scorer(model)(b"word " * 100_000)[4] == pytest.approx(0.0)


def test_toxicity_of_held_out_documents(spark):
    table, labels = spark.read.parquet(f"{TABLES}/sf0.1/documents.parquet"), spark.read.parquet(f"{TABLES}/sf0.1/labels.parquet")
    model = toxicity.fit(table.where(fold("doc_id") != 0), labels)
    found = toxicity.score_toxicity(table.where(fold("doc_id") == 0), model).join(labels, "doc_id").toPandas()
    assert (found["predicted"] == found["toxic"]).mean() > 0.97
    assert found[found["toxic"] == 0]["predicted"].mean() < 0.005


def test_toxicity_edge_cases(spark):
    texts = ["you are a stupid idiot today"] * 60 + ["what a fine day it is"] * 200
    train = docs(spark, [f"{t} {i}" for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(260)] + [(None, 1), (3, None), (999, 7)], "doc_id long, toxic int")
    model = toxicity.fit(train, labels)
    rows = toxicity.score_toxicity(docs(spark, [None, "", "STUPID idiot!", "fine day", "stupid " * 30_000]).withColumn("score", F.lit(5)), model).orderBy("doc_id").collect()
    assert all(0 <= r["score"] <= 1 for r in rows) and rows[2]["score"] > rows[3]["score"] and rows[4]["predicted"] == 1
    assert rows[0]["segments"] == [] and rows[2]["predicted"] == 1
    empty = toxicity.fit(train, labels.limit(0))
    assert {r["predicted"] for r in toxicity.score_toxicity(train, empty).collect()} == {0}
    assert toxicity.score_toxicity(train.limit(0), model).count() == 0
    assert toxicity.drop_toxic(train.withColumn("score", F.lit(1)), model).columns == [*train.columns, "score"]
