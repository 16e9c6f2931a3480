"""Exact top-k search, near-duplicate groups, licence scans and the pipeline."""

import hashlib
import random
import textwrap
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from reelquery.llm import licenses, topk
from reelquery.llm import shinglejoin as j

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_top(rows, k=5):
    """Row by row: how often each (query id, its best) comes."""
    kept = [(i, [float(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for at, (q, own) in enumerate(kept):
        if q % 50 == 0:
            scores = sorted((-int(np.dot(own, v)), i) for other, (i, v) in enumerate(kept) if other != at and len(v) == len(own))
            if scores:
                out[q, tuple((i, -s) for s, i in scores[:k])] += 1
    return out


def found_top(df):
    """The same of top_k: rows of equal queries can be dealt to them in any order."""
    ranks = {}
    for r in topk.top_k(df.where("vec_id % 50 = 0"), df).collect():
        ranks.setdefault(r["query_id"], {}).setdefault(r["rank"], []).append((r["vec_id"], r["score"]))
    return ranks


def assert_top(df, rows):
    want = {}
    for (q, best), times in brute_top(rows).items():
        for rank, hit in enumerate(best, 1):
            want.setdefault(q, {}).setdefault(rank, []).extend([hit] * times)
    found = found_top(df)
    assert {q: {k: sorted(v) for k, v in x.items()} for q, x in found.items()} == {q: {k: sorted(v) for k, v in x.items()} for q, x in want.items()}


@pytest.mark.parametrize("n", [3, 700])
def test_top_k_against_all_pairs(spark, n):
    rng = random.Random(n)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, rng.random()]) for _ in range(6)]) for i in range(n)]
    rows += [(900, None), (950, []), (1_000, [float("nan")] * 6), (1_001, [float("inf")] * 6), (1_050, [None] * 6), (None, [1.0] * 6), (50, [0.0] * 6), (1_100, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).withColumns({name: F.lit(1) for name in ("id", "shard", "times", "number")})
    assert_top(df, rows)


def test_top_k_takes_every_row_of_repeated_ids(spark):
    rows = [(0, [2.0, 0.0]), (1, [1.0, 0.0]), (1, [1.5, 0.0]), (2, [0.75, 0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    assert [(r["vec_id"], r["score"]) for r in topk.top_k(df.where("vec_id = 0"), df).orderBy("rank").collect()] == [(1, 196_608), (1, 131_072), (2, 98_304)]
    rng = random.Random(5)
    rows = [(rng.randrange(0, 120, 10), [rng.choice([0.0, 0.5, 1.0]) for _ in range(3)]) for _ in range(150)] + [(100, [1.0, 1.0, 1.0])] * 80
    assert_top(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS), rows)


def test_top_k_merges_many_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_BYTES", 4 * 8 * 3)
    rng = random.Random(9)
    rows = [(i, [rng.random() for _ in range(3)]) for i in range(400)] + [(50, [0.9, 0.9, 0.9])] * 3
    assert_top(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS), rows)


def test_top_k_of_huge_components_and_nothing(spark):
    df = spark.createDataFrame([(0, [1e30], 0), (1, [1e30], 0), (2, [-1e30], 0)], VECTORS)
    assert [r["vec_id"] for r in topk.top_k(df.where("vec_id = 0"), df).orderBy("rank").collect()] == [1, 2]
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def brute_groups(rows):
    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, words, share):
    return [f"e{rng.random()}" if rng.random() < share else w for w in words]


@pytest.mark.parametrize("seed", range(3))
def test_groups_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows, passage = [], [f"p{k}" for k in range(60)]
    for _ in range(12):
        base = [rng.choice("abcdefghij") + str(rng.randint(0, 300)) for _ in range(rng.randint(5, 120))]
        rows += [" ".join(edited(rng, base, rng.choice([0, 0.01, 0.03, 0.05]))) for _ in range(rng.choice([1, 2, 40]))]
    rows += [" ".join([*passage, *(str(rng.random()) for _ in range(rng.randint(0, 60)))]) for _ in range(40)]
    rows += [None, "", " ", "one", "ONE", "one two", "one two three four", "one two three four five", "É a b c d", "é a b c d"]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("key", F.lit(1)).repartition(5)
    want = brute_groups(rows)
    for settings in ({}, {"hot": -(10**9)}):  # as usual, and with every shingle dealt by the set
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in j.near_duplicates(df, **settings).collect()} == want


def test_group_edge_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (3, "x" * 100_000)], "doc_id long, text string")
    rows = sorted(((r["doc_id"] or -1), r["component_id"]) for r in j.near_duplicates(df).collect())
    assert rows == [(-1, None), (1, 1), (1, 1), (2, 1), (3, 3)]
    assert j.near_duplicates(df.limit(0)).count() == 0 and j.keep_one(df.limit(0)).count() == 0
    kept = j.keep_one(df.withColumn("label", F.lit(0)))
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 3] and kept.columns == ["doc_id", "text", "label"]


def test_one_text_of_a_repeated_id_stays(spark):
    rows = [(5, "b b b b b b", 1), (5, "a a a a a a", 2), (5, "a a a a a a", 1), (3, "b b b b b b", 1), (4, None, 1), (4, "z", 1), (None, None, 1), (None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label long").withColumn("m", F.create_map(F.lit("x"), F.col("label")))
    for parts in (1, 3):
        kept = j.keep_one(df.repartition(parts))
        assert kept.columns == df.columns
        assert sorted((r["doc_id"] or 0, r["text"] or "", r["label"]) for r in kept.collect()) == [(0, "", 1), (0, "", 1), (3, "b b b b b b", 1), (4, "", 1), (5, "a a a a a a", 1)]


def test_bounds_never_cut_off_a_link():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n, extra = int(rng.integers(1, 400)), int(rng.integers(0, 100))
        a = set(rng.integers(0, 10**9, n).tolist())
        b = set(list(a)[: rng.integers(1, n + 1)]) | set(rng.integers(0, 10**9, extra).tolist())
        if 100 * len(a & b) < 80 * len(a | b):
            continue
        vec = lambda s: np.bincount([x % j.GROUPS for x in s], minlength=j.GROUPS)
        assert np.minimum(vec(a), vec(b)).sum() >= j.needed(len(a), len(b))
        assert set(sorted(a)[: j.indexed(len(a))]) & set(sorted(b)[: j.indexed(len(b))])


def found_in(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append((r["family"], r["paragraph"], r["confirmed"]))
    return [out.get(i, []) for i in range(len(texts))]


#: Wordings and sentences that no example is made of.
UNSEEN_WORDINGS = ["Copyright 2021 Jane Doe, licensed under the terms of the {}.", "The library is now released under {} (see COPYING)", "Users get the software under the {}.", "This file may be distributed under the {}, at your choice."]
UNSEEN_OTHERS = ["His hunting license had expired.", "The committee released a statement under pressure.", "The general public was not informed.", "Lions live on the public land of the reserve.", "He is free to leave.", "Terms and conditions were discussed.",
    "Two versions of the program exist.", "It is subject to approval by the board.", "She bought the software in 2019.", "All of them were right.", "La licencia de conducir no es válida.", "Der Führerschein wurde ihm entzogen.", "an academic paper about Mozilla Firefox", "an MIT professor of physics"]


def test_unseen_wordings_by_family(spark):
    seen = {text for _, text, _ in licenses.examples() + licenses.calibration_examples()}
    lines = [(family, w.format(name)) for family, names in licenses.given.NAMES.items() for name in names for w in UNSEEN_WORDINGS] + [(None, x) for x in UNSEEN_OTHERS]
    assert not seen & {text for _, text in lines}
    got = [x[0][0] if x else None for x in found_in(spark, [text for _, text in lines])]
    assert got[-len(UNSEEN_OTHERS):] == [None] * len(UNSEEN_OTHERS)
    for family in licenses.given.NAMES:
        said = [truth for (truth, _), x in zip(lines, got, strict=True) if x == family]
        has = [x for (truth, _), x in zip(lines, got, strict=True) if truth == family]
        assert said.count(family) / len(said) >= 0.9 and has.count(family) / len(has) >= 0.75, family


def test_unseen_licences_are_unknown(spark):
    names = ["Artistic License 2.0", "CeCILL licence", "Sleepycat License", "Nethack General License", "Python License 2.0"]
    got = found_in(spark, [f"Licensed under the {name}." for name in names] + [f"Copyright 2021 Jane Doe, licensed under the terms of the {name}." for name in names])
    assert sum(map(bool, got)) <= 2


@pytest.mark.parametrize(("line", "families"), [
    ("Licensed under MIT", ["mit"]), ("Dual licensed under MIT or Apache-2.0", ["mit", "apache"]), ("Distributed under GPL-2.0-only", ["gpl"]), ("licensed LGPL 2.1 or later", ["lgpl"]),
    ("Licensed under the EUPL, version 1.2.", ["eupl"]), ("distributed under the ISC license", ["isc"]), ("The Unlicense: this is free and unencumbered software released into the public domain.", ["public-domain"]),
    ("foo bar Released under the MIT license, see below", ["mit"]), ("Available under CC BY-SA 4.0.", ["cc-by"]), ("Available under CC BY-NC-SA 4.0 for non-commercial use.", ["cc-by-nc"]),
])
def test_short_forms(spark, line, families):
    got = found_in(spark, [f"some words\n{line}\nmore"])[0]
    assert len(got) == 1 and got[0][0] in families and got[0][1:] == (1, True)


#: Lines that no example is made of: what grants a licence, and what only speaks of one.
GRANTS = {"This code is MIT licensed": "mit", "MIT licence applies.": "mit", "Lizenziert unter der MIT-Lizenz.": "mit", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.2.": "gfdl"}
SPEAKS = ("The zlib compression level is 6.", "GPL is a bad idea, some people say.", "The Apache helicopter flew over the village.", "BSD sockets are old.", "We use Apache Kafka and zlib.", "Eclipse is an IDE", "The Apache License is popular among companies.")


def test_names_alone_confirm_nothing(spark):
    seen = {text for _, text, _ in licenses.examples() + licenses.calibration_examples()}
    assert not seen & {*GRANTS, *SPEAKS}
    got = found_in(spark, [*GRANTS, *SPEAKS])
    assert got[: len(GRANTS)] == [[(family, 0, True)] for family in GRANTS.values()]
    assert not any(confirmed for x in got[len(GRANTS) :] for _, _, confirmed in x)


def test_template_overturns_a_prediction(spark):
    text = "GPL GPL-3.0 GPLv3 free software: GNU Lesser General Public License, published by the Free Software Foundation"
    assert [x[0] for x in found_in(spark, [text])[0]] == ["lgpl"]


def test_scan_against_python(spark):
    """Probabilities from the fitted weights, added up in Python."""
    texts = [w.format(n) for w in UNSEEN_WORDINGS for n in ("MIT", "GPLv3", "CC BY 4.0")] + UNSEEN_OTHERS
    model = licenses.train(spark)
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").withColumn("words", licenses.tokens(F.col("text")))
    weights, shift, at = model.regression.coefficientMatrix.toArray(), model.regression.interceptVector.toArray(), {g: i for i, g in enumerate(model.counter.vocabulary)}
    for r in licenses.scored(df, model).collect():
        grams = {" ".join(r["words"][i : i + n]) for n in range(1, licenses.NGRAM + 1) for i in range(len(r["words"]) - n + 1)}
        z = shift + sum(weights[:, at[g]] for g in grams if g in at)
        known, unknown = z[:-1], z[-1]
        p = 1 / np.exp(known - known.max()).sum() / (1 + np.exp(-((known.max() - unknown) * model.slope + model.shift)))
        assert r["family"] == licenses.FAMILIES[int(known.argmax())] and abs(r["probability"] - p) < 1e-9


def test_license_edge_cases(spark):
    mine = "All rights reserved."
    df = spark.createDataFrame([(50, None), (51, ""), (52, "word " * 30_000 + f"\n{mine}"), (None, mine), (0, mine), (0, mine), (1, f"\x01a\x02\n\n{mine}\r\n")], "doc_id long, text string").withColumn("family", F.lit("x"))
    found = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["paragraph"], r["family"]) for r in licenses.scan(df).collect())
    assert found == [(-1, 0, "proprietary"), (0, 0, "proprietary"), (0, 0, "proprietary"), (1, 2, "proprietary"), (52, 1, "proprietary")]
    assert licenses.scan(df.limit(0)).count() == 0


def test_all_license_lines_of_the_table_are_found(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    line = r"(?m)^(Licensed under|Released under|This work is licensed|All rights reserved)"
    want = df.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(line)).count()
    assert licenses.scan(df).where("confirmed").count() == want


def test_texts_are_found_whole_and_wrapped(spark):
    whole = [(family, text) for family, texts in licenses.given.TEXTS.items() for text in texts if len(text.split()) > 14]
    shapes = [lambda t: (t, 0), lambda t: (textwrap.fill(t, 72, break_on_hyphens=False), 0), lambda t: ("Title\n\n" + textwrap.fill(t, 50, initial_indent="# ", subsequent_indent="# ", break_on_hyphens=False) + "\n\nsome words\nmore", 2)]
    made = [(family, *shape(text)) for family, text in whole for shape in shapes]
    got = found_in(spark, [text for _, text, _ in made])
    right = [x == [(family, line, True)] for x, (family, _, line) in zip(got, made, strict=True)]
    assert sum(right) >= 0.9 * len(right), [(m, x) for m, x, ok in zip(made, got, right, strict=True) if not ok]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in p.STAGES:
        stage(spark, before, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != p.STAGES[-1][0]:
            assert after.columns == columns
            assert after.select("doc_id").exceptAll(before.select("doc_id")).count() == 0 or name == "mixing"
        if name == "near_duplicates":
            rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
            assert {r[0] for r in after.select("doc_id").collect()} == {root for _, root in brute_groups(rows).values()}
        before = after
    assert before.agg(F.sum("length")).first()[0] > 0


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """Null and repeated ids, null, empty, short and very long texts, null sources, extra columns with clashing names, no rows."""
    import corpus_pipeline as p

    good = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars BETWEEN 600 AND 3000").limit(40)
    odd = [(None, None, None, None, 0), (None, "", "en", "s", 0), (1, None, "xx", None, 0), (2, " ", None, "s", 1), (3, "word " * 30_000, "en", "s", 1), (3, "other text", "en", "t", 1), (3, "other text", "en", "t", 1), (None, "the same text without an id", "en", "s", 1)]
    docs = good.unionByName(spark.createDataFrame(odd, good.schema)).unionByName(good.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    extra = ("row", "size", "label", "kept", "key", "n", "id", "score", "_row_of_mix", "_row_0", "_row_1", "length", "h")
    docs = docs.withColumns({name: F.lit(i) for i, name in enumerate(extra)})
    for name, stage in p.STAGES:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            assert set(out.columns) >= {"doc_id", "piece", "sequence_id", "offset"} and out.where("piece = 0").count() == docs.count()
        else:
            assert out.columns == docs.columns
            if name != "mixing":
                assert out.exceptAll(docs).count() == 0
        if name == "near_duplicates":
            assert out.where("doc_id = 3").count() == 1 and out.where("doc_id IS NULL").count() == docs.where("doc_id IS NULL").count()
        if name == "quality":
            assert out.where("text IS NULL").count() == 0


def naive_copies(rows):
    """How often each row (doc_id, source, words) is kept by the mix: its source's stream in the order of md5, cut at the target."""
    sizes = Counter()
    for _, source, n in rows:
        sizes[source] += n
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight, level = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 0.0
    low, high = 0.0, 1e12
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * sizes[s], level * weight[s]) for s in order) < 1.5 * sum(sizes.values()) else (low, level)
    kept = Counter()
    for s in order:
        words, start = min(round(min(2 * sizes[s], high * weight[s])), 2 * sizes[s]), 0
        for doc_id, _, n in sorted((r for r in rows if r[1] == s), key=lambda r: hashlib.md5(f"7:{r[0]}".encode()).hexdigest()):
            if n == 0:
                kept[doc_id] += 1
                continue
            for turn in range(2):
                taken = max(0, min(start + n, words - turn * sizes[s]) - start)
                kept[doc_id] += 2 * taken >= n
            start += n
    return kept


def test_pipeline_stages_against_brute_force(spark):
    """Each stage's decisions on documents: the quality and toxicity verdicts that are tested against Python elsewhere, copies of
    the mix from its definition, and pieces from the tokenizer itself."""
    import corpus_pipeline as p
    import public_tokenizers
    from tokenizers import Tokenizer

    from reelquery.llm.common import fold
    from reelquery.llm.quality import judge
    from reelquery.llm.toxicity import fit, score_toxicity

    docs, stage = spark.read.parquet(f"{SF}/documents.parquet"), dict(p.STAGES)
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert ids(stage["quality"](spark, docs, SF)) == ids(judge(docs.select("doc_id", "lang", "text")).where("kept"))
    model = fit(docs.where(fold("doc_id") != 0), spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"))
    assert ids(stage["toxicity"](spark, docs, SF)) == ids(score_toxicity(docs.select("doc_id", "text"), model).where("predicted = 0"))
    rows = [(r["doc_id"], r["source"], len((r["text"] or "").split(" ")) and len((r["text"] or "").encode().split())) for r in docs.select("doc_id", "source", "text").collect()]
    assert Counter(ids(stage["mixing"](spark, docs, SF))) == +naive_copies(rows)
    few = docs.where("doc_id % 10 = 1")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r["doc_id"]: len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in few.collect()}
    pieces = stage["packing"](spark, few, SF).collect()
    held, seats = Counter(), {}
    for r in pieces:
        held[r["doc_id"]] += r["length"]
        seats.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert held == want and len(seats) <= sum(want.values()) / 2048 * 1.02 + 1
    for own in seats.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
