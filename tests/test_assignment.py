import hashlib
import random

import pytest

from reelquery.operators import assignment as a
from reelquery.operators import resampling as r
from reelquery.operators import review as v

RATIOS = {"train": 0.6, "val": 0.2, "test": 0.2}


def test_quotas():
    assert a.quotas(20, [0.7, 0.15, 0.15]) == [14, 3, 3] and a.quotas(10, [0.7, 0.15, 0.15]) == [7, 2, 1]
    assert a.quotas(3, [0.9, 0.05, 0.05]) == [1, 1, 1] and a.quotas(7, [0.98, 0.01, 0.01]) == [5, 1, 1]


def mark(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def test_assignment_against_all_trials(spark):
    rng = random.Random(3)
    rows = [(f"g{i}", rng.randint(0, 4), rng.randint(0, 9)) for i in range(15)]
    pos, neg = sum(x[1] for x in rows), sum(x[2] for x in rows)
    best = None
    for trial in range(60):
        order = sorted(rows, key=lambda x: mark(5, trial, x[0]))
        cut = {"train": order[:9], "val": order[9:12], "test": order[12:]}
        if all(sum(x[k] for x in own) for own in cut.values() for k in (1, 2)):
            cost = sum((sum(x[1] for x in own) / pos - RATIOS[s]) ** 2 + (sum(x[2] for x in own) / neg - RATIOS[s]) ** 2 for s, own in cut.items())
            if best is None or round(cost, 12) < best[0]:
                best = (round(cost, 12), {x[0]: s for s, own in cut.items() for x in own})
    df = spark.createDataFrame(rows, "group_id string, pos long, neg long")
    assert {x["group_id"]: x["split"] for x in a.assign_groups(df, 5, RATIOS, 60).collect()} == best[1]
    with pytest.raises(ValueError):
        a.assign_groups(df.where("pos = 0 OR group_id IN ('g1', 'g2')"), 5, RATIOS, 5)


def test_trials_of_many_groups_are_not_ranked_whole(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, rng.randint(0, 3), rng.randint(0, 3)) for i in range(1500)]  # some six a part
    pos, neg = sum(x[1] for x in rows), sum(x[2] for x in rows)
    costs = {}
    for trial in range(70):
        order = sorted(rows, key=lambda x: mark(4, trial, x[0]))
        cut = {"train": order[:900], "val": order[900:1200], "test": order[1200:]}
        cost = sum((sum(x[1] for x in own) / pos - RATIOS[s]) ** 2 + (sum(x[2] for x in own) / neg - RATIOS[s]) ** 2 for s, own in cut.items())
        costs[round(cost, 12), trial] = {x[0]: s for s, own in cut.items() for x in own}
    ranked, rank = [], a.shuffled_rank
    monkeypatch.setattr(a, "shuffled_rank", lambda df, *more: (ranked.append(df.count()), rank(df, *more))[1])
    df = spark.createDataFrame(rows, "group_id long, pos long, neg long")
    assert {x["group_id"]: x["split"] for x in a.assign_groups(df, 4, RATIOS, 70).collect()} == costs[min(costs)]
    assert ranked == [1500]


def test_stratified_assignment_pins_and_balances(spark):
    rng = random.Random(4)
    rows = [(f"g{i}", i == 2, {s: rng.randint(1, 5) for s in "ab" if rng.random() < 0.8} or {"a": 1}, {"need": i % 3}) for i in range(30)]
    df = spark.createDataFrame(rows, "group_id string, pinned boolean, strata map<string, int>, having map<string, int>")
    got = {x["group_id"]: x["split"] for x in a.assign_stratified(df, 9, RATIOS, {"need": 2}, 30).collect()}
    assert len(got) == 30 and got["g2"] == "train"
    for s in "ab":
        total = sum(x[2].get(s, 0) for x in rows)
        for split, share in RATIOS.items():
            assert abs(sum(x[2].get(s, 0) for x in rows if got[x[0]] == split) / total - share) < 0.1
    for split in ("val", "test"):
        assert sum(x[3]["need"] for x in rows if got[x[0]] == split) >= 2
    with pytest.raises(ValueError):
        a.assign_stratified(df, 9, RATIOS, {"need": 999}, 5)


def test_stratified_trials_do_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(f"g{i}", i in (3, 4), {s: rng.randint(1, 2) for s in "abc" if rng.random() < 0.7} or {"a": 1}, {}) for i in range(25)]  # few sizes: many ties
    df = spark.createDataFrame(rows, "group_id string, pinned boolean, strata map<string, int>, having map<string, int>")
    found = []
    for block in (1, 7, 64):
        monkeypatch.setattr(a, "TRIALS_AT_ONCE", block)
        found.append(sorted(tuple(x) for x in a.assign_stratified(df, 2, RATIOS, None, 15).collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) == 25


def test_ranked_examples_fill_up(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (2, 1, 0.3), (3, 0, 0.1), (4, 0, 0.95), (5, 0, 0.5)], "clip_id long, label int, score double")
    got = {(x["role"], x["turn"]): x["clip_id"] for x in v.ranked_examples(df, 0.8, 2).collect()}
    assert got == {("correct", 1): 1, ("correct", 2): 3, ("failure", 1): 2, ("failure", 2): 4}
    many = spark.createDataFrame([(i, 1, 0.1) for i in range(7)], df.schema)
    assert sum(x["role"] == "failure" for x in v.ranked_examples(many, 0.8, 2).collect()) == 7


def test_unknown_pairs_raise(spark):
    records = spark.createDataFrame([(1, "c", None, [], True, False, False, "")], "clip_id long, collection string, normalized_label string, issues array<string>, readable boolean, conflict boolean, reserved boolean, reviewed_at string")
    with pytest.raises(ValueError):
        v.review_queue(records, spark.createDataFrame([(1, 2)], "a long, b long"))
    assert v.review_queue(records, spark.createDataFrame([], "a long, b long")).first()["priority"] == "source_evidence"


def test_equal_models_differ_by_nothing(spark):
    df = spark.createDataFrame([(i, f"s{i % 5}", i % 2, (i * 7 % 20) / 20) for i in range(60)], "clip_id long, source_video_id string, label int, score double").selectExpr("*", "score AS other")
    for row in (r.paired_pr_difference(df, "clip_id", "score", "other", 10, 1).first(), r.within_source_bootstrap(df, "score", "other", 10, 1).first()):
        assert row["low"] == row["median"] == row["high"] == 0 and row["valid"] == 10
