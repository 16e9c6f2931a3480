"""Splits with reservations, imports, evidence of groups, audits, recomputed reports, scoring that survives bad rows."""

import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from reelquery.operators import audit, evidence, graph, imports, scoring, splits


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def split_of(spark, rows, seed=1):
    return {r["source"]: r["split"] for r in splits.split_sources(frame(spark, rows, "source string, category string, reserved boolean"), seed).collect()}


@pytest.mark.parametrize(("n", "want"), [(1, (1, 0, 0)), (2, (2, 0, 0)), (3, (1, 1, 1)), (4, (2, 1, 1)), (7, (5, 1, 1)), (20, (14, 3, 3)), (101, (71, 15, 15))])
def test_counts_of_a_category(spark, n, want):
    found = Counter(split_of(spark, [(f"s{i}", "a", False) for i in range(n)]).values())
    assert tuple(found[x] for x in ("train", "val", "test")) == want


def test_reserved_sources_are_test_and_cost_val_first(spark):
    rows = [(f"s{i}", "a", i < 9) for i in range(10)]
    found = split_of(spark, rows)
    assert all(found[f"s{i}"] == "test" for i in range(9)) and Counter(found.values()) == {"test": 9, "val": 1}
    assert Counter(split_of(spark, [(f"s{i}", "a", True) for i in range(4)]).values()) == {"test": 4}
    assert split_of(spark, []) == {}


def test_support_is_repaired_by_an_exchange(spark):
    schema = "source string, category string, split string, positive boolean"
    rows = [("a1", "a", "train", True), ("a2", "a", "train", True), ("a3", "a", "val", False), ("a4", "a", "val", False), ("a5", "a", "test", True)]  # swaps a1 and a3
    rows += [("b1", "b", "train", True), ("b2", "b", "val", False)]  # one donor only: train would lose its support
    rows += [("c1", "c", "train", True), ("c2", "c", "train", True), ("c3", "c", "val", True), ("c4", "c", "val", False)]  # supported
    rows += [("d1", "d", "train", True), ("d2", "d", "train", True)]  # nothing to give back
    found = splits.repair_support(frame(spark, rows, schema)).collect()
    assert {r["source"]: r["split"] for r in found if r["swapped"]} == {"a1": "val", "a3": "train"}
    assert {r["source"]: r["split"] for r in found if not r["swapped"]} == {s: x for s, _, x, _ in rows if s not in ("a1", "a3")}
    before, after = (Counter((r["category"], r["split"]) for r in x) for x in (frame(spark, rows, schema).collect(), found))
    assert before == after


CLIPS = "clip_id long, source string, category string, label int, expected_label int, sha256 string, reserved boolean"


def test_a_human_split_is_whole_or_raises(spark):
    rows = [(i, f"s{i // 3}", f"c{i // 3 % 2}", i % 2, i % 2, f"h{i}", i // 3 == 4) for i in range(60)]
    built = splits.build_human_split(frame(spark, rows, CLIPS)).collect()
    assert len(built) == 60 and len({(r["source"], r["split"]) for r in built}) == 20
    assert {r["split"] for r in built if r["source"] == "s4"} == {"test"}
    for change, kind in ((lambda r: (*r[:3], 1 - r[3], *r[4:]), "inconsistent_label"), (lambda r: (*r[:2], "c9", *r[3:]), "conflicting_category")):
        with pytest.raises(ValueError, match=kind):
            splits.build_human_split(frame(spark, [change(rows[0]), *rows[1:]], CLIPS))
    place = {r["source"]: r["split"] for r in built}
    other = next(r for r in rows if place[r[1]] != place["s0"])
    with pytest.raises(ValueError, match="content_leak"):
        splits.build_human_split(frame(spark, [(*rows[0][:5], other[5], rows[0][6]), *rows[1:]], CLIPS))
    with pytest.raises(ValueError, match="empty"):
        splits.build_human_split(frame(spark, [], CLIPS))


def test_prior_assignments_stay(spark):
    sources = frame(spark, [(f"s{i}", "a", i == 0) for i in range(10)], "source string, category string, reserved boolean")
    prior = frame(spark, [("s1", "val"), ("s2", "test"), ("s99", "val")], "source string, split string")
    found = {r["source"]: r["split"] for r in splits.with_prior(sources, prior, 3).collect()}
    assert (found["s0"], found["s1"], found["s2"]) == ("test", "val", "test") and len(found) == 10
    with pytest.raises(ValueError, match="reserved"):
        splits.with_prior(sources, frame(spark, [("s0", "val")], "source string, split string"), 3)


def test_shared_sources_are_protected(spark):
    records = frame(spark, [(i, f"s{i}", "test" if i < 2 else "train", "a") for i in range(22)], "video_id long, source string, split string, category string")
    shared = frame(spark, [("s0", "test"), ("s2", "test"), ("s3", "val"), ("s4", "train")], "source string, split string")
    rows = {r["source"]: (r["split"], r["excluded"]) for r in splits.protect_shared(records, shared, 5).collect()}
    assert [rows[f"s{i}"] for i in range(5)] == [("test", False), ("test", False), (None, True), ("val", False), ("train", False)]
    assert Counter(x for s, (x, _) in rows.items() if int(s[1:]) > 4) == {"train": 14, "val": 3}
    with pytest.raises(ValueError, match="official"):
        splits.protect_shared(records, frame(spark, [("s1", "val")], "source string, split string"), 5)


def test_equal_contents_of_different_labels_raise(spark):
    df = frame(spark, [(1, "x", "train", 0), (2, "x", "train", 1), (3, "y", "train", 1)], "clip_id long, sha256 string, split string, label int")
    with pytest.raises(ValueError, match="different labels"):
        graph.remove_training_duplicates(df, "clip_id", "sha256", "split", "label")
    assert graph.remove_training_duplicates(df.where("clip_id <> 2"), "clip_id", "sha256", "split", "label").count() == 2


STORE = "clip_id string, sha256 string, source_video_id string, split string, population string"


def outcomes(spark, store, batch):
    found = imports.import_outcomes(frame(spark, store, STORE), frame(spark, [(i, *r) for i, r in enumerate(batch)], f"seq long, {STORE}"))
    return [(r["outcome"], r["of"]) for r in found.orderBy("seq").collect()]


def sequential(store, batch):
    """Row by row, as a table with a lookup by content or id; stops at the first conflict."""
    kept, out = list(store), []
    for row in batch:
        same = [k for k in kept if k[0] == row[0] or k[1] == row[1]]
        if any(k[1] != row[1] for k in same):
            return [*out, ("identity_conflict", None)]
        if same:
            if same[0][1:] != row[1:]:
                return [*out, ("membership_conflict", None)]
            out.append(("duplicate", same[0][0]))
            continue
        if any(k[3] != row[3] or (k[4] == "evaluation") != (row[4] == "evaluation") for k in kept if k[2] == row[2]):
            return [*out, ("source_conflict", None)]
        kept.append(row)
        out.append(("new", None))
    return out


def test_import_by_id_and_content(spark):
    a = ("a", "s1", "v1", "train", "development")
    for batch, want in (
        ([("b", "s1", "v1", "test", "development")], ["membership_conflict"]),
        ([("b", "s1", "v1", "train", "development")], ["duplicate"]),
        ([("c", "s3", "v2", "train", "development"), ("d", "s4", "v2", "test", "development")], ["new", "source_conflict"]),
        ([("e", "s5", "v3", "train", "development"), ("e", "s6", "v4", "train", "development")], ["new", "identity_conflict"]),
        ([("f", "s7", "v1", "test", "development")], ["source_conflict"]),
        ([("g", "s8", "v5", "test", "evaluation"), ("h", "s9", "v5", "test", "development")], ["new", "source_conflict"]),
    ):
        assert [x for x, _ in outcomes(spark, [a], batch)] == want
        assert outcomes(spark, [a], batch) == sequential([a], batch)


def test_import_against_a_sequential_one(spark):
    rng = random.Random(2)
    for _ in range(12):
        row = lambda k: (f"c{rng.randrange(k)}", f"h{rng.randrange(k)}", f"v{rng.randrange(4)}", rng.choice(["train", "train", "train", "test"]), "development")
        base = [row(6) for _ in range(40)]
        batch = []
        for r in base:  # mostly repeats of whole rows, so that some batches go far
            batch.append(rng.choice(batch) if batch and rng.random() < 0.6 else r)
        want = sequential([], batch)
        assert outcomes(spark, [], batch)[: len(want)] == want


def test_a_batch_goes_in_whole_or_not_at_all(spark, tmp_path):
    store, schema = str(tmp_path / "store"), f"seq long, {STORE}"
    rows = lambda *r: frame(spark, [(i, *x) for i, x in enumerate(r)], schema)
    a, b = ("a", "s1", "v1", "train", "development"), ("b", "s2", "v1", "train", "development")
    assert imports.import_batch(spark, store, rows(a, b), schema, dry_run=True) == {"new": 2, "duplicate": 0}
    assert imports.read_store(spark, store, schema).count() == 0
    assert imports.import_batch(spark, store, rows(a, b), schema) == {"new": 2, "duplicate": 0}
    assert imports.import_batch(spark, store, rows(a, ("z", *b[1:])), schema) == {"new": 0, "duplicate": 2}
    with pytest.raises(imports.ImportConflict, match="clip c: source_conflict"):
        imports.import_batch(spark, store, rows(("d", "s9", "v9", "train", "development"), ("c", "s3", "v1", "test", "development")), schema)
    assert sorted(r["clip_id"] for r in imports.read_store(spark, store, schema).collect()) == ["a", "b"]
    # a batch that was written but never named is no part of the store, nor is a taken number lost
    rows(("x", "s7", "v7", "train", "development")).write.parquet(f"{store}/batch-lost")
    assert imports.read_store(spark, store, schema).count() == 2
    assert imports.claim(spark, store, 1, "batch-lost") and not imports.claim(spark, store, 1, "batch-late")
    assert imports.read_store(spark, store, schema).count() == 3


def test_uploads_of_known_content(spark):
    store = frame(spark, [("k1", "s1", "available"), ("k2", "s2", "deleted")], "clip_id string, sha256 string, status string")
    uploads = frame(spark, [(1, "t1", "s1"), (2, "t2", "s2"), (3, "t3", "s3"), (4, "t4", "s3")], "seq long, token string, sha256 string")
    found = [(r["outcome"], r["clip_id"]) for r in imports.upload_outcomes(store, uploads).orderBy("seq").collect()]
    assert found == [("duplicate", "k1"), ("refers_to_deleted", "k2"), ("new", "t3"), ("duplicate", "t3")]


def brute_forest(edges):
    near = defaultdict(set)
    for a, b, _ in edges:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for top in sorted(near):
        if top in out:
            continue
        out[top], front, depth = (top, None, 0), [top], 0
        while front:
            depth += 1
            found = {}
            for x in sorted(front):
                for y in near[x]:
                    if y not in out:
                        found.setdefault(y, x)
            out |= {y: (top, x, depth) for y, x in found.items()}
            front = list(found)
    return out


@pytest.mark.parametrize("at_once", [0, 500_000])
def test_reasons_forest_and_paths(spark, at_once):
    rng = random.Random(6)
    rows = list({(min(p), max(p), r) for p, r in (((rng.randrange(60), rng.randrange(60)), rng.choice(["name", "time", "hash"])) for _ in range(55)) if p[0] != p[1]})
    edges, nodes = frame(spark, rows, "a long, b long, reason string"), spark.range(60)
    want = brute_forest(rows)
    forest = evidence.spanning_forest(edges, at_once)
    assert {r["id"]: (r["root"], r["parent"], r["depth"]) for r in forest.collect()} == want
    said = {r["id"]: (r["root"], r["reasons"]) for r in evidence.group_reasons(nodes, edges).collect()}
    assert said == {i: (want[i][0] if i in want else i, sorted({r for a, b, r in rows if i in (a, b)})) for i in range(60)}
    asked = [(x, y) for x in range(0, 60, 7) for y in range(60)]
    found = defaultdict(set)
    for r in evidence.paths(frame(spark, asked, "x long, y long"), forest, edges).collect():
        found[r["x"], r["y"]].add((r["a"], r["b"], tuple(r["reasons"])))
    for x, y in asked:
        if x == y or x not in want or y not in want or want[x][0] != want[y][0]:
            assert (x, y) not in found
            continue
        up = lambda i: [i] if want[i][1] is None else [i, *up(want[i][1])]
        only = set(up(x)) ^ set(up(y))
        links = {(min(i, want[i][1]), max(i, want[i][1])) for i in only}
        assert found[x, y] == {(a, b, tuple(sorted(r for c, d, r in rows if (c, d) == (a, b)))) for a, b in links}


def test_labelled_edges(spark):
    pairs = frame(spark, [(2, 1), (1, 2), (3, 3)], "a long, b long")
    why = frame(spark, [(4, 1, "x")], "a long, b long, reason string")
    assert sorted(map(tuple, evidence.labelled_edges(("time", pairs), ("name", why)).collect())) == [(1, 2, "time"), (1, 4, "name:x")]


def test_more_agreeing_bands_find_the_same_pairs(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) - (1 << 63) for _ in range(60)]
    turned = []
    for h in base:
        for bit in rng.sample(range(64), rng.randint(0, 12)):
            h ^= (1 << bit) if bit < 63 else -(1 << 63)
        turned.append(h)
    left, right = (frame(spark, list(enumerate(x)), "id long, h long") for x in (base, turned))
    want = sorted((i, j, d) for i, x in enumerate(base) for j, y in enumerate(turned) if (d := ((x ^ y) & (2**64 - 1)).bit_count()) <= 8)
    for agreeing in (1, 2, 3):
        assert sorted(map(tuple, graph.hamming_pairs(left, right, 8, 64, agreeing).collect())) == want
    assert len(want) > 20


def test_views_are_reconciled(spark):
    views = {
        "catalog": frame(spark, [(1, "p", "en"), (2, "q", "de"), (3, "r", None)], "id long, path string, lang string"),
        "labels": frame(spark, [(1, "en"), (2, "fr"), (4, "en"), (4, "en")], "id long, lang string"),
        "media": frame(spark, [(1, "p"), (3, "other")], "id long, path string"),
    }
    found = {r["id"]: r for r in audit.reconcile_views(views, "id").collect()}
    assert [(found[i]["present"], found[i]["missing"]) for i in (1, 4)] == [(["catalog", "labels", "media"], []), (["labels"], ["catalog", "media"])]
    assert {i: r["conflicts"] for i, r in found.items()} == {1: [], 2: ["lang:catalog~labels"], 3: ["path:catalog~media"], 4: []}
    assert found[4]["repeated"] == ["labels"]
    counts = {r["kind"]: r["n"] for r in audit.audit_counts(audit.reconcile_views(views, "id"), {"labels": ["catalog", "media"], "media": ["labels"]}).collect()}
    assert counts == {"orphan:labels>catalog": 1, "orphan:labels>media": 2, "orphan:media>labels": 1, "repeated:labels": 1, "conflict:lang:catalog~labels": 1, "conflict:path:catalog~media": 1}


def test_reports_are_compared_value_by_value(spark):
    saved = {"a": {"n": 3, "rate": 0.5, "none": None}, "list": [1, {"x": "y"}, []], "gone": True}
    again = {"a": {"n": 3, "rate": 0.500001, "none": None}, "list": [1, {"x": "z"}], "new": False}
    df = lambda x: frame(spark, [("r", json.dumps(x))], "run string, report string")
    assert {(r["path"], r["saved"], r["computed"]) for r in audit.compare_reports(df(saved), df(again), "run", "report").collect()} == {("list[1].x", "y", "z"), ("gone", "true", None), ("new", None, "false")}
    audit.require_reproduced(df(saved), df(saved), "run", "report")
    with pytest.raises(ValueError, match="rate"):
        audit.require_reproduced(df({"rate": 0.5}), df({"rate": 0.6}), "run", "report")
    deep = 1
    for _ in range(20):
        deep = [deep]
    with pytest.raises(Exception, match="nested too deeply"):
        audit.flattened(df(deep), "run", "report").collect()


def test_bad_rows_stay_with_their_error(spark):
    def score(row):
        if row["id"] % 3 == 0:
            raise ValueError(f"poison {row['id']}")
        return {"half": row["id"] / 2}

    df = spark.range(10)
    found = {r["id"]: r for r in scoring.score_rows(df, score, "half double", tries=3).collect()}
    assert {i: (r["half"], r["error"], r["attempts"]) for i, r in found.items()} == {i: (None, f"ValueError: poison {i}", 3) if i % 3 == 0 else (i / 2, None, 1) for i in range(10)}
    report = scoring.batch_report(scoring.score_rows(df, score, "half double")).first()
    assert tuple(report) == (10, 4, False)
    assert tuple(scoring.batch_report(scoring.score_rows(df.where("id = 3"), score, "half double")).first()) == (1, 1, True)
    assert tuple(scoring.batch_report(scoring.score_rows(df.limit(0), score, "half double")).first()) == (0, 0, False)


def test_a_batch_that_comes_again_counts_once(spark, tmp_path):
    commit = scoring.commit_once(str(tmp_path / "out"))
    for number, n in ((0, 5), (1, 3), (1, 3), (0, 5)):
        commit(spark.range(n), number)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("batch").count().orderBy("batch").collect() == [(0, 5), (1, 3)]


def test_states_after_a_round(spark):
    items = frame(spark, [("running", 1, None), ("running", 1, "E"), ("running", 3, "E"), ("queued", 0, None), ("cancelled", 1, "E")], "status string, attempts int, error string")
    assert [r["status"] for r in scoring.next_states(items, 2).collect()] == ["completed", "queued", "failed", "queued", "cancelled"]
