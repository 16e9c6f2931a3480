"""Links of rows that follow each other in time, and of clips with like frames."""

import random

import numpy as np
import pytest

from reelquery.operators import graph as g


@pytest.mark.parametrize("chunk", [0.25, 10.0, 1e9])
def test_adjacent_links_do_not_depend_on_chunks(spark, chunk):
    rng = random.Random(1)
    rows = [(i, rng.choice([rng.randint(0, 400), None, 77]), rng.choice(["x", "y", None])) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, t long, c string").selectExpr("id", "timestamp_seconds(t) AS t", "c")
    order = sorted((t, i, c) for i, t, c in rows if t is not None)
    want = [(a[1], b[1], float(b[0] - a[0])) for a, b in zip(order, order[1:]) if a[2] and a[2] == b[2] and b[0] - a[0] <= 3]
    got = g.adjacent_links(df, "id", "t", "c", 3.0, chunk_seconds=chunk)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert g.adjacent_links(df.limit(0), "id", "t", "c", 3.0).count() == 0


def patterns(rng, n):
    """Patterns around a few centers, some of them equal, and random ones."""
    centers = [rng.getrandbits(62) for _ in range(5)]
    turned = lambda x, k: x ^ sum(1 << i for i in rng.sample(range(62), k))
    return [rng.getrandbits(62) if rng.random() < 0.3 else turned(rng.choice(centers), rng.choice([0, 0, 2, 4, 6])) for _ in range(n)]


@pytest.mark.parametrize("at_once", [1, 50, 10**6])
@pytest.mark.parametrize("like", [0.0, 1.0])
def test_near_patterns_come_once(monkeypatch, like, at_once):
    """Both with bands alone and where so many are alike that the rest is compared without them."""
    rng = random.Random(9)
    make = lambda n: np.array([h if rng.random() < like else rng.getrandbits(62) for h in patterns(rng, n)], np.uint64)
    a, b = make(90), make(70)
    b[:10] = a[:10] ^ np.uint64(0b1011001101011)
    monkeypatch.setattr(g, "PAIRS_AT_ONCE", at_once)
    found = [(int(x), int(y)) for i, j in g.near_patterns(a, b, 8, g.band_masks(8, 62, 2)) for x, y in zip(i, j, strict=True)]
    assert sorted(found) == [(i, j) for i in range(90) for j in range(70) if int(a[i] ^ b[j]).bit_count() <= 8] and found


@pytest.mark.parametrize("block", [3, 40, 262_144])
def test_frame_matches_do_not_depend_on_blocks(spark, monkeypatch, block):
    rng = random.Random(10)
    rows = [(rng.randint(0, 60), i % 7, h) for i, h in enumerate(patterns(rng, 200))] + [(None, 0, 5), (61, 0, None)]
    want = {}
    for x, f, h in rows:
        for y, k, o in rows:
            if None not in (x, y, h, o) and x < y and (h ^ o).bit_count() <= 8:
                want.setdefault((x, y), []).append((f, k))
    monkeypatch.setattr(g, "BLOCK", block)
    df = g.frame_matches(spark.createDataFrame(rows, "clip_id long, frame int, h long"), 8, 62, agreeing=2)
    assert {tuple(r) for r in df.collect()} == {(*ab, len(own), len({f for f, _ in own}), len({k for _, k in own})) for ab, own in want.items()}
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    assert g.frame_matches(df.selectExpr("a AS clip_id", "CAST(b AS INT) AS frame", "a AS h").limit(0), 8).count() == 0
