import math
import random

import numpy as np
import pytest

from notelake.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, row string, score long"


def brute(rows):
    """The contract in plain Python; rows are (vec_id, embedding, label)."""
    kept = []
    for place, (vec_id, v, label, *_) in enumerate(rows):
        if label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        kept.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in v], place))
    out = []
    for anchor in kept:
        if anchor[0] is None or anchor[0] % 100:
            continue
        score = lambda r, a=anchor: sum(x * y for x, y in zip(a[2], r[2], strict=False))
        order = sorted((r for r in kept if r[3] != anchor[3]), key=lambda r: (-score(r), r[0] is None, r[0] or 0, r[3]))
        for p in [r for r in order if r[1] == anchor[1]][:5]:
            inside = [r for r in order if r[1] != anchor[1] and 80 * score(p) <= 100 * score(r) <= 100 * score(p)]
            out += [(anchor[0], p[0], k, n[0], score(p), score(n)) for k, n in enumerate(inside[:5], 1)]
    return out


def mined(spark, rows, **more):
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    return [tuple(r) for r in H.mine_vectors(H.relabelled(table), **more).collect()]


def same(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def vectors(n, size, labels, seed, step=1, spread=1.0):
    rnd = random.Random(seed)
    return [(step * i, [rnd.gauss(0.3, spread) for _ in range(size)], rnd.randrange(labels)) for i in range(n)]


def test_against_brute_force(spark):
    rows = vectors(700, 12, 3, 1)
    assert brute(rows)
    same(mined(spark, rows), brute(rows))


def test_blocks_of_anchors_give_the_same(spark):
    rows = vectors(300, 8, 2, 2, step=50)
    want = brute(rows)
    assert len({r[0] for r in want}) > 100
    same(mined(spark, rows, block_bytes=2_000), want)


def test_ties_repeats_and_odd_rows(spark):
    one, two = [0.5, -0.25, 1.0], [0.5, -0.25, 0.9]
    rows = [(100, one, 1), (200, one, 1), *[(i, one, 1) for i in (1, 2, 3, 4, 5, 6, 8)], *[(i, two, 2) for i in (11, 12, 13, 15, 16, 17, 18)], (12, two, 2), (100, one, 1)]
    rows += [(None, one, 1), (None, two, 3), (20, None, 1), (22, [], 1), (23, [0.1, None, 0.2], 1), (24, [0.1, float("nan"), 0.2], 1), (25, [float("inf"), 0.0, 0.0], 1), (26, one, None)]
    rows += [(300, [-1.0, 0.0, 0.0], 4), (301, [1.0, 0.0, 0.0], 4), (400, [0.0, 0.0, 0.0], 5), (401, [0.0, 0.0, 0.0], 5), (27, [1.0], 2), (28, [0.5, -0.25, 1.0, 3.0], 2), (700, [1.0, 2.0], 9), (703, [1.0, 2.0, 9.0], 0)]
    want = brute(rows)
    assert {100, 200, 400} <= {r[0] for r in want}
    same(mined(spark, rows), want)


def test_hot_vector_is_whole(spark):
    rows = [(i, [1.0, 0.5], 1 + (i % 2)) for i in range(1, 400) if i % 7] + [(100 * k, [1.0, 0.5 + k / 100], 3) for k in range(1, 5)] + [(7 * k, [1.0, 0.5], 2) for k in range(1, 40)]
    same(mined(spark, rows), brute(rows))


def test_large_components(spark):
    rows = [(vec, [x * 50_000 for x in v], label) for vec, v, label in vectors(220, 6, 2, 5)]
    same(mined(spark, rows), brute(rows))
    beyond = [(1, [1e30, 1.0], 0), (100, [1.0, 1.0], 0), (3, [1.0, 1.0], 0), (4, [1.0, 0.9], 1)]
    same(mined(spark, beyond), brute(beyond[1:]))  # its products fit no long


def test_empty_table_and_no_anchor(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1), (2, [1.0], 1)]) == []


@pytest.mark.parametrize("seed", range(5))
def test_planes_give_exact_products_and_drop_candidates(seed):
    rnd = np.random.default_rng(seed)
    anchors, q = rnd.integers(-200, 200, (7, 16)), rnd.integers(-300, 300, (500, 16))
    block, want = H.Block(np.arange(7), np.zeros(7), anchors), anchors @ q.T
    a, c, score = H.sliced(block, q, np.ones((7, 500), bool), lambda anchor, low, high: np.ones(low.shape, bool))
    assert (score == want[a, c]).all() and len(a) == 3500
    floor, looked = np.sort(want, axis=1)[:, -5], []

    def qualify(anchor, low, high):
        exact = want if low.ndim == 2 else None
        if exact is not None:
            assert (low <= exact).all() and (exact <= high).all()
        looked.append(low.size)
        return high >= floor[anchor if low.ndim == 1 else anchor]

    a, c, score = H.sliced(block, q, np.ones((7, 500), bool), qualify)
    assert (score == want[a, c]).all() and len(a) == (want >= floor[:, None]).sum()
    assert looked[-1] < looked[0] / 10
