import math
import random

import numpy as np

from notelake.llm import ordinal

SCHEMA = "doc_id long, text string, score double"


def graded(n=900, seed=3):
    rnd = random.Random(seed)
    docs, ratings, truth = [], [], {}
    for i in range(n):
        grade = rnd.randrange(3)
        good = rnd.choices([f"g{k}" for k in range(20)], k=3 * grade) + rnd.choices([f"b{k}" for k in range(20)], k=3 * (2 - grade))
        text = good + rnd.choices([f"n{k}" for k in range(100)], k=rnd.randrange(5, 30))
        rnd.shuffle(text)
        docs.append((i, " ".join(text), None))
        truth[i] = grade
        ratings.append((i, grade))
    return docs, ratings, truth


def test_expected_grades_on_held_out_documents(spark):
    docs, ratings, truth = graded()
    d = spark.createDataFrame([*docs, (5000, None, 1.0), (5001, "", None), (None, "g1 g2", None)], SCHEMA)
    r = spark.createDataFrame([*ratings, (None, 1), (3, None)], "doc_id long, stars int")
    model = ordinal.train(d, r, "stars")
    assert model.grades == [0, 1, 2] and (np.diff(model.thresholds) > 0).all()
    rows = {x.doc_id: x for x in ordinal.rate(d, model, 1).collect()}
    import zlib

    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([abs(rows[i].expected_grade - truth[i]) for i in held]) < 0.35
    assert np.mean([rows[i].selected == (truth[i] >= 1) for i in held]) > 0.9
    assert all(0 <= x.expected_grade <= 2 and 0 <= x.tail_probability <= 1 and x.selected == (x.tail_probability >= 0.5) for x in rows.values())
    assert rows[5000].expected_grade == rows[5001].expected_grade and len(rows) == len(docs) + 3


def test_chances_are_differences_of_the_link():
    model = ordinal.Model([0, 1, 2], np.zeros(ordinal.SIZE), np.array([-1.0, 2.0]))
    s = lambda x: 1 / (1 + np.exp(-x))
    assert np.allclose(model.chances(np.array([0.5])), [[s(-1.5), s(1.5) - s(-1.5), 1 - s(1.5)]])


def brute_loss(lists, y, weights, cut):
    """Mean negative log likelihood in plain Python."""
    s = lambda x: 1 / (1 + math.exp(-x))
    thresholds = [cut[0]]
    for gap in cut[1:]:
        thresholds.append(thresholds[-1] + math.exp(gap))
    total = 0.0
    for x, grade in zip(lists, y, strict=True):
        score = sum(weights[f] for f in x)
        below = [0.0, *(s(t - score) for t in thresholds), 1.0]
        total -= math.log(below[grade + 1] - below[grade])
    return total / len(lists)


def test_slopes_are_the_gradient_of_the_likelihood():
    lists, y = [[0, 1], [2], [], [1, 2], [0]], np.array([0, 2, 1, 1, 3])
    weights, cut = np.array([0.4, -0.3, 0.8]), np.array([-0.7, 0.1, -0.5])
    by_score, by_cut = ordinal.slopes(np.array([sum(weights[f] for f in x) for x in lists]), y, cut)
    got = np.append([sum(by_score[i] for i, x in enumerate(lists) if f in x) for f in range(3)], by_cut)
    for k in range(6):
        up, down = np.append(weights, cut), np.append(weights, cut)
        up[k] += 1e-6
        down[k] -= 1e-6
        assert abs((brute_loss(lists, y, up[:3], up[3:]) - brute_loss(lists, y, down[:3], down[3:])) / 2e-6 - got[k]) < 1e-6


def test_fit_comes_near_the_least_loss_found_by_brute_force(monkeypatch):
    monkeypatch.setattr(ordinal, "SIZE", 2)
    monkeypatch.setattr(ordinal, "EPOCHS", 800)
    lists, y = [[0], [1], [], [0, 1], [0], [1], [], [0]], [2, 0, 1, 1, 1, 1, 0, 2]
    model = ordinal.fit(np.array([f for x in lists for f in x], np.int32), np.array([len(x) for x in lists]), np.array(y, float))
    whole = lambda w, cut: brute_loss(lists, y, w, cut) + ordinal.DECAY / 2 * sum(v * v for v in w)
    grid, gaps = np.arange(-5, 5.01, 0.5), np.arange(-1, 2.01, 0.5)
    best = min(whole((a, b), (c, d)) for a in grid for b in grid for c in np.arange(-3, 3.01, 0.5) for d in gaps)
    cut = [model.thresholds[0], math.log(model.thresholds[1] - model.thresholds[0])]
    assert whole(model.weights, cut) <= best + 0.02


def test_repeated_ids_and_the_tail(spark):
    docs, ratings, _ = graded(300)
    d = spark.createDataFrame([*docs, (1, docs[2][1], None), (1, docs[1][1], None)], SCHEMA)
    model = ordinal.train(d, spark.createDataFrame([*ratings, (1, 2), (1, 0)], "doc_id long, stars int"), "stars")
    rows = [r for r in ordinal.rate(d, model, 1).collect() if r.doc_id in (1, 2)]
    assert len(rows) == 4 and len({r.expected_grade for r in rows}) == 2


def test_one_grade_is_constant(spark):
    d = spark.createDataFrame([(i, "a b", None) for i in range(20)], SCHEMA)
    r = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, stars int")
    assert {x.expected_grade for x in ordinal.rate(d, ordinal.train(d, r, "stars"), 1).collect()} == {1.0}
    none = ordinal.train(d.limit(0), r.limit(0), "stars")
    assert {(x.expected_grade, x.selected) for x in ordinal.rate(d, none, 1).collect()} == {(0.0, False)}
    assert ordinal.rate(d.limit(0), none, 1).count() == 0


def test_memory_of_words_changes_nothing(monkeypatch):
    text = "One two two Three! 4 | five\nOne two"
    want = set(ordinal.Features().of(text).tolist())
    monkeypatch.setattr(ordinal, "CACHE", 1)
    assert set(ordinal.Features().of(text).tolist()) == want
