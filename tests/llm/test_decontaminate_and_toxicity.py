import hashlib
import math
import random
import re
import zlib

import numpy as np

from notelake.llm import decontaminate, toxicity
from notelake.llm.fm_index import FmIndex, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - 9, 1 if w else 0)):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item) if item is not None else "null")
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[tuple(w[i : i + size])]
        names = ",".join(sorted(found))
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit))
    return out


def tables(seed=0):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["Über", "naïve", "x9"]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([3, 12, 25])))) for i in range(8)]
    items += [(100, "a"), (101, " -- "), (102, None), (8, items[0][1]), (None, "solo item here")]
    docs = [(1, None), (2, ""), (3, "a"), (4, " ".join(["w1"] * 3000)), (5, "Solo, item; HERE!")]
    for i in range(60):
        text = rnd.choices(vocabulary + ["out", "of", "it"], k=rnd.randrange(60))
        if i % 3 == 0:
            text[5:5] = (items[rnd.randrange(8)][1] or "").upper().split()
        docs.append((10 + i, ", ".join(text)))
    return docs, items


def test_suffix_array_and_search_match_brute_force():
    rnd = np.random.default_rng(1)
    text = np.concatenate([np.append(rnd.integers(1, 4, rnd.integers(1, 30)), 0) for _ in range(40)]).astype(np.int32)
    order = suffix_array(text)
    zero = iter(range(-len(text), 0))
    unique = [next(zero) if c == 0 else int(c) for c in text]
    assert order.tolist() == sorted(range(len(text)), key=lambda i: unique[i:])
    index = FmIndex(text)
    phrases = [rnd.integers(1, 6, rnd.integers(1, 5)) for _ in range(50)]
    table = np.zeros((50, 5), np.int32)
    for row, p in zip(table, phrases, strict=True):
        row[5 - len(p) :] = p
    lo, hi = index.ranges(table, np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, lo, hi, strict=True):
        want = [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def check(spark, docs, items):
    d = spark.createDataFrame([(*r, "c") for r in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, n_words int")
    found = decontaminate.contamination(d, b)
    got = {r[0]: tuple(r)[1:] for r in decontaminate.digests(found).collect()}
    assert got == brute(docs, items)
    left = decontaminate.drop_contaminated(d, b)
    assert left.columns == d.columns and sorted(map(repr, left.collect())) == sorted(repr(r) for r in d.collect() if not got[r.doc_id][4])


def test_contamination_matches_brute_force(spark):
    check(spark, *tables())


def small(monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 7)
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 90)


def test_contamination_in_small_shards_blocks_and_pieces(spark, monkeypatch):
    small(monkeypatch, 20)
    docs, items = tables(2)
    b = spark.createDataFrame(items, "item_id long, text string")
    assert len(decontaminate.blocks(b)) > 3
    check(spark, docs, items)
    monkeypatch.setattr(decontaminate, "LOCATE_ROWS", 3)
    shard = decontaminate.Shard(10**9)
    assert shard.add([t for _, t in docs], 0) == len(docs)
    want = brute(docs, items)
    for (d, _), n_words, spans, names in zip(docs, *shard.search(decontaminate.blocks(b)), strict=True):
        assert (n_words, sum(s["end"] - s["start"] for s in spans), len(names)) == want[d][:3]


def test_every_window_is_in_one_piece(monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 7)
    for n in (0, 1, 9, 10, 16, 17, 18, 40):
        words = [b"%d" % i for i in range(n)]
        frame = __import__("pandas").DataFrame({"item": ["a"], "text": [b" ".join(words).decode()]})
        pieces = [(r, bytes(w).split()) for f in decontaminate._pieces(10)(iter([frame])) for r, w in f.values]
        whole, cut = decontaminate.Windows([("a", words)]), [decontaminate.Windows([p]) for p in pieces]
        assert len(whole.phrases) == sum(len(c.phrases) for c in cut) == max(n - 9, 1 if n else 0)


def test_rows_that_share_an_id_are_judged_each_whatever_the_blocks(spark, monkeypatch):
    docs, items = tables(4)
    docs = [(i % 9 or None, t) for i, t in docs] + [(1, docs[5][1]), (1, docs[5][1]), (None, docs[8][1]), (None, docs[8][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((i, *brute([(0, t)], items)[0]) for i, t in docs), key=repr)
    for block in (None, 30):
        if block:
            small(monkeypatch, block)
        assert sorted(map(tuple, decontaminate.digests(decontaminate.contamination(d, b)).collect()), key=repr) == want


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.contamination(d.limit(0), b).count() == 0 and decontaminate.drop_contaminated(d.limit(0), b).count() == 0
    assert decontaminate.drop_contaminated(d, b.limit(0)).count() == 1
    assert [tuple(r)[:2] for r in decontaminate.contamination(d, b.limit(0)).collect()] == [(1, 2)]


def toxic_corpus(n=1500, seed=4):
    rnd = random.Random(seed)
    plain, bad = [f"p{i}" for i in range(300)], ["vile", "scorn", "gormxa", "gormyb", "gormzc"]
    docs, labels = [], []
    for i in range(n):
        toxic = rnd.random() < 0.2
        text = rnd.choices(plain, k=rnd.randrange(5, 60)) + (rnd.choices(bad, k=2) if toxic else [])
        rnd.shuffle(text)
        docs.append((i, " ".join(text), "x"))
        if rnd.random() < 0.6:
            labels.append((i, 1, int(toxic)))
    truth = {i: any(b in t for b in bad) for i, t, _ in docs}
    return docs, labels, truth


def test_toxicity_separates_held_out_documents(spark):
    docs, labels, truth = toxic_corpus()
    rows = [*docs, (9000, None, None), (9001, "", "y"), (None, "p1 p2", "z")]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lb = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(d, lb).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    held = [i for i in truth if got[i].held_out]
    assert sum(got[i].predicted == truth[i] for i in held) / len(held) > 0.97
    assert got[9000].predicted == 0 and got[9000].score == got[9001].score
    left = toxicity.drop_toxic(d, lb)
    assert left.columns == d.columns and left.count() == sum(1 - r.predicted for r in got.values())


def test_toxicity_without_labels_or_documents(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    lb = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert [tuple(r)[2:] for r in toxicity.score_documents(d, lb).collect()] == [(0.0, 0)]
    assert toxicity.score_documents(d.limit(0), lb.limit(0)).count() == 0


def brute_risk(p, u, prior, weights, intercept):
    """The risk, and its two parts, of lists of feature lists, in plain Python."""
    z = lambda x: intercept + sum(weights[f] for f in x)
    soft = lambda v: math.log1p(math.exp(v))
    positive = sum(soft(-z(x)) for x in p) / len(p)
    negative = sum(soft(z(x)) for x in u) / len(u) - prior * sum(soft(z(x)) for x in p) / len(p)
    return toxicity.SHARE * positive, (1 - toxicity.SHARE) / (1 - prior) * negative


def as_rows(lists):
    return toxicity.Rows(np.array([f for x in lists for f in x], np.int32), np.array([len(x) for x in lists]))


def test_slopes_are_the_gradient_of_the_risk_in_both_branches(monkeypatch):
    monkeypatch.setattr(toxicity, "SIZE", 6)
    monkeypatch.setattr(toxicity, "CHUNK", 3)
    p, u, prior = [[0, 1], [0], [0, 2, 5]], [[1, 3], [], [0, 4], [2, 3, 4], [3]], 0.4
    for weights, branch in ((np.array([0.3, -0.2, 0.1, -0.4, 0.2, 0.0]), 1), (np.array([9.0, 0.5, 1.0, -9.0, -9.0, 1.0]), -1)):
        rows_p, rows_u = as_rows(p), as_rows(u)
        slope_p, slope_u = toxicity.slopes(rows_p.scores(weights, -0.5), rows_u.scores(weights, -0.5), prior)
        got = np.append(rows_p.gradient(slope_p) + rows_u.gradient(slope_u), slope_p.sum() + slope_u.sum())
        positive, negative = brute_risk(p, u, prior, weights, -0.5)
        assert (negative >= 0) == (branch > 0)
        of = lambda w, b: sum(brute_risk(p, u, prior, w, b)) if branch > 0 else -brute_risk(p, u, prior, w, b)[1]
        for k in range(7):
            up, down = np.append(weights, -0.5), np.append(weights, -0.5)
            up[k] += 1e-6
            down[k] -= 1e-6
            assert abs((of(up[:6], up[6]) - of(down[:6], down[6])) / 2e-6 - got[k]) < 1e-6


def test_fit_comes_near_the_least_risk_found_by_brute_force(monkeypatch):
    monkeypatch.setattr(toxicity, "SIZE", 2)
    monkeypatch.setattr(toxicity, "EPOCHS", 600)
    p, u, prior = [[0], [0, 1], [0], [1]], [[1], [], [1], [0], [0, 1], []], 0.3
    weights, intercept = toxicity.fit(as_rows(p), as_rows(u), prior)

    def whole(w, b):
        positive, negative = brute_risk(p, u, prior, w, b)
        return positive + max(0.0, negative) + toxicity.L1 * sum(map(abs, w))

    grid = np.arange(-6, 6.01, 0.4)
    best = min(whole((x, y), intercept) for x in grid for y in grid)
    assert abs(intercept - math.log(prior / (1 - prior))) < 1e-9 and whole(weights, intercept) <= best + 0.02


def test_scores_do_not_depend_on_the_cache(spark, monkeypatch):
    weights = np.arange(toxicity.SIZE, dtype=np.float32) / toxicity.SIZE - 0.5
    d = spark.createDataFrame([(i, f"aa{i} bbbbbbb cc") for i in range(20)], "doc_id long, text string").coalesce(1)
    want = [float(toxicity.sigmoid(0.25 + weights[toxicity.text_features(f"aa{i} bbbbbbb cc")].sum())) for i in range(20)]
    monkeypatch.setattr(toxicity, "CACHE", 3)
    got = [r.s for r in d.select(toxicity.scorer(spark, (weights, 0.25))("text").alias("s")).collect()]
    assert np.allclose(got, want)
