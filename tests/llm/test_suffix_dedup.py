import random
from collections import Counter

import numpy as np

from notelake.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, spans string, row int"


def brute(rows, size=None):
    size = size or sd.PASSAGE
    words = [(t or "").encode().lower().split() for _, t, *_ in rows]
    counts = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (doc, *_), w in zip(rows, words, strict=True):
        hit = set()
        for i in range(len(w) - size + 1):
            if counts[tuple(w[i : i + size])] > 1:
                hit |= set(range(i, i + size))
        out.append((doc, len(w), len(hit), tuple(sorted(hit))))
    return sorted(out, key=repr)


def words_of(spans):
    return tuple(sorted({i for s in spans for i in range(s["start"], s["end"])}))


def corpus(seed=1):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: rnd.choices(vocabulary, k=n)
    passages = [text(n) for n in (49, 50, 51, 60, 130)]
    rows = []
    for i in range(40):
        body = text(rnd.choice([0, 10, 49, 80, 200]))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            p = rnd.choice(passages)
            cut = rnd.choice([0, 0, 3])
            at = rnd.randrange(len(body) + 1)
            body[at:at] = p[cut:]
        rows.append((i, " ".join(body).upper() if i % 7 == 0 else "\n".join(body), "x", 1))
    near = text(150)
    for i in range(12):
        own = list(near)
        own[rnd.randrange(150)] = f"z{i}"
        rows.append((100 + i, " ".join(own), "", 0))
    copy = " ".join(text(70))
    rows += [(200, copy, "", 0), (201, copy, "", 0), (200, copy, "", 0), (202, None, None, None), (203, "", "", 0), (204, "a " * 300, "", 0), (205, " ".join(passages[4] * 2), "", 0), (206, "short copy", "", 0), (207, "short copy", "", 0), (None, " ".join(passages[3]), "", 0)]
    return rows


def check(spark, rows):
    found = sd.repeated_passages(spark.createDataFrame(rows, SCHEMA))
    got = sorted(((r.doc_id, r.n_words, len(words_of(r.spans)), words_of(r.spans)) for r in found.collect()), key=repr)
    assert got == brute(rows)
    return found


def test_repeats_match_brute_force(spark):
    found = check(spark, corpus())
    assert all(r.n_repeated == 0 or r.n_spans > 0 for r in sd.summary(found).collect())


def test_common_grams_are_spread_and_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(sd, "GROUP", 3)
    check(spark, corpus(2))


def test_empty_table(spark):
    assert sd.repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_windows_keep_equal_places():
    rng = np.random.default_rng(5)
    shared = rng.integers(0, 1 << 63, 90).astype(np.uint64)
    a = np.concatenate((rng.integers(0, 1 << 63, 33).astype(np.uint64), shared, rng.integers(0, 1 << 63, 70).astype(np.uint64)))
    b = np.concatenate((rng.integers(0, 1 << 63, 7).astype(np.uint64), shared))
    for words, offset in ((a, 33), (b, 7)):
        at, gram, first, last = sd.suffixes(words)
        owner = {s: (p - offset, int(g)) for p, g, f, e in zip(at, gram, first, last, strict=True) for s in range(f, e + 1)}
        places = [owner[offset + i] for i in range(90 - sd.PASSAGE + 1)]
        if offset == 33:
            want = places
    assert places == want and set(owner) == set(range(len(b) - sd.PASSAGE + 1))
    assert len(at) < len(b) / 3


def test_compare_against_pairs():
    rng = np.random.default_rng(6)
    n = 60
    table = rng.integers(1, 3, (n, 2 * sd.REACH)).astype(">u4")
    table[:, 3 : sd.REACH - 2] = 1
    table[:, sd.REACH + 2 :] = 1
    gram, count = rng.integers(0, 3, n), np.ones(n)
    bits = sd.compare(gram, [r.tobytes() for r in table], count)
    for x in range(n):
        want = 0
        for o in range(sd.REACH + 1):
            r = sd.PASSAGE - o - sd.GRAM
            same = [y for y in range(n) if y != x and gram[y] == gram[x] and (table[y, :r] == table[x, :r]).all() and (table[y, sd.REACH : sd.REACH + o] == table[x, sd.REACH : sd.REACH + o]).all()]
            want |= bool(same) << o
        assert int(bits[x]) == want
