"""Two-level scans, tempo maps and merge training on blocks, against plain Python."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from notelake.operators import pairs, remi, scan, tempo


def test_running_values_in_two_levels(spark):
    rnd = random.Random(1)
    rows = [(k, i, rnd.choice([None, rnd.randrange(-5, 9)])) for k in (None, 1, 2) for i in range(rnd.randrange(1, 70))]
    df = spark.createDataFrame(rows, "k int, i int, v int")
    for width in (1, 7, 1000):
        got = scan.running(df, "k", F.floor(F.col("i") / width), ["i"], s=("sum", F.col("v")), m=("max", F.col("v")), n=("count", F.col("v")), last=("last", F.col("v"))).collect()
        assert len(got) == len(rows)
        for r in got:
            own = [v for k, i, v in rows if k == r.k and i <= r.i and v is not None]
            assert (r.s, r.m, r.n, r.last) == ((sum(own), max(own), len(own), own[-1]) if own else (None, None, 0, None))


def test_a_hot_key_is_spread_over_tasks(spark):
    df = spark.range(40_000).selectExpr("7L AS k", "id AS i", "1 AS v")
    plan = scan.running(df, "k", F.floor(F.col("i") / 500), ["i"], s=("sum", F.col("v")))
    small = "spark.sql.adaptive.coalescePartitions.enabled"  # else so few rows go to one task
    spark.conf.set(small, False)
    try:
        sizes = plan.withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.count("*").alias("n"), F.max("s").alias("top")).collect()
    finally:
        spark.conf.unset(small)
    assert len(sizes) > 1 and max(r.top for r in sizes) == 40_000


def ticks_of(changes, seconds):
    """The map walked change by change."""
    at, tick, bpm = 0.0, 0.0, 120.0
    for s, b in changes:
        if s > seconds:
            break
        tick, at, bpm = tick + (s - at) * bpm * 220 / 60, s, b
    return tick + (seconds - at) * bpm * 220 / 60


def test_tempo_map_both_ways(spark):
    rnd = random.Random(3)
    changes = {p: sorted({round(rnd.random() * 60, 3): float(rnd.randrange(40, 200)) for _ in range(n)}.items()) for p, n in ((1, 0), (2, 1), (3, 12))}
    changes[3] = [(0.0, 90.0), *[c for c in changes[3] if c[0] > 0]]
    times = [(p, i, t) for p in changes for i, t in enumerate([0.0, -1.0, *[rnd.random() * 90 for _ in range(60)], *[s for s, _ in changes[p]]])]
    moved = spark.createDataFrame([(p, s, b) for p in changes for s, b in changes[p]] + [(3, 0.0, 80.0)], "piece_id long, seconds double, bpm double")
    rows = spark.createDataFrame(times, "piece_id long, i int, t double")
    map_ = tempo.segments(moved, rows)
    assert {r.piece_id: r["n"] for r in map_.groupBy("piece_id").agg(F.count("*").alias("n")).collect()} == {1: 1, 2: 2, 3: len(changes[3])}
    ticks = tempo.to_ticks(rows, "t", map_)
    back = {(r.piece_id, r.i): r for r in tempo.to_seconds(ticks, "tick", map_, "back").collect()}
    assert len(back) == len(times)
    for p, i, t in times:
        r, seconds = back[p, i], max(0.0, t)
        assert abs(r.tick - ticks_of(changes[p], seconds)) <= 0.5 + 1e-6
        assert abs(ticks_of(changes[p], r.back) - r.tick) < 1e-6  # seconds are the inverse of ticks
        slowest = min([120.0, *[b for _, b in changes[p]]])
        assert abs(r.back - seconds) <= 0.5 * 60 / (220 * slowest) + 1e-9


def test_tokens_with_tempi_decode_to_their_times(spark):
    changes = [(0.0, 60.0), (4.0, 120.0), (9.0, 240.0)]
    onsets = [0.0, 1.0, 3.75, 4.5, 8.0, 9.5, 12.0, 40.0]
    notes = spark.createDataFrame([(1, t, 0.5, 40 + i, 64) for i, t in enumerate(onsets)], "piece_id long, onset double, duration double, pitch int, velocity int")
    pedals = spark.createDataFrame([(1, 2.0, True), (1, 3.0, False)], "piece_id long, seconds double, down boolean")
    map_ = tempo.segments(spark.createDataFrame([(1, *c) for c in changes], "piece_id long, seconds double, bpm double"), notes)
    timed = remi.encode(tempo.events(notes, pedals, map_), times=True)
    tokens = {r.pos: r for r in tempo.token_times(timed, map_).collect()}
    assert [tokens[p].pos for p in range(len(tokens))] == list(range(len(tokens)))
    assert sum(remi.TEMPO <= r.tok < remi.PEDAL_ON for r in tokens.values()) == 3 and sum(r.tok in (remi.PEDAL_ON, remi.PEDAL_OFF) for r in tokens.values()) == 2
    got = sorted((r.pitch, r.onset) for r in tempo.decode(timed).collect())
    for (pitch, onset), want in zip(got, onsets, strict=True):
        # half a grid step of the slowest tempo on either side of a change, and the tempo's own bin
        assert abs(onset - want) < 0.13 + 0.02 * want, pitch
    plain = {r.pos: r.tok for r in remi.encode(tempo.events(notes, pedals, map_)).collect()}
    assert plain == {p: r.tok for p, r in tokens.items()}


def brute_merges(seqs, size, base, least=2):
    seqs, out = {p: list(s) for p, s in sorted(seqs.items())}, []
    while len(out) < size:
        freq, first = {}, {}
        for p, s in seqs.items():
            for i, pair in enumerate(zip(s, s[1:], strict=False)):
                freq[pair] = freq.get(pair, 0) + 1
                first.setdefault(pair, (p, i))
        best = min(freq, key=lambda k: (-freq[k], first[k]), default=None)
        if best is None or freq[best] < least:
            break
        new = base + len(out)
        out.append((len(out), *best, freq[best]))
        seqs = {p: applied(s, best, new) for p, s in seqs.items()}
    return out, seqs


def applied(seq, pair, new):
    out, i = [], 0
    while i < len(seq):
        hit = tuple(seq[i : i + 2]) == pair
        out.append(new if hit else seq[i])
        i += 2 if hit else 1
    return out


@pytest.mark.parametrize("block, kinds", [(3, 4), (16, 12), (4096, 6)])
def test_training_on_blocks_equals_one_merge_a_round(spark, block, kinds):
    rnd = random.Random(block)
    seqs = {p: [rnd.randrange(kinds) for _ in range(rnd.choice([1, 2, 40, 150]))] for p in range(8)}
    seqs[3] = [rnd.choice([0, 0, 1]) for _ in range(400)]  # runs, over many blocks
    rows = spark.createDataFrame([(p, i, t) for p, s in seqs.items() for i, t in enumerate(s)], "piece_id long, pos int, tok int")
    merges, left = pairs.train_iterative(rows, 16, 100, block=block)
    want, final = brute_merges(seqs, 16, 100)
    assert merges == want
    got = {}
    for r in left.orderBy("piece_id", "pos").collect():
        got.setdefault(r.piece_id, []).append((r.pos, r.tok))
    assert got == {p: list(enumerate(s)) for p, s in final.items()}
    again = pairs.apply_ranked(rows, [(a, b, 100 + r) for r, a, b, _ in merges], block=block)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, left.collect()))


def test_many_merges_share_a_round(spark):
    best = [(1, 2, 9), (1, 3, 8), (4, 2, 7), (5, 6, 6), (2, 7, 5), (8, 9, 4)]
    assert pairs.independent(best, 9) == best[:4]  # sharing a side is no conflict, following one another is
    with pytest.raises(ValueError):
        pairs.merge_pass(spark.createDataFrame([(1, 0, 1)], "piece_id long, pos int, tok int"), spark.range(pairs.MOST_MERGES + 1).selectExpr("id AS lhs", "id AS rhs", "id AS new_id"))
