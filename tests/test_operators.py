"""Boundaries, ties and brute force for the operators."""

import math
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelake import spec
from notelake.functions import clean
from notelake.functions import quantize as Q
from notelake.operators import cut, features, manifest, pairs, remi, scoring, tokens

NOTE = "piece_id long, event_id long, note_ix int, onset double, duration double, pitch int, velocity int, program int, is_drum boolean"


def notes(spark, rows):
    """rows: (piece, onset, duration, pitch, velocity)."""
    out, seen = [], {}
    for i, (p, o, d, k, v) in enumerate(sorted(rows)):
        seen[p] = seen.get(p, -1) + 1
        out.append((p, i, seen[p], float(o), float(d), k, v, 0, False))
    return spark.createDataFrame(out, NOTE)


def values(spark, kind, items, f):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_bins_equal_a_search_over_the_edges(spark):
    for edges in (spec.DELTA_EDGES, spec.DURATION_EDGES):
        probes = [*edges, *[math.nextafter(e, 0) for e in edges], *[math.nextafter(e, 9) for e in edges], *np.geomspace(1e-5, 20, 500)]
        want = np.searchsorted(edges, probes, side="right") - 1
        assert values(spark, "double", [float(p) for p in probes], lambda x, e=edges: Q.bin_of(x, e)) == want.tolist()


def test_token_boundaries(spark):
    assert values(spark, "double", [0.0, 1e-5, 1e-4, 8.0, 9.0], Q.delta_token) == [0, 1, 1, 127, 127]
    assert values(spark, "double", [0.001, 8.0, 100.0], Q.duration_token) == [216, 343, 343]
    assert values(spark, "int", [0, 7, 8, 127], Q.velocity_token) == [344, 344, 345, 359]
    assert values(spark, "int", [21, 108], Q.pitch_token) == [128, 215]
    assert values(spark, "int", [0, 127, 128, 343, 359, 360, 361, 362, 366, 370, 373, 374], Q.kind_of) == ["delta", "delta", "pitch", "duration", "velocity", "pad", "bos", "eos", "density", "voices", "register", "other"]


def test_polyphony_of_touching_notes(spark):
    n = notes(spark, [(1, 0, 1, 60, 1), (1, 0.5, 2, 60, 1), (1, 1, 1, 60, 1), (2, 0, 1, 60, 1), (2, 1, 1, 60, 1)])
    got = {r.piece_id: (round(r.mean_voices, 6), r.peak_voices) for r in features.polyphony(n).collect()}
    assert got == {1: (1.6, 3.0), 2: (1.0, 2.0)}


def test_quartiles_need_eight_pieces(spark):
    d = lambda k: features.quartiles(spark.createDataFrame([(float(i + 1),) for i in range(k)], "density double")).first()
    assert tuple(d(7)) == spec.DEFAULT_QUARTILES
    assert tuple(d(8)) == tuple(np.quantile(np.arange(1, 9), [0.25, 0.5, 0.75]))


def ornaments():
    return [(1, 0.82 * p + 0.032 * s, 0.020 + 0.002 * (s % 2), 72 + p % 3 + s % 6, 86 - s % 8) for p in range(12) for s in range(24)]


def chords():
    shapes = [(48, 52, 55, 60), (50, 53, 57, 62), (45, 50, 53, 57), (47, 50, 55, 59)]
    return [(2, 2.2 * b, 1.9, k, 72 + b % 6) for b in range(16) for k in shapes[b % 4]]


def gaps():
    return [(3, p * 2.75 + o, 0.16 + 0.01 * (i % 2), 60 + p % 4 + 2 * (i % 3), 74 + i % 10) for p in range(14) for i, o in enumerate((0, 0.2, 0.45, 0.75, 1.05, 1.35))]


def test_stream_invariants_of_generated_pieces(spark):
    n = notes(spark, ornaments() + chords() + gaps())
    rows = tokens.stream(n, features.tags(n)).orderBy("piece_id", "pos").collect()
    for piece, size in ((1, 288), (2, 64), (3, 84)):
        own = [r for r in rows if r.piece_id == piece]
        assert [r.pos for r in own] == list(range(4 * size + 5)) and own[3].tok == spec.BOS and own[-1].tok == spec.EOS
        body = own[4:-1]
        assert all(a.onset <= b.onset for a, b in zip(body, body[1:])) and all(r.duration > 0 for r in own)
        for i in range(0, len(body), 4):
            assert len({(r.onset, r.duration) for r in body[i : i + 4]}) == 1
            assert [low <= r.tok <= high for r, (low, high) in zip(body[i : i + 4], spec.RANGES.values())] == [True] * 4
    decoded = tokens.decode(tokens.body(n)).groupBy("piece_id").count().collect()
    assert {r.piece_id: r["count"] for r in decoded} == {1: 288, 2: 64, 3: 84}


def test_dirty_streams_resynchronise(spark):
    good = [5, 130, 220, 350]
    stream = [363, 367, 371, 361, *good, 130, *good[:2], *good, 7, 360, *good, 5, 5, *good, *good[:3], 362, *good]

    def brute(t):
        out, i = [], 0
        while i < len(t) and t[i] != spec.EOS:
            if i + 3 < len(t) and all(low <= x <= high for x, (low, high) in zip(t[i : i + 4], spec.RANGES.values())):
                out.append(tuple(t[i : i + 4]))
                i += 4
            else:
                i += 1
        return out

    got = spark.createDataFrame([(stream,)], "s array<int>").select(tokens.decode_dirty(F.col("s")).alias("q")).first().q
    assert [tuple(x) for x in got] == brute(stream) == [tuple(good)] * 4


def test_windows_snap_and_padding(spark):
    s = spark.createDataFrame([(1, list(range(10))), (2, [1, 2])], "piece_id long, seq array<int>")
    got = [(r.start, r.seed, r.continuation) for r in tokens.windows(s, 3, 2, 2).orderBy("start").collect()]
    assert got == [(k, [k, k + 1, k + 2], [k + 3, k + 4]) for k in (0, 2, 4)]
    assert values(spark, "int", [0, 1, 2, 3, 4, 7, 9], lambda x: tokens.snap_start(x, F.lit(6))) == [0, 0, 0, 4, 4, 4, 4]
    assert sorted(r.seq for r in tokens.pad(s.withColumn("b", F.lit(1)), "b", 0).collect()) == [list(range(10)), [1, 2] + [0] * 8]


def test_chord_groups_are_anchored(spark):
    n = notes(spark, [(1, 0, 1, 60, 1), (1, 0.06, 1, 60, 1), (1, 0.12, 1, 60, 1), (2, 5, 1, 60, 1)])
    assert [(r.piece_id, r.grp) for r in cut.chords(n, 0.1).orderBy("piece_id", "note_ix").collect()] == [(1, 0), (1, 0), (1, 1), (2, 0)]


def test_nearest_beat_without_anchor_is_null(spark):
    p = spark.createDataFrame([(1, 0, 1.0), (1, 1, 4.2), (2, 0, 3.0)], "piece_id long, grp int, t double")
    a = spark.createDataFrame([(1, 1.5), (1, 4.0)], "piece_id long, t double")
    got = {(r.piece_id, r.grp): r.d for r in cut.nearest(p, a, "d").collect()}
    assert got[1, 0] == 0.5 and abs(got[1, 1] - 0.2) < 1e-9 and got[2, 0] is None


def test_nucleus_drops_the_class_that_crosses(spark):
    logits = [math.log(x) for x in (0.5, 0.3, 0.2)]
    df = spark.createDataFrame([(logits,)], "a array<double>")
    kept = lambda k, p, least: [r["cls"] for r in df.select(scoring.candidates(F.col("a"), k, p, least).alias("c")).first().c]
    assert kept(3, 0.7, 1) == [0] and kept(3, 0.85, 1) == [0, 1] and kept(3, 0.1, 2) == [0, 1] and kept(1, 0.99, 1) == [0]
    capped = df.select(scoring.capped(scoring.renormalised(scoring.candidates(F.col("a"), 3, 1.0, 1)), 0.4).alias("c")).first().c
    assert abs(max(r.p for r in capped) - 0.4) < 1e-9 and abs(sum(r.p for r in capped) - 1) < 1e-9


def test_pairs_overlap_in_counts_but_not_in_merges(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate([7, 7, 7, 8, 7, 7])], "piece_id long, pos int, tok int")
    assert {(r.lhs, r.rhs): r.freq for r in pairs.counts(rows).collect()} == {(7, 7): 3, (7, 8): 1, (8, 7): 1}
    table = spark.createDataFrame([(7, 7, 100)], "lhs int, rhs int, new_id int")
    assert [(r.pos, r.tok, r.first, r.last) for r in pairs.merge_pass(rows, table).orderBy("pos").collect()] == [(0, 100, 0, 1), (1, 7, 2, 2), (2, 8, 3, 3), (3, 100, 4, 5)]
    assert [r.tok for r in pairs.apply_ranked(rows, [(7, 8, 100), (7, 7, 101), (101, 100, 102)]).orderBy("pos").collect()] == [102, 101]
    with pytest.raises(ValueError):
        pairs.apply_ranked(rows, [(101, 7, 100), (7, 7, 101)])


def greedy(seq, merges):
    out, i = [], 0
    while i < len(seq):
        new = merges.get(tuple(seq[i : i + 2]))
        out.append(seq[i] if new is None else new)
        i += 1 if new is None else 2
    return out


def test_a_greedy_pass_matches_brute_force_and_is_linear(spark):
    rng = np.random.default_rng(6)
    seqs = {p: rng.integers(0, 4, 60).tolist() for p in range(30)}
    merges = {(0, 1): 10, (1, 1): 11, (1, 2): 12, (2, 0): 13, (3, 3): 14}
    rows = spark.createDataFrame([(p, i, int(t)) for p, s in seqs.items() for i, t in enumerate(s)], "piece_id long, pos int, tok int")
    table = spark.createDataFrame([(*k, v) for k, v in merges.items()], "lhs int, rhs int, new_id int")
    got = {}
    for r in pairs.merge_pass(rows, table).orderBy("piece_id", "pos").collect():
        got.setdefault(r.piece_id, []).append(r.tok)
    assert got == {p: greedy(s, merges) for p, s in seqs.items()}
    long = spark.range(400_000).selectExpr("7L AS piece_id", "cast(id AS int) AS pos", "cast(hash(id) % 4 AS int) AS tok")
    assert pairs.merge_pass(long, table).count() < 400_000


def test_independent_pairs_of_a_round():
    assert pairs.independent([(1, 2, 9), (3, 4, 8), (2, 5, 7), (6, 7, 6)], 9) == [(1, 2, 9), (3, 4, 8)]
    assert pairs.independent([(1, 1, 9), (3, 4, 8)], 9) == [(1, 1, 9)] and pairs.independent([(1, 2, 9), (3, 3, 8)], 9) == [(1, 2, 9)]
    assert pairs.independent([(1, 2, 9), (3, 4, 8)], 1) == [(1, 2, 9)] and pairs.independent([(1, 2, 0, 100), (100, 3, 1, 101)], 9) == [(1, 2, 0, 100)]


def test_iterative_merging_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    seqs = {p: rng.integers(0, 9, 90).tolist() for p in range(4)}
    rows = spark.createDataFrame([(p, i, int(t)) for p, s in seqs.items() for i, t in enumerate(s)], "piece_id long, pos int, tok int")
    merges, left = pairs.train_iterative(rows, 9, 100)
    want = []
    for r in range(9):
        freq, first = {}, {}
        for p, s in seqs.items():
            for i, pair in enumerate(zip(s, s[1:])):
                freq[pair] = freq.get(pair, 0) + 1
                first.setdefault(pair, (p, i))
        best = min(freq, key=lambda q: (-freq[q], first[q]))
        want.append((r, *best, freq[best]))
        for p, s in seqs.items():
            out, i = [], 0
            while i < len(s):
                hit = tuple(s[i : i + 2]) == best
                out.append(100 + r if hit else s[i])
                i += 1 + hit
            seqs[p] = out
    assert merges == want
    assert {r.piece_id: r.seq for r in tokens.sequences(left).collect()} == seqs


def test_bar_tokens_round_trip(spark):
    n = notes(spark, [(1, 0, 0.5, 60, 96), (1, 0.5, 0.5, 64, 64), (1, 30.0, 20.0, 65, 127)])
    enc = remi.encode(remi.events(n))
    seq = tokens.sequences(enc).first().seq
    assert seq[0] == remi.BOS and seq[-1] == remi.EOS and seq.count(remi.BAR) == 16 and seq.count(remi.TIME_SHIFT + 63) == 3
    got = [(r.onset, r.pitch, r.velocity, r.duration) for r in remi.decode(enc).orderBy("pos").collect()]
    assert got == [(0.0, 60, 98, 0.5), (0.5, 64, 66, 0.5), (30.0, 65, 126, 8.0)]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 11, 25])
def test_split_sizes(spark, n):
    df = spark.range(n).select(F.col("id").alias("piece_id")).withColumn("h", manifest.hash_order("piece_id", 1))
    ranked = manifest.global_rank(df, "h", "piece_id")
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, n + 1))
    counts = {r.part: r["count"] for r in manifest.split_90_5_5(ranked).groupBy("part").count().collect()}
    train, val = max(1, int(0.9 * n)), max(1, int(0.05 * n))
    if n - train - val <= 0:
        train, val = (train - 1, val) if train > val else (train, val - 1)
    part = (["train"] * train + ["val"] * val + ["test"] * n)[:n]
    assert counts == {p: part.count(p) for p in set(part)}


def test_cleaning(spark):
    assert values(spark, "string", ["3", "3.9", " 4 ", None, "x"], lambda x: clean.to_int(x, -1)) == [3, -1, 4, -1, -1]
    assert values(spark, "double", [3661.9, None, -1.0, float("inf")], clean.eta) == ["01:01:01", "unknown", "unknown", "unknown"]
    assert values(spark, "string", ["..\\A/b", "./.a", "/x"], manifest.relative_key) == ["a/b", "a", "x"]


def test_stream_takes_only_new_files(spark, tmp_path):
    from notelake.streaming import ingest

    docs = lambda ids: spark.createDataFrame([(i, "t", "en", "s", 150 + i) for i in ids], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    source = str(tmp_path / "in")
    run = lambda: ingest.ingest(spark, source, "*.parquet", docs([]).schema, str(tmp_path / "m"), str(tmp_path / "l"), str(tmp_path / "c"), 1)
    docs(range(60)).write.parquet(source)
    run()
    assert spark.read.parquet(str(tmp_path / "m")).count() == 60
    docs(range(60, 90)).write.mode("append").parquet(source)
    run()
    run()
    got = spark.read.parquet(str(tmp_path / "m"))
    assert got.count() == got.select("index").distinct().count() == 90
    ledger = spark.read.parquet(str(tmp_path / "l")).orderBy("start_index").collect()
    assert [(r.rows, r.accepted, r.end_index) for r in ledger] == [(60, 10, 59), (30, 30, 89)]


def test_event_windows_of_a_stream(spark, tmp_path):
    from notelake.streaming import ingest

    spark.createDataFrame([(1, "2024-01-01 00:01:00", "a", 2.0), (2, "2024-01-01 00:04:00", "a", 3.0), (3, "2024-01-01 00:06:00", "b", 4.0)], "event_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("event_id long, ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    q = ingest.running_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.event_type, r.n, r.total) for r in spark.table("counts").collect()) == [("a", 2, 5.0), ("b", 1, 4.0)]


def test_registry_without_the_optional_subpackage():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('notelake.llm') or name == 'corpus_pipeline': raise ImportError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'tokens_quad' in e.queries() and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in e.queries())\n"
        "assert set(e.oracle_sql()) <= set(e.queries())\n"
    )
    assert subprocess.run([sys.executable, "-c", code], capture_output=True).returncode == 0


def test_piano_roll_takes_notes_of_any_onset(spark, tmp_path):
    from notelake import plans

    rows = [(1, 7, 0, 10.0, "view", 0), (2, 7, 100 * 60_000, 10.0, "view", 40)]  # the second starts at 100, 0.1 long
    events = spark.createDataFrame(rows, "event_id long, user_id long, s long, value double, event_type string, k int")
    props = F.concat(F.lit('{"k": '), F.col("k").cast("string"), F.lit("}")).alias("props")
    events.select("event_id", "user_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "value", "event_type", props).write.parquet(f"{tmp_path}/events.parquet")
    got = plans.QUERIES["piano_roll"](spark, str(tmp_path)).collect()
    assert sorted((r.piece_id, r.pitch, r.frame) for r in got) == [(7, 21, 0), (7, 61, 200)]
