"""Keyed state: batch and stream agree whatever the micro-batches, and a restart goes on."""

import os
import random
import threading
from contextlib import contextmanager

import pytest
from pyspark.sql.streaming import StreamingQueryListener

from notelake import plans
from notelake.streaming import progress, state

SF = "/root/testdata/sf0.001"

STEPS = "piece_id long, note_ix long, delta_tok int"
CANDIDATES = "lane long, seq long, piece long, pos long, score double"


def streaks(rows):
    """Batch form of the streaks, row by row."""
    out, now = {}, {}
    for piece, ix, step in sorted(rows):
        now[piece] = now.get(piece, 0) + 1 if step == 0 else 0
        out[piece, ix] = now[piece]
    return out


def memories(rows):
    """Batch form of the memory: the eight best of each piece of a lane."""
    pieces = {}
    for lane, _, piece, pos, score in rows:
        pieces.setdefault((lane, piece), []).append((-score, pos))
    return {k: sorted((pos, -s) for s, pos in sorted(v)[: state.HELD]) for k, v in pieces.items()}


def cut(rows, files, seed, shuffled):
    """Rows dealt to files; in order, or anyhow."""
    rnd = random.Random(seed)
    if shuffled:
        rows = rows[:]
        rnd.shuffle(rows)
        return [rows[i::files] for i in range(files)]
    ends = sorted(rnd.sample(range(1, len(rows)), files - 1))
    return [rows[a:b] for a, b in zip([0, *ends], [*ends, len(rows)], strict=True)]


def write(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def step_rows(seed=1):
    rnd = random.Random(seed)
    rows = [(p, i, rnd.choice([0, 0, 0, 5])) for p in range(3) for i in range(rnd.randrange(1, 40))]
    return sorted(rows, key=lambda r: r[1])


def candidate_rows(seed=2):
    rnd = random.Random(seed)
    return [(lane, 20 * k + i, 10 * lane + k, i, rnd.choice([0.5, round(rnd.random(), 2)])) for k in range(4) for i in range(20) for lane in range(2)]


@pytest.mark.parametrize("files, shuffled", [(1, False), (3, False), (4, True)])
def test_streaks_agree_in_any_split(spark, tmp_path, files, shuffled):
    rows = step_rows()
    for part in cut(rows, files, files, shuffled):
        write(spark, part, STEPS, f"{tmp_path}/in")
    got = state.run(spark, f"{tmp_path}/in", STEPS, state.zero_streaks, f"{tmp_path}/out", f"{tmp_path}/checkpoint").collect()
    assert {(r.piece_id, r.note_ix): r.streak for r in got} == streaks(rows) and len(got) == len(rows)
    assert all(r.barred == (r.streak >= 3) for r in got)


def test_streaks_after_a_restart_and_files_that_come_twice(spark, tmp_path):
    rows = step_rows(5)
    first, second, third = cut(rows, 3, 9, True)
    go = lambda: state.run(spark, f"{tmp_path}/in", STEPS, state.zero_streaks, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    write(spark, first, STEPS, f"{tmp_path}/in")
    early = {(r.piece_id, r.note_ix) for r in go().collect()}
    assert early < {(p, i) for p, i, _ in rows}  # what has no predecessor yet waits
    write(spark, first, STEPS, f"{tmp_path}/in")  # again
    write(spark, second, STEPS, f"{tmp_path}/in")
    go()
    write(spark, third, STEPS, f"{tmp_path}/in")
    got = go().collect()
    assert {(r.piece_id, r.note_ix): r.streak for r in got} == streaks(rows) and len(got) == len(rows)


@pytest.mark.parametrize("files, shuffled", [(1, False), (3, False), (3, True)])
def test_memory_agrees_in_any_split_and_is_cleared(spark, tmp_path, files, shuffled):
    rows = candidate_rows()
    for part in cut(rows, files, files, shuffled):
        write(spark, part, CANDIDATES, f"{tmp_path}/in")
        shown = state.run(spark, f"{tmp_path}/in", CANDIDATES, state.theme_memory, f"{tmp_path}/out", f"{tmp_path}/checkpoint")  # a restart for each file
    got = {}
    for r in state.last_memory(shown).collect():
        got.setdefault((r.lane, r.piece), []).append((r.pos, r.score))
    assert {k: sorted(v) for k, v in got.items()} == memories(rows)


def test_the_session_gets_its_own_store_back(spark):
    before = spark.conf.get(state.PROVIDER)
    with state.rocks(spark):
        assert spark.conf.get(state.PROVIDER) == state.ROCKS
    assert spark.conf.get(state.PROVIDER) == before


def test_progress_rows_are_one_a_batch_and_go_on_after_a_restart(spark, tmp_path):
    rows = step_rows(7)
    parts = cut(rows, 5, 3, False)
    go = lambda: state.run(spark, f"{tmp_path}/in", STEPS, state.zero_streaks, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    for part in parts[:3]:
        write(spark, part, STEPS, f"{tmp_path}/in")
    with progress.reported(spark, f"{tmp_path}/progress", total=len(rows)):
        go()
    for part in parts[3:]:
        write(spark, part, STEPS, f"{tmp_path}/in")
    with progress.reported(spark, f"{tmp_path}/progress", total=len(rows)):
        go()
    got = progress.read(spark, f"{tmp_path}/progress").orderBy("batch").collect()
    assert [r.batch for r in got] == list(range(5)) and [r.rows for r in got] and sum(r.rows for r in got) == len(rows)
    assert sorted(r.rows for r in got) == sorted(map(len, parts))
    assert [r.done for r in got] == [sum(x.rows for x in got[: k + 1]) for k in range(5)]
    assert all(r.backlog == len(rows) - r.done and r.rate > 0 and r.eta_seconds >= 0 for r in got) and got[-1].eta_seconds == 0


@contextmanager
def store_reports(spark):
    """What the state store held and what was written to it, (held, written) a micro-batch of the stream that runs inside."""
    found, ended = [], threading.Event()

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event):  # noqa: N802
            pass

        def onQueryProgress(self, event):  # noqa: N802
            found.extend((o.numRowsTotal, o.numRowsUpdated) for o in event.progress.stateOperators)

        def onQueryIdle(self, event):  # noqa: N802
            pass

        def onQueryTerminated(self, event):  # noqa: N802
            ended.set()

    listener = Listener()
    spark.streams.addListener(listener)
    try:
        yield found
        assert ended.wait(30)
    finally:
        spark.streams.removeListener(listener)


def test_state_is_written_by_group_and_block_not_by_row(spark, tmp_path):
    rows = [(p, i, 0) for p in range(40) for i in range(100)]
    for part in cut(rows, 2, 3, True):
        write(spark, part, STEPS, f"{tmp_path}/in")
    with store_reports(spark) as found:
        got = state.run(spark, f"{tmp_path}/in", STEPS, state.zero_streaks, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert {(r.piece_id, r.note_ix): r.streak for r in got.collect()} == streaks(rows)
    assert len(found) == 2 and sum(written for _, written in found) < len(rows) / 10


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name, keys, group", [("zero_streak_stream", "piece_id", 16), ("memory_stream", "lane", 1)])
def test_portions_reach_the_stream_in_order(spark, name, keys, group):
    """In order no row waits, so the store holds a row a group and nothing else."""
    with store_reports(spark) as found:
        got = plans.QUERIES[name](spark, SF)
    groups = {r[0] // group for r in got.select(keys).distinct().collect()}
    assert found and all(held <= len(groups) for held, _ in found)


def test_streaks_over_blocks_from_the_end_on_and_rows_without_a_piece(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(p, i, rnd.choice([0, 0, 5, None])) for p, n in ((-17, 30), (7, 2600), (8, 20), (None, 40)) for i in range(n)]
    back = sorted(rows, key=lambda r: -r[1])
    for part in (back[:900], back[800:1700], back[2000:], back[1700:2000]):  # a hundred come twice
        write(spark, part, STEPS, f"{tmp_path}/in")
    got = state.run(spark, f"{tmp_path}/in", STEPS, state.zero_streaks, f"{tmp_path}/out", f"{tmp_path}/checkpoint").collect()
    want = streaks([(-1 if p is None else p, i, step) for p, i, step in rows])
    assert {(-1 if r.piece_id is None else r.piece_id, r.note_ix): r.streak for r in got} == want and len(got) == len(rows)
