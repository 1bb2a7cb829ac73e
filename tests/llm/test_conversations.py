import hashlib
import random
import zlib
from itertools import pairwise

import pytest

from notelake.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, present int, digest string"


def damaged(rows):
    """The contract's damage in plain Python: {conv_id: rows (turn, role, text) by turn}."""
    out = {}
    for conv, turn, role, text, *_ in rows:
        plain = lambda v: " " if v is None else str(v)
        kind, role, text = zlib.crc32(f"{plain(conv)}:{plain(turn)}".encode()) % 20, plain(role), plain(text)
        mine = out.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        ends = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        out.append("blank" if not ends else "duplicate" if (role, text) in seen else "truncated" if ends not in ".!?" else None)
        seen.add((role, text))
    return out


def legal(letters):
    body = letters[1:] if letters[:1] == "s" else letters
    return letters == "" or (body and len(body) % 2 == 0 and body == "ua" * (len(body) // 2))


def best(rows):
    """Every sequence of edits with at most two insertions in a place, by exhaustion."""
    marks, found = faults(rows), []

    def go(i, cost, audit, out, inserted):
        if len(found) and cost > found[0][0]:
            return
        if i == len(rows) and legal("".join(r[:1] or "?" for r, _ in out)):
            found.append((cost, audit, "\n".join(f"{r}:{t}" for r, t in out)))
            found.sort()
        if inserted < 2:
            for role in ("user", "assistant"):
                go(i, cost + 2, audit + "I", [*out, (role, "")], inserted + 1)
        if i == len(rows):
            return
        _, role, text = rows[i]
        go(i + 1, cost + 3, audit + "D", out, 0)
        if marks[i] in (None, "truncated"):
            worn = marks[i] is not None
            go(i + 1, cost + worn, audit + "K", [*out, (role, text)], 0)
            for to in ("user", "assistant"):
                go(i + 1, cost + 2 + worn, audit + "R", [*out, (to, text)], 0)

    go(0, 0, "", [], 0)
    return found[0]


def expected(rows):
    out = {}
    for conv, mine in damaged(rows).items():
        turns, marks = [t for t, *_ in mine if t is not None], faults(mine)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, text = best(mine)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairwise(mine))
        out[conv] = (gaps, *[marks.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Yes?"), (1, 2, "assistant", "Yes?"),
    (2, None, "user", "no turn."), (2, None, None, None), (2, 3, "assistant", "ends \t\n"), (2, 9, "tool", "out."),
    (3, 0, "assistant", "first."), (3, 1, "user", "second."), (3, 1, "user", "second."), (3, 2, "user", "é🎹"), (3, 3, "system", "late."),
    (None, 0, "user", "whose?"), (None, 1, "assistant", "Nobody's."), (4, 0, "", "no role."), (5, 0, "user", "\x0b\x0c"), (6, -5, "user", "x" * 200_000 + "."),
    (7, 2**60, "user", "big turn."), (8, 0, "Assistant", "capital."), (8, 1, "User", "capital."),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)


def summaries(spark, rows):
    return {r[0]: tuple(r)[1:] for r in C.summaries(C.damage(table(spark, rows))).collect()}


def random_rows(n, most, seed):
    rnd = random.Random(seed)
    texts = ["a.", "b!", "c?", "d", "", " ", "e. ", "f.\n"]
    return [(c, t, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), rnd.choice(texts)) for c in range(n) for t in range(rnd.randrange(1, most))]


def test_contract_against_exhaustion(spark):
    for rows in (ROWS, random_rows(150, 5, 1)):
        got = summaries(spark, rows)
        want = expected(rows)
        assert set(got) == set(want)
        for c in want:
            assert got[c] == want[c], (c, [r[:4] for r in rows if r[0] == c])


def test_empty_table_and_dropped_rows(spark):
    assert summaries(spark, []) == {}
    gone = next(i for i in range(10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert summaries(spark, [(gone, 0, "user", "Gone.")])[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def walk(rows, settle):
    """One conversation without Spark, with the given bound on open rows."""
    out = []
    conversation = C.Conversation(0, lambda *r: out.append(r[1:]))
    conversation.settle = settle
    most = 0
    for (turn, role, text), mark in zip(rows, faults(rows), strict=True):
        conversation.add(turn, role, text, mark)
        most = max(most, len(conversation.open))
    return conversation.end(), out, most


@pytest.mark.parametrize("seed", range(6))
def test_settling_early_changes_nothing(seed, monkeypatch):
    rnd = random.Random(seed)
    rows = [(t, rnd.choice(["user", "assistant", "system", "tool"]), f"{t}{rnd.choice(['.', '', '!'])}") for t in range(900)]
    rows[100:160] = [(100 + k, "user", "same.") for k in range(60)]
    want = walk(rows, 10**9)
    for least in (1, 7, 64):
        monkeypatch.setattr(C, "SETTLE", least)
        got = walk(rows, least)
        assert got[:2] == want[:2]
    assert walk([(t, ("user", "assistant")[t % 2], "x.") for t in range(5000)], 64)[2] <= 64  # open rows stay few


def test_repaired_turns_and_their_digest(spark):
    rows = [r for r in random_rows(60, 9, 3)]
    turns = C.damage(table(spark, rows))
    summary, found = {r.conv_id: r for r in C.summaries(turns).collect()}, {}
    for r in C.repaired(turns).collect():
        found.setdefault(r.conv_id, []).append(r)
    for conv, s in summary.items():
        mine = sorted(found.get(conv, []), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(len(mine)))
        assert "".join(r.edit for r in mine) == s.audit.replace("D", "")
        assert legal("".join(r.role[:1] for r in mine))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine).encode()).hexdigest() == s.repaired_sha256


def test_undamaged_rows_and_one_shuffle(spark):
    plain = C.summaries(C.as_turns(table(spark, [(1, 0, "user", "Hi."), (1, 1, "assistant", "Ho.")]))).first()
    assert (plain.cost, plain.audit, plain.illegal) == (0, "KK", 0)
    plan = C.summaries(C.damage(table(spark, ROWS)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
