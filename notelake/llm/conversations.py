"""Conversation structure repair: the cheapest edits that give every conversation the form system? (user assistant)*.

A forward Viterbi pass per conversation. Four states say what the repaired turns
end with: nothing yet, the system turn, a user turn, an assistant turn. Per state
the least (cost, audit string) is carried from row to row; a row is kept (K), given
the role that may come next (R) or deleted (D), and after each row insertions (I)
close the layer. Two rounds of them suffice, as a longer walk of insertions comes
back to a state that it has been in.

Rows are dealt by conversation and sorted by turn, so a conversation streams
through its task: it is never gathered. Once ``SETTLE`` rows are open, what all
states that can still win agree on is final, and its turns are hashed and let go;
so a very long conversation costs memory for its open end and for its audit string
only. (The digest of a conversation is sequential, so one conversation is one task.)
Repeats are found by a window over (conversation, role, text digest), which spills.

Defined results: null roles and texts are one space; a role that is empty or starts
with another letter than s, u or a is never kept; null turns come first; rows
of one turn go by role and text; repeated rows are duplicates; a null conversation
is one of its own; one whose rows are all dropped has zeros and the digest of an
empty string; an empty table has no rows; texts of any length are taken whole;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.column import Column
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: White space, what a whole text ends with, costs of the edits, pairs of initials that may follow each other.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
REROLE, DELETE, INSERT, WORN = 2, 3, 2, 1
LEGAL = ("su", "ua", "au")
#: States by what was written last, and the states that each may follow.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {SYSTEM: ("s", (START,)), USER: ("u", (START, SYSTEM, ASSISTANT)), ASSISTANT: ("a", (USER,))}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Open rows of a conversation from which its settled beginning is written out.
SETTLE = 256
#: Rows of an Arrow batch that is handed back, and characters of text after which it is handed back earlier.
BATCH, BATCH_CHARS = 2_000, 4_000_000

TURNS = "place long, edit string, role string, text string"
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, present, turn, role, text): rows damaged by the crc32 of ``conv_id:turn``; a dropped row stays as a mark of its conversation."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", plain("conv_id"), plain("turn"))) % 20
    rows = conversations.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", (F.col("kind") != 0).alias("present"), "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def fault(text: Column, again: Column) -> Column:
    """A row's first fault: blank, duplicate, truncated or null. ``again`` says whether its role and text were seen before."""
    end = F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))
    return F.when(end == "", "blank").when(again, "duplicate").when(~end.isin(*ENDS), "truncated")


def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, present, turn, role, text, fault), dealt by conversation in one shuffle and sorted by turn; ``present`` marks the rows that count."""
    rows = turns.select("conv_id", "present", "turn", "role", "text", F.sha2("text", 256).alias("digest")).repartition("conv_id")
    same = W.partitionBy("conv_id", "role", "digest", "present").orderBy("turn")  # rows are dealt by conv_id already: no other shuffle
    again = F.row_number().over(same) > 1
    rows = rows.withColumn("again", again).sortWithinPartitions("conv_id", "turn", "role", "text", "again")
    return rows.select("conv_id", "present", "turn", "role", "text", fault(F.col("text"), F.col("again")).alias("fault"))


def _longer(path, cost: int, edit: str):
    return None if path is None else (path[0] + cost, path[1] + edit)


def _least(*paths):
    return min((p for p in paths if p is not None), default=None)


def close(paths: list) -> list:
    """The layer after insertions: a user turn after anything but a user turn, then an assistant turn after that."""
    start, system, user, assistant = paths
    user = _least(user, _longer(_least(start, system, assistant), INSERT, "I"))
    return [start, system, user, _least(assistant, _longer(user, INSERT, "I"))]


def step(paths: list, initial: str, fault: str | None) -> list:
    """The closed layer after a row: per state the least (cost, audit), or None where it can't be reached."""
    new = [_longer(p, DELETE, "D") for p in paths]
    if fault in (None, "truncated"):
        worn = WORN if fault else 0
        for to, (letter, before) in NEXT.items():
            best = _least(*[paths[b] for b in before])
            if initial == letter:
                new[to] = _least(new[to], _longer(best, worn, "K"))
            if to != SYSTEM:
                new[to] = _least(new[to], _longer(best, REROLE + worn, "R"))
    return close(new)


class Conversation:
    """One conversation on its way through a task."""

    def __init__(self, conv_id, emit=None):
        self.conv_id, self.emit, self.paths = conv_id, emit, close([(0, ""), None, None, None])
        self.open, self.audit, self.state, self.place, self.digest = [], [], START, 0, hashlib.sha256()
        self.counts, self.illegal, self.last, self.rows, self.settle = {"blank": 0, "duplicate": 0, "truncated": 0}, 0, None, 0, SETTLE
        self.first_turn = self.last_turn = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if turn is not None and (self.last_turn is None or turn != self.last_turn):
            self.first_turn, self.last_turn, self.turns = turn if self.first_turn is None else self.first_turn, turn, self.turns + 1
        initial = role[:1]
        if self.rows and self.last + initial not in LEGAL:
            self.illegal += 1
        if fault:
            self.counts[fault] += 1
        self.last, self.rows = initial, self.rows + 1
        self.paths = step(self.paths, initial, fault)
        self.open.append((role, text if fault in (None, "truncated") else ""))
        if len(self.open) >= self.settle:
            self._settle()

    def _settle(self) -> None:
        """Writes out what the paths that can still win have in common."""
        start, system, _, assistant = self.paths
        # whatever follows the start can follow an assistant turn: at worst a system row is deleted that the start would keep
        if start and start[0] > assistant[0] + DELETE:
            self.paths[START] = None
        if system and system[0] > assistant[0]:
            self.paths[SYSTEM] = None
        common = os.path.commonprefix([p[1] for p in self.paths if p])
        self._write(common)
        self.paths = [p and (p[0], p[1][len(common) :]) for p in self.paths]
        self.settle = max(SETTLE, 2 * len(self.open))

    def _write(self, edits: str) -> None:
        taken = 0
        for edit in edits:
            role, text = ("", "") if edit == "I" else self.open[taken]
            taken += edit != "I"
            if edit == "D":
                continue
            if edit == "K":
                self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            else:
                self.state = ASSISTANT if self.state == USER else USER
                role = ROLES[self.state]
            self.digest.update(f"{chr(10) if self.place else ''}{role}:{text}".encode())
            if self.emit:
                self.emit(self.conv_id, self.place, edit, role, text)
            self.place += 1
        self.audit.append(edits)
        del self.open[:taken]

    def end(self) -> tuple:
        cost, rest = _least(self.paths[START], self.paths[ASSISTANT])
        self._write(rest)
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.counts.values(), self.illegal, cost, "".join(self.audit), self.digest.hexdigest())


def _walk(turns: DataFrame, columns: str, whole: bool) -> DataFrame:
    """Repaired turns (``whole``) or a summary for each conversation."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"conv_id {kind}, {columns}")
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chars, now = [], 0, None

        def emit(*row) -> None:
            nonlocal chars
            out.append(row)
            chars += len(row[-1])

        def batch() -> pa.RecordBatch:
            nonlocal chars
            made = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), types, strict=True)], schema=types)
            out.clear()
            chars = 0
            return made

        for rows in batches:
            for conv_id, present, turn, role, text, fault in zip(*[c.to_pylist() for c in rows.columns], strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        summary = now.end()
                        if not whole:
                            emit(*summary)
                    now = Conversation(conv_id, emit if whole else None)
                if present:
                    now.add(turn, role, text, fault)
                if len(out) >= BATCH or chars >= BATCH_CHARS:
                    yield batch()
        if now is not None:
            summary = now.end()
            if not whole:
                emit(*summary)
        if out:
            yield batch()

    return ordered(turns).mapInArrow(run, schema)


def summaries(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of (conv_id, present, turn, role, text)."""
    return _walk(turns, SUMMARY, False)


def repaired(turns: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of the repaired conversations, in place order."""
    return _walk(turns, TURNS, True)


def as_turns(conversations: DataFrame) -> DataFrame:
    """Rows of a conversation table as they are, for :func:`summaries` and :func:`repaired`."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", F.lit(True).alias("present"), "turn", plain("role"), plain("text"))
