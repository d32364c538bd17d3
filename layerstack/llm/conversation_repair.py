"""Cheapest repairs of conversations, by a stream of their turns in sorted order.

A conversation is legal if its roles' initials are `(s?(ua)+)?`: nothing, or an optional system message and
then pairs of user and assistant. Edits: Keep a row (0), Rerole it to user or assistant (2), Delete it
(3), Insert an empty message of user or assistant anywhere (2). Blank and duplicate rows must be deleted; a
truncated row that stays adds 1. Of the cheapest lists of edits the one whose initials (D, I, K, R) come
first in ASCII order is taken.

Rows are repartitioned by conversation and sorted by turn, descending. A mapInPandas goes through them
and carries, across Arrow batches, the least cost of repairing what it has seen so far (all later turns)
for each of four states: nothing yet, after system, after user, after assistant. In a state only one role
can come next (before the first message, two), so edits and rows determine the state, and a choice is two
bits. The choices of a row take one byte. At a conversation's first row the choices are followed forwards. Choices
and messages of the conversation are held in memory up to `HELD_BYTES` each and beyond that in a
temporary file of the task that goes with it, so memory does not grow with a conversation (but for its
audit, a byte for each edit, which is part of the result).

Which rows are duplicates is a window over the same partitions (conversation, role, text), with no shuffle of its own.

Defined results: nulls in role and text are one space; null turns come first and do not count for gaps;
null conversation ids are one conversation; rows of equal turn are ordered by role, text; equal rows are
duplicates of the first of them; other columns are left out; an empty table gives an empty table.
Turns are integers; conversation ids are of a type that goes to text and back.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: ASCII white space, as in common.WORD.
BLANKS = " \t\n\x0b\x0c\r"
#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Bytes of choices, and of messages, of a conversation that stay in memory.
HELD_BYTES = 8_000_000

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a message of the one role that can come next leads to.
THEN = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Initials of the edits in ASCII order; a choice is a place in it.
EDITS = "DIKR"
D, I, K, R = range(4)
LEGAL_PAIRS = {"su", "ua", "au"}
MOST_LONG = (1 << 63) - 1

SUMMARY = (
    "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)
MESSAGES = "key string, at long, edit string, role string, text string"
#: A held message: its choices, bytes of its role and of its text.
RECORD = struct.Struct("<BIQ")


def kept_state(state: int, initial: str) -> int | None:
    """The state after a kept message, or None where it cannot stay."""
    if state == START and initial == "s":
        return SYSTEM
    then = THEN[state]
    return then if initial == ROLES[then][0] else None


def step(costs: list[int], initial: str, gone: bool, cut: bool) -> tuple[list[int], int]:
    """Costs by state before a row, from those after it; and the choices, two bits a state."""
    best, choice = [0] * 4, [D] * 4
    for q in range(4):
        best[q] = DELETE + costs[q]
        if gone:
            continue
        stays = TRUNCATED if cut else 0
        then = kept_state(q, initial)
        if then is not None and stays + costs[then] < best[q]:
            best[q], choice[q] = stays + costs[then], K
        other = REROLE + stays + costs[THEN[q]]
        if other < best[q]:
            best[q], choice[q] = other, R
    # Inserts lead from a state to another before the same row; two in a row lead back, dearer.
    out = [min(best[q], INSERT + best[THEN[q]], 2 * INSERT + best[THEN[THEN[q]]]) for q in range(4)]
    packed = 0
    for q in range(4):
        inserted = INSERT + out[THEN[q]]
        if inserted < best[q] or (inserted == best[q] and choice[q] > I):
            choice[q] = I
        packed |= choice[q] << (2 * q)
    return out, packed


def last_costs() -> list[int]:
    """Costs after the last row: what must still be inserted."""
    return [0, 2 * INSERT, INSERT, 0]


class Conversation:
    """What is known of the turns of one conversation, from the last one back."""

    def __init__(self, key: str | None):
        self.key = key
        self.costs = last_costs()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.high = self.low = self.later = None
        self.choices = tempfile.SpooledTemporaryFile(HELD_BYTES)
        self.messages = tempfile.SpooledTemporaryFile(HELD_BYTES)

    def add(self, turn: str | None, role: str, text: str, blank: bool, duplicate: bool, cut: bool) -> None:
        if turn is not None:
            number = int(turn)
            self.turns += number != self.low
            self.low = number
            self.high = number if self.high is None else self.high
        initial = role[:1]
        if self.later is not None:
            self.illegal += initial + self.later not in LEGAL_PAIRS
        self.later = initial
        gone = blank or duplicate
        self.blank += blank
        self.duplicate += duplicate and not blank
        self.truncated += cut and not gone
        self.costs, packed = step(self.costs, initial, gone, cut and not gone)
        role_bytes, text_bytes = role.encode(), text.encode()
        self.choices.write(RECORD.pack(packed, len(role_bytes), len(text_bytes)))
        self.messages.write(role_bytes)
        self.messages.write(text_bytes)

    def edits(self) -> Iterator[tuple[str, str, str]]:
        """Edit, role and text of each step from the first turn on; deleted rows with what they were."""
        state = START
        record, place = self.choices.tell(), self.messages.tell()
        while record:
            record -= RECORD.size
            self.choices.seek(record)
            packed, role_size, text_size = RECORD.unpack(self.choices.read(RECORD.size))
            place -= role_size + text_size
            self.messages.seek(place)
            role = self.messages.read(role_size).decode()
            text = self.messages.read(text_size).decode()
            while (choice := packed >> (2 * state) & 3) == I:
                state = THEN[state]
                yield "I", ROLES[state], ""
            if choice == K:
                state = kept_state(state, role[:1])
            elif choice == R:
                state = THEN[state]
                role = ROLES[state]
            yield EDITS[choice], role, text
        while state not in (START, ASSISTANT):
            state = THEN[state]
            yield "I", ROLES[state], ""

    def summary(self) -> tuple:
        audit, digest, first = bytearray(), hashlib.sha256(), True
        for edit, role, text in self.edits():
            audit += edit.encode()
            if edit != "D":
                digest.update(f"{role}:{text}".encode() if first else f"\n{role}:{text}".encode())
                first = False
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.turns
        return (
            self.key, min(gaps, MOST_LONG), self.blank, self.duplicate, self.truncated, self.illegal,
            self.costs[START], audit.decode(), digest.hexdigest(),
        )

    def close(self) -> None:
        self.choices.close()
        self.messages.close()


def _conversations(frames: Iterator[pd.DataFrame]) -> Iterator[Conversation]:
    """Conversations of a sorted stream, each as soon as its first turn has been seen."""
    held: Conversation | None = None
    for frame in frames:
        for key, *row in zip(*[frame[c].tolist() for c in frame.columns]):
            if held is None or held.key != key:
                if held is not None:
                    yield held
                    held.close()
                held = Conversation(key)
            held.add(*row)
    if held is not None:
        yield held
        held.close()


def _summaries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in SUMMARY.split(", ")]
    rows, size = [], 0
    for conversation in _conversations(frames):
        rows.append(conversation.summary())
        size += 300 + len(rows[-1][7])
        if size > HELD_BYTES:
            yield pd.DataFrame(rows, columns=names)
            rows, size = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=names)


def _messages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in MESSAGES.split(", ")]
    rows, size = [], 0
    for conversation in _conversations(frames):
        at = 0
        for edit, role, text in conversation.edits():
            if edit == "D":
                continue
            rows.append((conversation.key, at, edit, role, text))
            at += 1
            size += 300 + len(text)
            if size > HELD_BYTES:
                yield pd.DataFrame(rows, columns=names)
                rows, size = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=names)


def sorted_turns(
    df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Rows with their faults, the turns of a conversation in one partition, the last one first."""
    space = F.lit(" ")
    rows = df.select(
        F.col(f"`{conv_id}`").cast("string").alias("key"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), space).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), space).alias("text"),
    ).repartition("key")
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    ended = body.endswith(".") | body.endswith("!") | body.endswith("?")
    same = Window.partitionBy("key", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.withColumns(
        {
            "blank": body == "",
            "duplicate": F.row_number().over(same) > 1,
            "cut": ~ended,
        }
    )
    back = [F.col(c).desc() for c in ("role", "text", "duplicate")]
    return rows.sortWithinPartitions(
        F.col("key").asc_nulls_first(), F.col("turn").desc_nulls_last(), *back
    ).select("key", F.col("turn").cast("string").alias("turn"), "role", "text", "blank", "duplicate", "cut")


def repair(
    df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    gaps counts turn numbers that are missing between the smallest and the largest; blank, duplicate and truncated
    count rows by their first fault; illegal counts neighbours whose roles cannot follow each other.
    """
    out = sorted_turns(df, conv_id, turn, role, text).mapInPandas(_summaries, SUMMARY)
    return out.select(_original(df, conv_id), *out.columns[1:])


def repaired(
    df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The messages of the repaired conversations: id, at (from 0), edit (K, R or I), role, text."""
    out = sorted_turns(df, conv_id, turn, role, text).mapInPandas(_messages, MESSAGES)
    return out.select(_original(df, conv_id), *out.columns[1:])


def _original(df: DataFrame, conv_id: str) -> Column:
    return F.col("key").cast(df.select(F.col(f"`{conv_id}`")).schema[0].dataType).alias(conv_id)


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with faults that a checksum of conversation and turn picks.

    Of twenty remainders, 0 drops the row, 1 empties its text, 2 removes its full stops, exclamation and question
    marks, 3 repeats it and 4 makes it the user's. Nulls are one space.
    """
    space = F.lit(" ")
    part = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    role, text = part("role"), part("text")
    return (
        df.select(
            "conv_id", "turn",
            F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
            F.when(kind == 1, F.lit(""))
            .when(kind == 2, F.regexp_replace(text, "[.!?]", ""))
            .otherwise(text).alias("text"),
            F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
        )
        .where("copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .drop("copy", "copies")
    )


def with_lost(ids: DataFrame, repairs: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """repairs with a row for each further conversation of ids: one without rows, which costs nothing."""
    all_ids = ids.select(F.col(conv_id).alias("_id")).distinct()
    joined = all_ids.join(repairs, F.col("_id").eqNullSafe(F.col(conv_id)), "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in repairs.columns[1:7]}
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select(
        F.col("_id").alias(conv_id),
        *[c.alias(name) for name, c in zero.items()],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )
