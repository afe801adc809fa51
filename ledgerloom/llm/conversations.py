"""Conversation structure repair (operator 13): a secondary-sorted stream with a small dynamic program.

A conversation is the rows of one id by turn (nulls first; rows of one turn by role and text, in UTF-8). A row's first fault
counts: blank (no character but ASCII white space), duplicate (role and text stand earlier), truncated (the last
character that is not white space is none of ``.!?``). The cheapest edits are sought after which the initials of the roles read ``(s?(ua)+)?``:
keep a row (0), rerole it to user or assistant (3), delete it (4; blank and duplicate rows must go), insert a user or assistant row without text (3); a truncated row that stays costs 3.
Of equally cheap edits those whose initials (K, R, D, I, in order) come first in ASCII are taken.

Rows move once, dealt by conversation. Inside a partition Spark sorts them three times, spilling to disk as it does for any sort:

1. by role and text, where equal rows meet and all but the first are duplicates;
2. by falling turn: a stream walks back and knows, for each of the four states (nothing yet, s, u, a), the least cost from a row to the end. That
   vector, less its minimum, has few values, so each step is a lookup. It gives every row a number: its best edit in each state. These backpointers
   are a column of the rows, and go where the rows go: into Spark's sort buffers, and from there to disk in giant conversations;
3. by rising turn: a second stream follows the backpointers from the first state, and emits the edits (``repair``) or digests them (``summarize``).

Both streams cross Arrow batches and hold one state, never a conversation; ``summarize`` also holds an audit of one byte for each edit, which
is its result. SHA-256 of a whole conversation is sequential, so its rows pass through one task, as a stream.

Inserting right before deleting is never tried: deleting first costs as much and its initials come first.

Nulls: a null role or text counts as one space. Rows with a null conversation id are one conversation, of id null. Roles other than
those that begin with s, u or a cannot be kept. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

RETYPE, DELETE, INSERT, CUT = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}  # the role that an inserted or reroled row takes
ROLE = {"u": "user", "a": "assistant"}
CLOSE = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}  # what the end of a conversation still needs
EDITS = ("D", "IIK", "IIR", "IK", "IR", "K", "R")  # in ASCII order
GONE, BLANK, DUPLICATE, TRUNCATED, SOUND = range(5)  # what a row is; one that is gone only tells that its conversation exists

WHITE = " \t\n\x0b\x0c\r"


def follow(state: int, edit: str, initial: str) -> int | None:
    """The state after the edit of a row, None if it is not allowed."""
    for e in edit.replace("D", ""):
        to = initial if e == "K" else NEXT[state]
        if (state, to) not in STEP:
            return None
        state = STEP[state, to]
    return state


def price(edit: str, kind: int) -> int | None:
    if edit == "D":
        return DELETE
    if kind in (BLANK, DUPLICATE):
        return None
    return INSERT * edit.count("I") + RETYPE * edit.count("R") + CUT * (kind == TRUNCATED)


def back(costs: tuple[int, ...], kind: int, initial: str) -> tuple[tuple[int, ...], int, int]:
    """From the costs after a row (least 0) to those before it, what was taken off them, and the row's backpointers."""
    out, pointers = [], 0
    for state in range(4):
        best = None
        for number, edit in enumerate(EDITS):
            to, own = follow(state, edit, initial), price(edit, kind)
            if to is not None and own is not None and (best is None or costs[to] + own < best):
                best, chosen = costs[to] + own, number
        out.append(best)
        pointers |= chosen << 3 * state
    least = min(out)
    return tuple(c - least for c in out), least, pointers


END = tuple(INSERT * len(CLOSE[s]) for s in range(4))  # its least is 0


def _mark_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds whether the row before has the same conversation, role and text."""
    before: list | None = None
    for batch in batches:
        same = np.ones(batch.num_rows, bool)
        for i, c in enumerate(("conv", "gone", "role", "text")):
            column = batch.column(c)
            one, two = column[:-1], column[1:]
            alike = pc.or_kleene(pc.equal(one, two), pc.and_(pc.is_null(one), pc.is_null(two)))
            same[1:] &= pc.fill_null(alike, False).to_numpy(zero_copy_only=False)
            same[:1] &= before is not None and before[i] == column[0].as_py()
        if batch.num_rows:
            before = [batch.column(c)[-1].as_py() for c in ("conv", "gone", "role", "text")]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(same)], [*batch.schema.names, "again"])


def _walk_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the backpointers, the row's place from the end, and the least cost from it to the end when nothing is chosen yet."""
    known: dict[tuple, tuple] = {}
    conv, costs, total, place = None, END, 0, 0
    for batch in batches:
        pointers, places, price_now = [], [], []
        for c, kind, initial in zip(*(batch.column(x).to_pylist() for x in ("conv", "kind", "initial")), strict=True):
            if not place or c != conv:
                conv, costs, total, place = c, END, 0, 0
            place += 1
            here = 0
            if kind != GONE:
                key = costs, kind, initial if initial in ("s", "u", "a") else ""
                if key not in known:
                    known[key] = back(*key)
                costs, more, here = known[key]
                total += more
            pointers.append(here)
            places.append(place)
            price_now.append(total + costs[START])
        added = [pa.array(pointers, pa.int32()), pa.array(places, pa.int64()), pa.array(price_now, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "pointers", "place", "to_go"])


class Walk:
    """The state of one conversation on the way forward."""

    def __init__(self, conv, to_go: int):
        self.conv, self.cost, self.state = conv, to_go, START
        self.counts = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0}
        self.first = self.last = None
        self.turns = self.illegal = self.rows = 0
        self.before: str | None = None
        self.audit, self.sha, self.lines = bytearray(), hashlib.sha256(), 0

    def step(self, kind: int, initial: str, pointers: int) -> str:
        edit = EDITS[pointers >> 3 * self.state & 7]
        self.state = follow(self.state, edit, initial if initial in ("s", "u", "a") else "")
        return edit

    def see(self, turn: int | None, kind: int, initial: str) -> None:
        if kind in self.counts:
            self.counts[kind] += 1
        if turn is not None:
            if self.first is None:
                self.first = turn
            self.turns += turn != self.last
            self.last = turn
        self.illegal += self.before is not None and (self.before + initial) not in ("su", "ua", "au")
        self.before = initial

    def write(self, role: str, text: str) -> None:
        if self.lines:
            self.sha.update(b"\n")
        self.lines += 1
        self.sha.update(f"{role}:{text}".encode("utf-8", "replace"))

    def digest(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        c = self.counts
        return self.conv, gaps, c[BLANK], c[DUPLICATE], c[TRUNCATED], self.illegal, self.cost, self.audit.decode(), self.sha.hexdigest()


def _edits(walk: Walk, state: int, edit: str, role: str, text: str) -> Iterator[tuple[str, str | None, str | None]]:
    """(edit, role, text) for each edit; a deleted row has the role and text it had."""
    for e in edit:
        to = NEXT[state]
        if e in "IR":
            yield e, ROLE[to], text if e == "R" else ""
            state = STEP[state, to]
        else:
            yield e, role, text


FORWARD = ("conv", "turn", "role", "text", "kind", "initial", "pointers", "to_go")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(x).to_pylist() for x in FORWARD), strict=True)


def _table(rows: Iterator[tuple], schema: pa.Schema, most_bytes: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size > most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _summaries(rows: Iterator[tuple]) -> Iterator[tuple]:
    walk = None

    def end(w: Walk) -> tuple:
        for e, role, text in _edits(w, w.state, CLOSE[w.state], "", ""):
            w.audit += e.encode()
            w.write(role, text)
        return w.digest()

    for conv, turn, role, text, kind, initial, pointers, to_go in rows:
        if walk is None or walk.conv != conv:
            if walk:
                yield end(walk)
            walk = Walk(conv, to_go)
        if kind == GONE:
            continue
        walk.see(turn, kind, initial)
        state = walk.state
        edit = walk.step(kind, initial, pointers)
        walk.audit += edit.encode()
        for e, to_role, to_text in _edits(walk, state, edit, role, text):
            if e != "D":
                walk.write(to_role, to_text)
    if walk:
        yield end(walk)


def _repairs(rows: Iterator[tuple]) -> Iterator[tuple]:
    walk, number = None, 0

    def numbered(edits, turn, kind):
        nonlocal number
        for e, role, text in edits:
            number += 1
            fault = {BLANK: "blank", DUPLICATE: "duplicate", TRUNCATED: "truncated"}.get(kind) if e != "I" else None
            yield walk.conv, number, e, turn if e != "I" else None, role, text, fault

    for conv, turn, role, text, kind, initial, pointers, to_go in rows:
        if walk is None or walk.conv != conv:
            if walk:
                yield from numbered(_edits(walk, walk.state, CLOSE[walk.state], "", ""), None, SOUND)
            walk, number = Walk(conv, to_go), 0
        if kind != GONE:
            state = walk.state
            yield from numbered(_edits(walk, state, walk.step(kind, initial, pointers), role, text), turn, kind)
    if walk:
        yield from numbered(_edits(walk, walk.state, CLOSE[walk.state], "", ""), None, SOUND)


def _last_sign(text: Column) -> Column:
    return F.substring(F.rtrim(text, F.lit(WHITE)), -1, 1)


def _streamed(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, gone: Column | None) -> DataFrame:
    """The rows with their backpointers, by conversation and turn inside partitions."""
    space = F.lit(" ")
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), space) for c in (role_col, text_col))
    taken = rows.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        (F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))).alias("gone"),
    ).withColumn("text", F.when(F.col("gone"), "").otherwise(F.col("text")))
    id_type = taken.schema["conv"].dataType.simpleString()
    columns = f"conv {id_type}, turn long, role string, text string, gone boolean"
    alike = taken.repartition("conv").sortWithinPartitions("conv", "gone", "role", "text", F.asc_nulls_first("turn"))
    marked = alike.mapInArrow(_mark_repeats, f"{columns}, again boolean")
    last = _last_sign(F.col("text"))
    kind = (
        F.when(F.col("gone"), GONE).when(last == "", BLANK).when(F.col("again"), DUPLICATE)
        .when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    )
    judged = marked.select("conv", "turn", "role", "text", kind.alias("kind"), F.substring("role", 1, 1).alias("initial"))
    # Among equal rows the one that is no duplicate stands first; its kind has the larger number.
    falling = judged.sortWithinPartitions("conv", F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"), F.asc("kind"))
    added = "kind int, initial string, pointers int, place long, to_go long"
    walked = falling.mapInArrow(_walk_back, f"conv {id_type}, turn long, role string, text string, {added}")
    return walked.sortWithinPartitions("conv", F.desc("place"))


def _arrow(df: DataFrame, rest: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema([("conv_id", to_arrow_type(df.schema["conv"].dataType)), *rest])


def summarize(
    rows: DataFrame, gone: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """A row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows for which ``gone`` is true are left out; their conversation still has its row.
    """
    streamed = _streamed(rows, conv_col, turn_col, role_col, text_col, gone)
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = _arrow(streamed, [*((c, pa.int64()) for c in longs), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    kind = f"conv_id {streamed.schema['conv'].dataType.simpleString()}, {', '.join(f'{c} long' for c in longs)}, audit string, repaired_sha256 string"
    return streamed.mapInArrow(lambda it: _table(_summaries(_rows(it)), schema), kind)


def repair(
    rows: DataFrame, gone: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """A row per edit: conv_id, number (from 1, in order), edit, turn, role, text, fault. Those whose edit is not D are the repaired conversation."""
    streamed = _streamed(rows, conv_col, turn_col, role_col, text_col, gone)
    schema = _arrow(streamed, [("number", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string())])
    kind = f"conv_id {streamed.schema['conv'].dataType.simpleString()}, number long, edit string, turn long, role string, text string, fault string"
    return streamed.mapInArrow(lambda it: _table(_repairs(_rows(it)), schema), kind)


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text and ``gone``: every row, damaged by crc32 of ``conv_id:turn`` modulo 20; nulls count as one space.

    0 marks it as gone, 1 empties the text, 2 takes ``.!?`` out of it, 3 gives the row twice, 4 makes the role user. Rows that repeat an
    id and a turn share their damage. Conversation ids and turns stay null where they are.
    """
    space = F.lit(" ")
    conv, turn = F.col(f"`{conv_col}`"), F.col(f"`{turn_col}`")
    key = F.concat(F.coalesce(conv.cast("string"), space), F.lit(":"), F.coalesce(turn.cast("string"), space))
    plain = rows.select(
        conv.alias("conv_id"), turn.cast("long").alias("turn"), *(F.coalesce(F.col(f"`{c}`").cast("string"), space).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))),
        (F.crc32(key.cast("binary")) % 20).alias("damage"),
    )
    how = F.col("damage")
    text = F.when(how == 1, "").when(how == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(how == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    twice = plain.withColumn("time", F.explode(times))
    return twice.select("conv_id", "turn", F.when(how == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (how == 0).alias("gone"))
