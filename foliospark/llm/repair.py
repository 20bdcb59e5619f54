"""Repair of conversations: the cheapest edits that make the roles alternate.

A conversation is sound when its roles are ``(system? (user assistant)+)?``.  Its rows are kept
(free), get another role (3), or are deleted (4); rows may be inserted (3); a blank row or a
repeated one has to go, and a row cut off in mid-sentence costs 3 more if it stays.

Rows are dealt by conversation and sorted by turn, then streamed through ``mapInPandas``.  The
states of the search are the four points of the pattern: nothing yet, behind a system row, behind a
user row, behind an assistant row.  Their costs are carried from row to row and over Arrow
batches; a row leaves a bit mask of the edits that are cheapest into each state.  At the end of
a conversation the masks are read backwards for the states that lie on a cheapest way, and
forwards for the least letters among those.  A conversation beyond ``held_bytes`` writes its masks
and rows in blocks to the shared folder and reads them back block by block, so a task's
memory does not grow with a conversation but for two bytes a row: its audit and its states.

The costs are carried relative to the cheapest one.  A state 16 dearer than the cheapest is
dropped: any state leads to any later point of the pattern by an insertion and a deletion at most
(7), so such a state is on no cheapest way, not even as a tie.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .files import open_store, output_folder, own_name

BLANKS = " \t\n\x0b\x0c\r"
SOUND, BLANK, DUPLICATE, TRUNCATED, ABSENT = 0, 1, 2, 3, 4
HELD_BYTES = 1 << 25
BLOCK_ROWS = 1 << 16

FAR = 1 << 30
INITIALS = ("s", "u", "a")
#: the state behind a user or assistant row put at each state, and that row's role
AHEAD = (2, 2, 3, 2)
ROLES = ("", "", "user", "assistant")
#: masks: one bit per letter and state that the edit starts from; a kept system row has its own
DELETE, INSERT, KEEP, REROLE, KEEP_SYSTEM = 0, 4, 8, 12, 1 << 16
ENDS = (0, 3)


def _insertions(costs: list[int]) -> int:
    """Lower ``costs`` by insertions; the mask of the cheapest ones."""
    for _ in range(2):
        for state, target in enumerate(AHEAD):
            costs[target] = min(costs[target], costs[state] + 3)
    return sum(1 << (INSERT + s) for s, t in enumerate(AHEAD) if costs[s] < FAR and costs[t] == costs[s] + 3)


START = [0, FAR, FAR, FAR]
START_MASK = _insertions(START)


@lru_cache(maxsize=1 << 16)
def advance(costs: tuple[int, ...], initial: str, fault: int) -> tuple[int, tuple[int, ...], int]:
    """(cost added to all, costs behind the row, its mask) from the costs before a row."""
    edits = []  # (bit, target, cost)
    for state, cost in enumerate(costs):
        if cost >= FAR:
            continue
        edits.append((1 << (DELETE + state), state, cost + 4))
        if fault in (BLANK, DUPLICATE):
            continue
        stay = cost + (3 if fault == TRUNCATED else 0)
        edits.append((1 << (REROLE + state), AHEAD[state], stay + 3))
        if state == 0 and initial == "s":
            edits.append((KEEP_SYSTEM, 1, stay))
        elif initial == ROLES[AHEAD[state]][0]:
            edits.append((1 << (KEEP + state), AHEAD[state], stay))
    out = [min([c for _, t, c in edits if t == state], default=FAR) for state in range(4)]
    mask = _insertions(out)
    mask |= sum(bit for bit, t, c in edits if c == out[t])
    least = min(out)
    return least, tuple(FAR if c - least > 16 else c - least for c in out), mask


@lru_cache(maxsize=1 << 16)
def behind(alive: int, mask: int, earlier: int) -> int:
    """States before a row that lie on a cheapest way; ``earlier`` is the mask of the row before."""
    out = 0
    for state in range(4):
        ways = [(DELETE, state), (KEEP, AHEAD[state]), (REROLE, AHEAD[state])]
        if any(mask >> (kind + state) & 1 and alive >> target & 1 for kind, target in ways):
            out |= 1 << state
    if mask & KEEP_SYSTEM and alive >> 1 & 1:
        out |= 1
    return closed(out, earlier)


def closed(alive: int, mask: int) -> int:
    """With the states from which cheapest insertions lead to ``alive``."""
    for _ in range(3):
        for state, target in enumerate(AHEAD):
            if mask >> (INSERT + state) & 1 and alive >> target & 1:
                alive |= 1 << state
    return alive


class _Conversation:
    """The rows of one conversation as they come in, in memory or in blocks of two files."""

    def __init__(self, key, folder: str, held_bytes: int):
        self.key, self.folder, self.most = key, folder, held_bytes
        self.roles, self.texts, self.masks, self.size = [], [], [], 0
        self.blocks, self.files = 0, None
        self.costs, self.cost = tuple(START), 0
        self.faults = [0, 0, 0, 0, 0]
        self.illegal, self.last = 0, None
        self.turns, self.low, self.high = 0, None, None

    def add(self, turn, role, text, fault):
        if fault == ABSENT:
            return
        turn = None if turn is None else int(turn)
        self.faults[fault] += 1
        initial = role[:1] if role[:1] in INITIALS else "?"
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        added, self.costs, mask = advance(self.costs, initial, fault)
        self.cost += added
        self.roles.append(role)
        self.texts.append(text)
        self.masks.append(mask)
        self.size += len(role) + len(text) + 64
        if self.size > self.most or len(self.masks) >= BLOCK_ROWS:
            self._spill()

    def _spill(self):
        if self.files is None:
            store, path = open_store(self.folder)
            store.create_dir(path, recursive=True)
            paths = [f"{path}/{own_name(kind, '.arrow')}" for kind in ("masks", "rows")]
            schemas = pa.schema([("mask", pa.uint32())]), pa.schema([("role", pa.large_string()), ("text", pa.large_string())])
            out = [store.open_output_stream(p) for p in paths]
            pack = pa.ipc.IpcWriteOptions(compression="zstd")
            writers = [pa.ipc.new_file(o, s, options=pack) for o, s in zip(out, schemas, strict=True)]
            self.files = store, paths, out, writers
        _, _, _, (masks, rows) = self.files
        masks.write_batch(pa.RecordBatch.from_arrays([pa.array(self.masks, pa.uint32())], ["mask"]))
        columns = [pa.array(self.roles, pa.large_string()), pa.array(self.texts, pa.large_string())]
        rows.write_batch(pa.RecordBatch.from_arrays(columns, ["role", "text"]))
        self.roles, self.texts, self.masks, self.size = [], [], [], 0
        self.blocks += 1

    def _opened(self):
        """Readers of block k: its masks, and its roles and texts."""
        if self.files is None:
            return (lambda k: self.masks), (lambda k: (self.roles, self.texts)), 1, lambda: None
        if self.masks:
            self._spill()
        store, paths, out, writers = self.files
        for w, o in zip(writers, out, strict=True):
            w.close()
            o.close()
        sources = [store.open_input_file(p) for p in paths]
        masks, rows = (pa.ipc.open_file(s) for s in sources)

        def dispose():
            for s, p in zip(sources, paths, strict=True):
                s.close()
                store.delete_file(p)

        def block(k):
            batch = rows.get_batch(k)
            return batch.column(0).to_pylist(), batch.column(1).to_pylist()

        return (lambda k: masks.get_batch(k).column(0).to_pylist()), block, self.blocks, dispose

    def edits(self):
        """Yield (letter, role, text) of the least cheapest edits, in order."""
        masks, rows, blocks, dispose = self._opened()
        least = min(self.costs[s] for s in ENDS)
        self.cost += least
        alive = sum(1 << s for s in ENDS if self.costs[s] == least)
        # states on a cheapest way before each row, read backwards; a mask needs the one before it
        back, later = bytearray(), None
        for k in reversed(range(blocks)):
            for mask in reversed(masks(k)):
                alive = closed(alive, mask) if later is None else behind(alive, later, mask)
                back.append(alive)
                later = mask
        back.append(closed(alive, START_MASK) if later is None else behind(alive, later, START_MASK))
        back.reverse()

        state, layer, mask = 0, 0, START_MASK
        for k in range(blocks):
            for own, role, text in zip(masks(k), *rows(k), strict=True):
                while True:
                    ahead = AHEAD[state]
                    if own >> (DELETE + state) & 1 and back[layer + 1] >> state & 1:
                        yield "D", role, text
                        break
                    if mask >> (INSERT + state) & 1 and back[layer] >> ahead & 1:
                        state = ahead
                        yield "I", ROLES[state], ""
                        continue
                    if state == 0 and own & KEEP_SYSTEM and back[layer + 1] >> 1 & 1:
                        state = 1
                        yield "K", role, text
                    elif own >> (KEEP + state) & 1 and back[layer + 1] >> ahead & 1:
                        state = ahead
                        yield "K", role, text
                    else:
                        state = ahead
                        yield "R", ROLES[state], text
                    break
                layer, mask = layer + 1, own
        while not (state in ENDS and self.costs[state] == least):
            state = AHEAD[state]
            yield "I", ROLES[state], ""
        dispose()

    def report(self):
        audit, digest, rows = bytearray(), hashlib.sha256(), 0
        for letter, role, text in self.edits():
            audit += letter.encode()
            if letter != "D":
                digest.update(f"{chr(10) if rows else ''}{role}:{text}".encode())
                rows += 1
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.turns
        counts = self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED]
        return self.key, gaps, *counts, self.illegal, self.cost, audit.decode(), digest.hexdigest()


def _conversations(frames, folder, held_bytes):
    """Conversations of a sorted stream, each when its last row has been read."""
    now = None
    for frame in frames:
        for key, *row in zip(*(frame[c].tolist() for c in ("conv", "turn", "role", "text", "fault")), strict=True):
            if now is None or key != now.key:
                if now is not None:
                    yield now
                now = _Conversation(key, folder, held_bytes)
            now.add(*row)
    if now is not None:
        yield now


REPORT = (
    "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
TURNS = "conv string, position long, edit string, role string, text string"


def _frame(rows, schema):
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def _reported(frames, folder, held_bytes):
    rows, size = [], 0
    for conversation in _conversations(frames, folder, held_bytes):
        rows.append(conversation.report())
        size += 200 + len(rows[-1][-2])
        if size > 1 << 22:
            yield _frame(rows, REPORT)
            rows, size = [], 0
    if rows:
        yield _frame(rows, REPORT)


def _turns(frames, folder, held_bytes):
    rows, size = [], 0
    for conversation in _conversations(frames, folder, held_bytes):
        position = 0
        for letter, role, text in conversation.edits():
            if letter == "D":
                continue
            rows.append((conversation.key, position, letter, role, text))
            position, size = position + 1, size + 100 + len(text)
            if size > 1 << 22:
                yield _frame(rows, TURNS)
                rows, size = [], 0
    if rows:
        yield _frame(rows, TURNS)


def _sorted_rows(conversations: DataFrame) -> DataFrame:
    """Rows with their fault, by conversation in order of turn; one shuffle."""
    names = set(conversations.columns)
    here = F.col("present") if "present" in names else F.lit(True)
    rows = conversations.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        here.alias("present"),
    ).repartition("conv")
    # of equal rows the first in turn; dealt by conversation already, so this only sorts
    seen = Window.partitionBy("conv", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.withColumn("nth", F.row_number().over(seen))
    solid = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (
        F.when(~F.col("present"), ABSENT)
        .when(solid == "", BLANK)
        .when(F.col("nth") > 1, DUPLICATE)
        .when(~F.right(solid, F.lit(1)).isin(".", "!", "?"), TRUNCATED)
        .otherwise(SOUND)
    )
    rows = rows.withColumn("fault", fault)
    return rows.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text", "nth").select("conv", "turn", "role", "text", "fault")


def _streamed(conversations: DataFrame, work, schema: str, held_bytes: int) -> DataFrame:
    folder = output_folder(conversations.sparkSession, "repair")
    # turns travel as text, as pandas turns whole numbers beside nulls into fractions
    rows = _sorted_rows(conversations).withColumn("turn", F.col("turn").cast("string"))
    done = rows.mapInPandas(lambda frames: work(frames, folder, held_bytes), schema)
    kind = conversations.schema["conv_id"].dataType
    key = F.when(F.col("conv") != "", F.expr("substr(conv, 2)")).cast(kind)
    return done.select(key.alias("conv_id"), *[c for c in done.columns if c != "conv"])


def repair_report(conversations: DataFrame, held_bytes: int = HELD_BYTES) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``conversations`` has conv_id, turn, role, text; other columns are not looked at, except a
    boolean ``present``, whose false rows only name a conversation.  A null role or text
    reads as one space; rows without conv_id are one conversation.  Null turns come first; rows of one
    turn go by role and text.  ``audit`` holds the edits in order: K(eep), R(erole), D(elete), I(nsert).
    A conversation without rows has zeros, an empty audit and the hash of the empty text.  An
    empty table gives no rows.
    """
    return _streamed(conversations, _reported, REPORT, held_bytes)


def repaired_turns(conversations: DataFrame, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(conv_id, position, edit, role, text): the rows of the repaired conversations, as ``repair_report`` counts them."""
    return _streamed(conversations, _turns, TURNS, held_bytes)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32 of ``conv_id:turn`` modulo 20; dropped rows stay with ``present`` false.

    0 drops a row, 1 empties its text, 2 removes its ``.``, ``!`` and ``?``, 3 repeats it, 4 makes it a
    user's.  Nulls read as one space.
    """
    either = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(either[0], F.lit(":"), either[1]).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), kind.alias("kind"))
    rows = rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").when(F.col("kind") != 0, F.col("role")).alias("role"),
        F.when(F.col("kind") == 2, F.translate("text", ".!?", "")).when(F.col("kind") > 1, F.col("text")).otherwise("").alias("text"),
        (F.col("kind") != 0).alias("present"),
        F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")
