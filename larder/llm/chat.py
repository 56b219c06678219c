"""Chat formatting (operator 7): minimum-cost role repair.

A legal conversation is: at most one system message, then user and assistant
messages in turn, beginning with the user and ending with the assistant.  A
dynamic program over this automaton repairs a conversation at least cost:
each turn is kept, relabelled, or merged into the message before it, and
empty messages may be inserted before a turn or at the end.  Costs are
``COSTS``; of repairs that cost the same the choice is fixed (the lower state
number when tracing back).

The program is a min-plus product of 4 x 4 matrices, and such products may be
taken in any grouping.  A conversation of any length is therefore cut into
segments of ``SEGMENT`` turn numbers: every segment gives one matrix, the few
matrices of a conversation fix the state at each segment's ends, and every
segment then traces its own turns back.  No task holds more than a segment's
turns, even of a conversation with a third of all rows.

Rendering is by piece: one row a turn (or inserted message) with its part of
the rendered text: the header where a message begins, the text, the end mark
where it ends.  A conversation's rendered sequence is the concatenation of
``rendered`` in the order of ``turn_no``, ``piece``.  A message's end mark
stands before the next header, so a piece needs no look at what follows.

Defined results: roles are compared without white space at the ends and in
lower case; other or null roles have no cheap reading and are relabelled.
Null text is empty.  Turns are ordered by turn (null first), then by a hash
of role and text; repeated rows are separate turns.  A segment with too many
rows of the same turn numbers is cut further by turn and hash.  A null conversation id is a
conversation like any other; an empty table gives no rows; further columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

ROLES = ("", "system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
# Which message may follow which.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
COSTS = {"merge": 1.0, "relabel": 3.0, "insert": 2.0}
SEGMENT_BITS = 12
SEGMENT = 1 << SEGMENT_BITS
HEADER, END_MARK = "<|{}|>\n", "<|end|>\n"


def _fill(state: int, target: int) -> list[int] | None:
    """Fewest messages to insert after ``state`` so that ``target`` may follow."""
    paths = [[state]]
    for _ in range(4):
        for path in paths:
            if target in NEXT[path[-1]]:
                return path[1:]
        paths = [p + [n] for p in paths for n in NEXT[p[-1]]]
    return None


FILLS = {(s, t): _fill(s, t) for s in range(4) for t in range(1, 4)}
# Messages to insert at the end, so that the assistant has the last word.
ENDS = {START: [], ASSISTANT: []} | {s: FILLS[s, ASSISTANT] + [ASSISTANT] for s in (SYSTEM, USER)}


def turn_costs(role: int) -> list[list[tuple[float, str]]]:
    """[state before][state after]: least cost of a turn of ``role`` (0: unknown), and its action."""
    table = []
    for s in range(4):
        row = [(np.inf, "")]
        for t in range(1, 4):
            named = 0.0 if t == role else COSTS["relabel"]
            options = []
            if FILLS[s, t] is not None:
                options.append((named + COSTS["insert"] * len(FILLS[s, t]),
                                "keep" if t == role else "relabel"))
            if s == t:
                options.append((named + COSTS["merge"],
                                "merge" if t == role else "merge relabelled"))
            row.append(min(options, key=lambda o: o[0], default=(np.inf, "")))
        table.append(row)
    return table


TURNS = [turn_costs(r) for r in range(4)]
_MATRICES = [np.array([[c for c, _ in row] for row in table]) for table in TURNS]
_END_COST = np.array([COSTS["insert"] * len(ENDS[s]) for s in range(4)])


def segment_matrix(roles: list[int]) -> np.ndarray:
    """Min-plus product of the turns' cost matrices."""
    total = np.where(np.eye(4, dtype=bool), 0.0, np.inf)
    for role in roles:
        total = (total[:, :, None] + _MATRICES[role][None, :, :]).min(1)
    return total


def trace(roles: list[int], entry: int, leave: int) -> list[tuple[int, int, str]]:
    """(state before, state after, action) of every turn on the cheapest way through."""
    cost = [[np.inf] * 4]
    cost[0][entry] = 0.0
    for role in roles:
        before, table = cost[-1], TURNS[role]
        cost.append([min(before[s] + table[s][t][0] for s in range(4)) for t in range(4)])
    out, t = [], leave
    for i in range(len(roles) - 1, -1, -1):
        table = TURNS[roles[i]]
        s = min(range(4), key=lambda s: cost[i][s] + table[s][t][0])
        out.append((s, t, table[s][t][1]))
        t = s
    return out[::-1]


def _groups(batches, n_key: int):
    """Runs of rows (as tuples) with equal first ``n_key`` columns, from sorted batches."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:n_key] != key:
                if rows:
                    yield rows
                key, rows = row[:n_key], []
            rows.append(row)
    if rows:
        yield rows


def _batched(rows, schema: pa.Schema, size: int = 5_000):
    part = []
    for row in rows:
        part.append(row)
        if len(part) >= size:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), f.type) for c, f in zip(zip(*part), schema)], schema=schema)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def _matrices(batches):
    schema = pa.schema([("conv", pa.string()), ("a", pa.int64()), ("b", pa.int64()),
                        ("n", pa.int64()), ("matrix", pa.list_(pa.float64()))])
    return _batched(((*rows[0][:3], len(rows), segment_matrix([r[3] for r in rows]).ravel()
                      .tolist()) for rows in _groups(batches, 3)), schema)


def _boundaries(batches):
    """States at the segments' ends, for all segments of a conversation in order."""
    schema = pa.schema([("conv", pa.string()), ("a", pa.int64()), ("b", pa.int64()),
                        ("entry", pa.int32()), ("leave", pa.int32()), ("offset", pa.int64()),
                        ("last", pa.bool_())])

    def rows():
        for segments in _groups(batches, 1):
            matrices = [np.array(s[4]).reshape(4, 4) for s in segments]
            forward = [np.array([0.0, np.inf, np.inf, np.inf])]
            for m in matrices:
                forward.append((forward[-1][:, None] + m).min(0))
            leave = int(np.argmin(forward[-1] + _END_COST))
            ways = []
            for k in range(len(segments) - 1, -1, -1):
                entry = int(np.argmin(forward[k] + matrices[k][:, leave]))
                ways.append((entry, leave))
                leave = entry
            offset = 0
            for k, (s, (entry, leave)) in enumerate(zip(segments, ways[::-1])):
                yield (*s[:3], entry, leave, offset, k == len(segments) - 1)
                offset += s[3]
    return _batched(rows(), schema)


def _pieces(batches):
    """Rendered pieces of every segment whose boundary states are known."""
    schema = pa.schema([("conv", pa.string()), ("turn_no", pa.int64()), ("piece", pa.int32()),
                        ("role", pa.string()), ("action", pa.string()),
                        ("rendered", pa.string())])

    def opened(before: int, state: int, text: str) -> str:
        return (END_MARK if before else "") + HEADER.format(ROLES[state]) + text

    def rows():
        for segment in _groups(batches, 3):
            conv, _, _, _, _, entry, leave, offset, last = segment[0]
            way = trace([r[3] for r in segment], entry, leave)
            for i, (row, (s, t, action)) in enumerate(zip(segment, way)):
                piece, text = 0, row[4] or ""
                if action.startswith("merge"):
                    yield conv, offset + i, 0, ROLES[t], action, "\n" + text
                else:
                    for state in FILLS[s, t]:
                        yield (conv, offset + i, piece, ROLES[state], "insert",
                               opened(s, state, ""))
                        s, piece = state, piece + 1
                    yield conv, offset + i, piece, ROLES[t], action, opened(s, t, text)
                piece += 1
                if last and i == len(segment) - 1:
                    for state in ENDS[t]:
                        yield (conv, offset + i, piece, ROLES[state], "insert",
                               opened(t, state, ""))
                        t, piece = state, piece + 1
                    yield conv, offset + i, piece, "", "end", END_MARK
    return _batched(rows(), schema)


def repair(conversations: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """conv_id, turn_no, piece, role, action, rendered: the repaired conversations."""
    role = F.lower(F.trim(F.coalesce(F.col("role"), F.lit(""))))
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63)))
    turns = conversations.select(
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null"))
        .alias("conv"), turn.alias("turn"), F.xxhash64("role", "text").alias("hash"),
        sum((F.when(role == r, i).otherwise(0) for i, r in enumerate(ROLES) if i), F.lit(0))
        .alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.shiftleft(F.shiftright(turn, segment_bits), segment_bits).alias("a"))
    full = (turns.groupBy("conv", "a").agg(F.count(F.lit(1)).alias("rows"))
            .where(F.col("rows") > (4 << segment_bits))
            .select("conv", "a", F.lit(True).alias("full")))
    turns = turns.join(full, ["conv", "a"], "left").select(
        "conv", F.when(F.col("full"), F.col("turn")).otherwise(F.col("a")).alias("a"),
        F.when(F.col("full"), F.shiftright("hash", 52)).otherwise(F.lit(0)).cast("long").alias("b"),
        "turn", "hash", "role", "text")
    key, order = ["conv", "a", "b"], ["conv", "a", "b", "turn", "hash"]
    matrices = (turns.select(*order, "role").repartition(*key).sortWithinPartitions(*order)
                .select(*key, "role").mapInArrow(
                    _matrices, "conv string, a long, b long, n long, matrix array<double>"))
    ways = stored(matrices.repartition("conv").sortWithinPartitions(*key).mapInArrow(
        _boundaries, "conv string, a long, b long, entry int, leave int, offset long, "
        "last boolean"), "chat-boundaries")
    pieces = (turns.join(ways, key).repartition(*key).sortWithinPartitions(*order)
              .select(*key, "role", "text", "entry", "leave", "offset", "last")
              .mapInArrow(_pieces, "conv string, turn_no long, piece int, role string, "
                                   "action string, rendered string"))
    conv_id = conversations.schema["conv_id"].dataType
    return pieces.select(
        F.when(F.col("conv") != "null", F.expr("substring(conv, 2)")).cast(conv_id)
        .alias("conv_id"), "turn_no", "piece", "role", "action", "rendered")
