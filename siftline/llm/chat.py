"""Conversations made legal at least cost, and rendered.

A dynamic programme over an automaton of legal turns chooses for each turn whether to keep its role,
give it another, merge it into the turn before, or put an empty turn in front. Its step is a small
matrix in the (min, +) algebra, so a conversation of any length is split among tasks: each task sums
its run of turns up, the runs that touch a border are chained, and each task then replays its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.session import checkpointed

#: Automaton states: what was emitted last.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = {v: k for k, v in ROLES.items()}
#: The roles that may follow a state.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Costs: another role, a merge into a turn of the same role or of another, an inserted empty turn.
RELABEL, MERGE_SAME, MERGE_OTHER, INSERT = 3, 1, 4, 2
_FAR = 1 << 40


def _moves(role: int | None) -> list[tuple[int, int, int, str, int | None]]:
    """State, next state, cost, action and inserted role for a turn; earlier moves win ties."""
    moves = []
    for state in range(4):
        for to in LEGAL[state]:
            moves.append((state, to, 0 if to == role else RELABEL, "keep" if to == role else "relabel", None))
        if state:
            moves.append((state, state, MERGE_SAME if state == role else MERGE_OTHER, "merge", None))
        for between in LEGAL[state]:
            for to in LEGAL[between]:
                cost = INSERT + (0 if to == role else RELABEL)
                moves.append((state, to, cost, "keep" if to == role else "relabel", between))
    return moves


_MOVES = {role: _moves(role) for role in (None, SYSTEM, USER, ASSISTANT)}
#: Cost to end in a state: a conversation ends with the assistant; else an empty turn is appended.
_END = {START: 0, SYSTEM: 2 * INSERT, USER: INSERT, ASSISTANT: 0}
_TAIL = {START: [], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}


def _forward(costs: list[int], roles: list[int | None]) -> tuple[list[int], list[list[tuple | None]]]:
    """Costs by state after the turns, and for each turn the move that reaches each state."""
    back = []
    for role in roles:
        after, how = [_FAR] * 4, [None] * 4
        for move in _MOVES[role]:
            price = costs[move[0]] + move[2]
            if price < after[move[1]]:
                after[move[1]], how[move[1]] = price, move
        costs = after
        back.append(how)
    return costs, back


def _matrix(roles: list[int | None]) -> np.ndarray:
    rows = [[0 if s == t else _FAR for t in range(4)] for s in range(4)]
    return np.array([_forward(row, roles)[0] for row in rows], np.int64)


def _steps(roles: list[int | None], costs: list[int], end: int) -> list[tuple]:
    _, back = _forward(costs, roles)
    chosen = []
    for how in reversed(back):
        move = how[end]
        chosen.append(move)
        end = move[0]
    return chosen[::-1]


def repaired(spans: DataFrame) -> DataFrame:
    """Every turn with its role after the repair and its piece of the rendered conversation.

    ``spans`` has ``conv_id``, ``turn``, ``role`` and ``text``. The pieces of a conversation, in the
    order of ``turn`` (then of a hash of role and text), joined end to end are its rendering. A role
    is read in lower case without spaces around it; an unknown or null one fits no role and is
    relabelled or merged. A null text is empty. Rows with a null conversation form one
    conversation; null turns come first; repeated rows are turns of their own. An appended empty
    turn is part of the last turn's piece. Other columns are not read.
    """
    rows = spans.select("conv_id", "turn", F.lower(F.trim("role")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64(F.coalesce("role", F.lit("")), "text"))
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = ("conv_id", "turn", "tie")
    rows = checkpointed(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys))
    ids = rows.schema["conv_id"].dataType.simpleString()
    turns = rows.schema["turn"].dataType.simpleString()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[int | None], list[tuple]]]:
        held, name, any_ = [], None, False
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                if any_ and row[0] != name:
                    yield name, [ROLES.get(r[2]) for r in held], held
                    held = []
                held.append(row)
                name, any_ = row[0], True
        if held:
            yield name, [ROLES.get(r[2]) for r in held], held

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for name, roles, _ in runs(batches):
            found = (name, _matrix(roles).ravel().tolist())
            first, last = first or found, found
        if first:
            both = [first, last]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([TaskContext.get().partitionId()] * 2, pa.int32()),
                    pa.array([0, 1], pa.int32()),
                    pa.array([b[0] for b in both]).cast(kinds[ids]),
                    pa.array([b[1] for b in both], pa.list_(pa.int64())),
                ],
                names=["part", "side", "conv_id", "costs"],
            )

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    found = rows.mapInArrow(borders, f"part int, side int, conv_id {ids}, costs array<long>").collect()
    entry, leave = _chained(found)  # two small matrices a part
    shared = rows.sparkSession.sparkContext.broadcast((entry, leave))

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), []
        entries, leaves = shared.value
        for at, (name, roles, held) in enumerate(runs(batches)):
            costs = entries.get(part, _begin()) if at == 0 else _begin()
            after, _ = _forward(costs, roles)
            own_end = min(range(4), key=lambda s: after[s] + _END[s])
            end, closes = leaves.get((part, name), (own_end, True))
            steps = _steps(roles, costs, end)
            for i, (row, step) in enumerate(zip(held, steps, strict=True)):
                tail = _TAIL[end] if closes and i == len(held) - 1 else []
                out.append((row[0], row[1], row[2], *_rendered(row, step, tail)))
            if len(out) > 4_000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        types = [kinds[ids], kinds[turns], *[pa.string()] * 4, pa.int32(), pa.string()]
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    names = ["conv_id", "turn", "role", "new_role", "action", "inserted", "cost", "piece"]
    schema = f"conv_id {ids}, turn {turns}, role string, new_role string, action string, inserted string, cost int, piece string"
    return rows.mapInArrow(replay, schema)


def _begin() -> list[int]:
    return [0, _FAR, _FAR, _FAR]


def _chained(found: list) -> tuple[dict, dict]:
    """State (as costs) that the first run of each part begins in, and the end of each run that goes on or came in.

    Parts hold ranges of conversations in order, so a run goes on when the next part begins with the
    same conversation.
    """
    runs: list[tuple[int, object, np.ndarray]] = []
    for r in sorted(found, key=lambda r: (r["part"], r["side"])):
        run = (r["part"], r["conv_id"], np.array(r["costs"]).reshape(4, 4))
        if not runs or runs[-1][:2] != run[:2]:
            runs.append(run)
    entry, leave = {}, {}
    chain: list[tuple[int, object, np.ndarray]] = []

    def close() -> None:
        costs, before = np.array(_begin()), []
        for _, _, matrix in chain:
            before.append(costs)
            costs = (costs[:, None] + matrix).min(axis=0)
        end = min(range(4), key=lambda s: costs[s] + _END[s])
        for (part, name, matrix), costs in zip(reversed(chain), reversed(before), strict=True):
            leave[part, name] = (end, part == chain[-1][0])
            end = int((costs + matrix[:, end]).argmin())
            if part != chain[0][0]:
                entry[part] = [0 if state == end else _FAR for state in range(4)]

    for run in runs:
        if chain and chain[-1][1] != run[1]:
            close()
            chain = []
        chain.append(run)
    if chain:
        close()
    return entry, leave


def _rendered(row: tuple, step: tuple, tail: list[int]) -> tuple[str, str, str | None, int, str]:
    state, to, cost, action, between = step
    head = lambda role: f"<|{NAMES[role]}|>\n"
    if action == "merge":
        piece = "\n\n" + row[3]
    else:
        closed = "<|end|>\n" if state else ""
        piece = closed + (head(between) + "<|end|>\n" if between else "") + head(to) + row[3]
    for role in tail:
        piece += "<|end|>\n" + head(role)
    return NAMES[to], action, NAMES.get(between), cost + INSERT * len(tail), piece
