"""Chat formatting: the cheapest repair of a conversation's turns into a legal sequence, then its text.

Legal is: at most one system turn, first; then user and assistant in turn,
ending with the assistant. A turn may be merged into the one before, take
another role, or have empty turns put before it. What is cheapest follows from
dynamic programming over the last role written. A turn is a small matrix of
costs from state to state, so a conversation that is too long for a task is cut
into parts: the matrices of the parts name the states at the cuts, then each
part is repaired by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns_of, shared_dir

ROLES = ("system", "user", "assistant")
#: States: nothing written yet, or the role written last.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = {_START: (_SYSTEM, _USER), _SYSTEM: (_USER,), _USER: (_ASSISTANT,), _ASSISTANT: (_USER,)}
_LEGAL_ENDS = (_START, _ASSISTANT)
#: A conversation of more turns may be cut into several parts.
PART_TURNS = 50_000
_INF = 1 << 40


@dataclass(frozen=True)
class Costs:
    """What a merge, another role and an empty turn cost."""

    merge: int = 1
    relabel: int = 3
    insert: int = 2


def _shortest_inserts() -> dict[tuple[int, int], tuple[int, ...]]:
    """Empty turns to put between a state and a next role, fewest first found in order of roles."""
    found: dict[tuple[int, int], tuple[int, ...]] = {}
    for state in _NEXT:
        paths: list[tuple[int, ...]] = [()]
        while paths:
            path = paths.pop(0)
            for role in _NEXT[path[-1] if path else state]:
                if (state, role) not in found:
                    found[state, role] = path
                    paths.append((*path, role))
    return found


_INSERTS = _shortest_inserts()
#: Empty turns that bring a state to a legal end.
_CLOSING = {s: () if s in _LEGAL_ENDS else (*_INSERTS[s, _ASSISTANT], _ASSISTANT) for s in _NEXT}


def _moves(role: int | None, costs: Costs) -> list[tuple[int, int, int, str, tuple[int, ...]]]:
    """(from, to, cost, action, inserted roles) for a turn of this role (None: unknown); earlier ones win ties."""
    moves = []
    for state in _NEXT:
        for to in (_SYSTEM, _USER, _ASSISTANT):
            relabel = 0 if to == role else costs.relabel
            if (state, to) in _INSERTS:
                inserted = _INSERTS[state, to]
                moves.append((state, to, relabel + costs.insert * len(inserted), "append", inserted))
            if state == to:
                moves.append((state, to, relabel + costs.merge, "merge", ()))
    return sorted(moves, key=lambda m: (m[2], m[3], m[1]))


class Repairer:
    """The moves of every role, as cost matrices and as choices."""

    def __init__(self, costs: Costs):
        self.costs = costs
        self.matrix: dict[int | None, np.ndarray] = {}
        self.choice: dict[int | None, dict[tuple[int, int], tuple]] = {}
        for role in (None, _SYSTEM, _USER, _ASSISTANT):
            matrix, choice = np.full((4, 4), _INF), {}
            for move in _moves(role, costs):
                if move[2] < matrix[move[0], move[1]]:
                    matrix[move[0], move[1]] = move[2]
                    choice[move[0], move[1]] = move
            self.matrix[role], self.choice[role] = matrix, choice
        self.end = np.array([costs.insert * len(_CLOSING[s]) for s in range(4)])

    def product(self, roles: list[int | None]) -> np.ndarray:
        """Least costs from each state before these turns to each state after them."""
        total = np.where(np.eye(4, dtype=bool), 0, _INF)
        for role in roles:
            total = np.minimum((total[:, :, None] + self.matrix[role][None]).min(1), _INF)
        return total

    def path(self, roles: list[int | None], entry: int, leave: int | None) -> list[tuple]:
        """The moves of a cheapest way from ``entry`` to ``leave``, or to the cheapest end if that is None."""
        best = np.full(4, _INF)
        best[entry] = 0
        back = np.zeros((len(roles), 4), np.int8)
        for t, role in enumerate(roles):
            reach = best[:, None] + self.matrix[role]
            back[t] = reach.argmin(0)
            best = np.minimum(reach.min(0), _INF)
        state = int((best + self.end).argmin()) if leave is None else leave
        moves = []
        for t in range(len(roles) - 1, -1, -1):
            before = int(back[t, state])
            moves.append(self.choice[roles[t]][before, state])
            state = before
        return moves[::-1]


def cuts(parts: list[np.ndarray], end: np.ndarray) -> list[int]:
    """The states at the ends of the parts of one conversation, from their cost matrices."""
    best, back = np.array([0] + [_INF] * 3), []
    for matrix in parts:
        reach = best[:, None] + matrix
        back.append(reach.argmin(0))
        best = np.minimum(reach.min(0), _INF)
    states = [int((best + end).argmin())]
    for step in back[:0:-1]:
        states.append(int(step[states[-1]]))
    return states[::-1]


def _role(name: str | None) -> int | None:
    name = (name or "").strip().lower()
    return ROLES.index(name) + 1 if name in ROLES else None


def _render(moves: list[tuple], texts: list[str | None], entry: int, last: bool, costs: Costs) -> tuple:
    """(text, roles, turns, merges, relabels, inserts, cost) of a part."""
    out, roles, merges, relabels, inserts, cost = [], [], 0, 0, 0, 0
    opened = entry != _START

    def turn(role: int, text: str) -> None:
        nonlocal opened
        out.append(("<|end|>\n" if opened else "") + f"<|{ROLES[role - 1]}|>\n{text}")
        roles.append(ROLES[role - 1])
        opened = True

    for (_, to, price, action, inserted), text in zip(moves, texts):
        cost += price
        relabels += price - (costs.merge if action == "merge" else costs.insert * len(inserted)) > 0
        if action == "merge":
            out.append(f"\n{text or ''}")
            merges += 1
            continue
        for role in inserted:
            turn(role, "")
        inserts += len(inserted)
        turn(to, text or "")
    state = moves[-1][1] if moves else entry
    if last:
        for role in _CLOSING[state]:
            turn(role, "")
        inserts += len(_CLOSING[state])
        cost += costs.insert * len(_CLOSING[state])
        out.append("<|end|>\n")
    return "".join(out), roles, len(roles), merges, relabels, inserts, cost


_RESULT = "part bigint, n_input bigint, n_turns bigint, merges bigint, relabels bigint, inserts bigint, cost bigint, roles array<string>, rendered string"


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    costs: Costs = Costs(), part_turns: int = PART_TURNS,
) -> DataFrame:
    """(conv, part, n_input, n_turns, merges, relabels, inserts, cost, roles, rendered): each conversation's cheapest repair.

    Turns go by turn number, null first; equal ones by role and text, so the
    order of rows does not matter. Roles count without case and blanks round
    them; null and unknown ones must be relabelled. Null text is an empty turn.
    Rows without a conversation form one together. A conversation of up to
    ``part_turns`` turns is one row (part 0); a longer one may be several, to be
    put together in order of part, so no task or row holds it all. Ties between
    repairs of equal cost are broken by a fixed order, in each part by itself.
    Other columns are not read.
    """
    spark = turns.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    columns_of(turns, [conv_col, turn_col, role_col, text_col])
    source = turns.select(F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), F.col(role_col).alias("_role"), F.col(text_col).alias("_text"))
    large = source.groupBy("_conv").agg(F.count("*").alias("_n")).where(F.col("_n") > part_turns).select(F.col("_conv").alias("_large"), "_n")
    # the turns of a short conversation share a key and so a partition; those of a long one are dealt out by their order
    keyed = source.join(large, F.col("_conv").eqNullSafe(F.col("_large")), "left").withColumn(
        "_key", F.when(F.col("_n").isNotNull(), F.struct("_turn", "_role", "_text", F.monotonically_increasing_id()))
    )
    # the partitions are kept as they are, as the two passes below must see the same ones
    ordered = keyed.repartitionByRange("_conv", "_key").sortWithinPartitions("_conv", "_turn", "_role", "_text")
    ordered = ordered.select("_conv", "_turn", "_role", "_text").checkpoint()
    kind = T.StructField(conv_col, turns.schema[conv_col].dataType)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        repairer, rows = Repairer(costs), []
        for conv, roles, _ in _conversations(batches):
            if len(rows) > 1:
                rows.pop()  # only the first and last of a partition may go on elsewhere
            rows.append((TaskContext.get().partitionId(), conv, [int(x) for x in repairer.product(roles).ravel()]))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), conv_type, pa.list_(pa.int64())))], names=["pid", conv_col, "costs"]
            )

    from pyspark.sql.pandas.types import to_arrow_type

    conv_type = to_arrow_type(kind.dataType)
    end_schema = T.StructType([T.StructField("pid", T.LongType()), kind, T.StructField("costs", T.ArrayType(T.LongType()))])
    # two rows a partition at most
    found = ordered.mapInArrow(ends, end_schema).orderBy("pid", conv_col).collect()
    states: dict[tuple, tuple[int, int, int | None]] = {}  # (partition, conversation): part, state before, state after
    at = 0
    while at < len(found):
        stop = at + 1
        while stop < len(found) and found[stop][conv_col] == found[at][conv_col]:
            stop += 1
        same = found[at:stop]
        if len(same) > 1:
            after = cuts([np.array(r["costs"]).reshape(4, 4) for r in same], Repairer(costs).end)
            for part, r in enumerate(same):
                states[r["pid"], r[conv_col]] = (part, after[part - 1] if part else _START, after[part] if part + 1 < len(same) else None)
        at = stop
    shared = spark.sparkContext.broadcast(states)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        repairer, pid, rows, size = Repairer(costs), TaskContext.get().partitionId(), [], 0
        for conv, roles, texts in _conversations(batches):
            part, entry, leave = shared.value.get((pid, conv), (0, _START, None))
            moves = repairer.path(roles, entry, leave)
            text, names, n, merges, relabels, inserts, cost = _render(moves, texts, entry, leave is None, costs)
            rows.append((conv, part, len(texts), n, merges, relabels, inserts, cost, names, text))
            size += len(text)
            if size > 1 << 22:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [conv_type, *[pa.int64()] * 7, pa.list_(pa.string()), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=schema.names)

    schema = T.StructType([kind, *T.StructType.fromDDL(_RESULT).fields])
    return ordered.mapInArrow(run, schema)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, roles, texts) of sorted batches, one after another."""
    conv, roles, texts = None, [], []
    for batch in batches:
        for own, role, text in zip(*(batch.column(c).to_pylist() for c in ("_conv", "_role", "_text"))):
            if texts and own != conv:
                yield conv, roles, texts
                roles, texts = [], []
            conv = own
            roles.append(_role(role))
            texts.append(text)
    if texts:
        yield conv, roles, texts
