"""Chat formatting: minimum-cost role repair, then rendering.

A legal conversation is an optional system turn, then user and assistant turns in alternation, user first, and it ends
with an assistant turn.  The automaton's state is the role of the last written turn.  Each given turn is written as it
is, relabelled to another role, or merged into the written turn before it if the roles are equal; an empty turn of any
role may be inserted before it, and one may be inserted at the end.  Costs: KEEP 0, MERGE, INSERT and RELABEL below;
a merge of turns of unequal given roles also pays for the relabel.  The cheapest repair wins; of equal ones that
which keeps the most turns, then fixed orders of actions decide.

The cost of a run of turns is a min-plus matrix from state to state, and those multiply.  So a conversation of any
length is cut into chunks of CHUNK turns that are solved apart: a matrix for each chunk, one short pass over the
matrices of each conversation for the states between chunks, and the choices inside each chunk given its two states.

Unknown and null roles (compared lower-cased, with blanks trimmed) match no state, so they are always relabelled.  Null
texts count as empty.  Turns are ordered by turn number (nulls first), then role and text; repeated rows are turns of
their own.  A null conv_id is a conversation like any other.  Each input row gives one output row, whose `segment` is
the text that it adds: the segments of a conversation, joined in `position` order, are its rendered form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.shared import arrow_map, table, written

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: Which role may be written in which state.
LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
RELABEL, MERGE, INSERT = 3, 1, 2
#: Costs count in steps of SCALE; below them stands how many turns were not kept.
SCALE, NEVER = 1 << 20, 1 << 60
CHUNK = 512
HEAD, TAIL, JOINT = "<|{role}|>\n", "<|end|>\n", "\n"


def moves() -> list[tuple[int, int, int, str, tuple[int, ...]]]:
    """(state before, written role, cost without relabel, action, inserted roles), the preferred ones first."""
    out = []
    for s in range(4):
        for r in (SYSTEM, USER, ASSISTANT):
            if (s, r) in LEGAL:
                out.append((s, r, 0, "keep", ()))
            if s == r:
                out.append((s, r, MERGE * SCALE, "merge", ()))
            for i in (SYSTEM, USER, ASSISTANT):
                if (s, i) in LEGAL and (i, r) in LEGAL:
                    out.append((s, r, INSERT * SCALE, "insert", (i,)))
                for j in (SYSTEM, USER, ASSISTANT):
                    if (s, i) in LEGAL and (i, j) in LEGAL and (j, r) in LEGAL:
                        out.append((s, r, 2 * INSERT * SCALE, "insert", (i, j)))
    return out


MOVES = moves()
#: The cost and the inserted roles that end a conversation in each state.
ENDS = {START: (0, ()), SYSTEM: (2 * INSERT * SCALE, (USER, ASSISTANT)), USER: (INSERT * SCALE, (ASSISTANT,)), ASSISTANT: (0, ())}


def turn_moves(role: int) -> list[tuple[int, int, int, str, tuple[int, ...]]]:
    """The moves for a given role (0: unknown), a changed role paid for."""
    return [(s, r, cost + (RELABEL * SCALE if r != role else 0) + (0 if action == "keep" and r == role else 1), action, ins) for s, r, cost, action, ins in MOVES]


OF_ROLE = [turn_moves(role) for role in range(4)]


def role_matrix(role: int) -> np.ndarray:
    out = np.full((4, 4), NEVER, np.int64)
    for s, r, cost, _, _ in OF_ROLE[role]:
        out[s, r] = min(out[s, r], cost)
    return out


MATRICES = [role_matrix(role) for role in range(4)]


def min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), NEVER)


def chunk_matrix(roles: list[int]) -> np.ndarray:
    out = MATRICES[roles[0]]
    for role in roles[1:]:
        out = min_plus(out, MATRICES[role])
    return out


def states_between(matrices: list[np.ndarray]) -> list[int]:
    """The state before each chunk and after the last, on the cheapest way from the start to a legal end."""
    ahead = np.array([ENDS[s][0] for s in range(4)])
    todo = [ahead]
    for m in reversed(matrices):
        todo.append(np.minimum((m + todo[-1][None, :]).min(axis=1), NEVER))
    todo.reverse()
    state, out = START, [START]
    for m, rest in zip(matrices, todo[1:], strict=True):
        state = int(np.argmin(m[state] + rest))
        out.append(state)
    return out


def choices(roles: list[int], begin: int, end: int) -> list[tuple[int, str, tuple[int, ...]]]:
    """For each turn (written role, action, inserted roles), on the cheapest way from state begin to state end."""
    rest = np.full((len(roles) + 1, 4), NEVER, np.int64)
    rest[-1, end] = 0
    for k in range(len(roles) - 1, -1, -1):
        rest[k] = np.minimum((MATRICES[roles[k]] + rest[k + 1][None, :]).min(axis=1), NEVER)
    out, state = [], begin
    for k, role in enumerate(roles):
        best = min((m for m in OF_ROLE[role] if m[0] == state), key=lambda m, k=k: m[2] + rest[k + 1, m[1]])
        out.append((best[1], best[3], best[4]))
        state = best[1]
    return out


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """The columns of each run of rows that agree in the first `keys` columns, across batches."""
    held: list[list] | None = None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        start = 0
        heads = list(zip(*columns[:keys], strict=True))
        for i in range(len(heads)):
            if i and heads[i] != heads[i - 1] or not i and held is not None and heads[0] != tuple(c[0] for c in held[:keys]):
                if held is not None:
                    yield [a + c[start:i] for a, c in zip(held, columns, strict=True)]
                    held = None
                else:
                    yield [c[start:i] for c in columns]
                start = i
        rest = [c[start:] for c in columns]
        held = rest if held is None else [a + b for a, b in zip(held, rest, strict=True)]
    if held is not None and held[0]:
        yield held


def role_code(role: Column) -> Column:
    name = F.lower(F.trim(role))
    return F.when(name == "system", SYSTEM).when(name == "user", USER).when(name == "assistant", ASSISTANT).otherwise(0)


def numbered(turns: DataFrame) -> DataFrame:
    """conv, turn, code, text, position (from 0) and last (whether it ends the conversation).

    Positions come in two steps, so that a conversation that holds a third of all rows is no single task's: rows are
    counted by (conversation, block of turn numbers), and only the counts are summed by conversation.
    """
    rows = turns.select(F.col("conv_id").alias("conv"), "turn", "role", "text").withColumn("code", role_code(F.col("role")))
    rows = rows.withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / F.lit(CHUNK)))
    counts = rows.groupBy("conv", "block").agg(F.count("*").alias("n"))
    by = Window.partitionBy("conv").orderBy("block")
    counts = counts.select("conv", "block", F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy("conv")).alias("total"))
    within = F.row_number().over(Window.partitionBy("conv", "block").orderBy("turn", "role", "text"))
    rows = rows.withColumn("within", within)
    placed = rows.join(counts.withColumnRenamed("conv", "c").withColumnRenamed("block", "b"), F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    position = F.col("base") + F.col("within") - 1
    return placed.select("conv", position.alias("position"), "turn", "code", "text", (position == F.col("total") - 1).alias("last")).withColumn("chunk", F.floor(F.col("position") / CHUNK))


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, turn, position, given role code, role, action, inserted, segment: a row for each row of turns."""
    rows = written(numbered(turns), "turns")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        found: list[tuple] = []
        for conv, chunk, _, code in grouped(batches, 2):
            found.append((conv[0], chunk[0], chunk_matrix(code).ravel().tolist()))
            if len(found) == 4096:
                yield dict(zip(("conv", "chunk", "costs"), map(list, zip(*found, strict=True)), strict=True))
                found = []
        if found:
            yield dict(zip(("conv", "chunk", "costs"), map(list, zip(*found, strict=True)), strict=True))

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for conv, chunk, costs in grouped(batches, 1):
            states = states_between([np.array(c, np.int64).reshape(4, 4) for c in costs])
            yield {"c": conv, "k": chunk, "begin": states[:-1], "end": states[1:]}

    # a conversation of one chunk, the usual kind, needs no second look at its matrix
    long = rows.groupBy("conv").agg(F.max("chunk").alias("m")).where("m > 0").select(F.col("conv").alias("lc"))
    cut = rows.join(long, F.col("conv").eqNullSafe(F.col("lc")), "left_semi")
    ordered = cut.select("conv", "chunk", "position", "code").repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "position")
    costs = arrow_map(ordered, matrices, "conv bigint, chunk bigint, costs array<bigint>")
    states = arrow_map(costs.repartition("conv").sortWithinPartitions("conv", "chunk"), between, "c bigint, k bigint, begin int, end int")
    known = rows.join(states, F.col("conv").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")), "left")
    known = known.select("conv", "chunk", "position", "turn", "code", "text", "last", "begin", "end")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for conv, chunk, position, turn, code, text, last, begin, end in grouped(batches, 2):
            if begin[0] is None:
                begin_, end_ = states_between([chunk_matrix(code)])
            else:
                begin_, end_ = begin[0], end[0]
            done = choices(code, begin_, end_)
            state, segments, inserted = begin_, [], []
            for t, is_last, (role, action, ins) in zip(text, last, done, strict=True):
                if action == "merge":
                    s = JOINT + (t or "")
                else:
                    s = TAIL if state != START else ""
                    s += "".join(HEAD.format(role=ROLES[i - 1]) + TAIL for i in ins)
                    s += HEAD.format(role=ROLES[role - 1]) + (t or "")
                more: tuple[int, ...] = ()
                if is_last:
                    more = ENDS[role][1]
                    s += TAIL + "".join(HEAD.format(role=ROLES[i - 1]) + TAIL for i in more)
                segments.append(s)
                inserted.append([ROLES[i - 1] for i in ins + more])
                state = role
            yield {
                "conv_id": conv,
                "turn": turn,
                "position": position,
                "role": [ROLES[r - 1] for r, _, _ in done],
                "action": ["relabel" if a == "keep" and r != c else a for (r, a, _), c in zip(done, code, strict=True)],
                "relabelled": [r != c for (r, _, _), c in zip(done, code, strict=True)],
                "inserted": inserted,
                "segment": segments,
            }

    spread = known.repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "position")
    return arrow_map(spread, together(render), "conv_id bigint, turn bigint, position bigint, role string, action string, relabelled boolean, inserted array<string>, segment string")


def together(work):
    """work with its small outputs joined to batches of some thousand rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[str, list] = {}
        for columns in work(batches):
            for k, v in columns.items():
                held.setdefault(k, []).extend(v)
            if len(next(iter(held.values()))) >= 2048:
                yield held
                held = {}
        if held:
            yield held

    return run


def rendered(repair: DataFrame) -> DataFrame:
    """conv_id and the whole rendered text, for conversations that fit in a row."""
    parts = F.array_sort(F.collect_list(F.struct("position", "segment")))
    return repair.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["segment"]), "").alias("rendered"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))
