"""Chat formatting by minimum-cost role repair.

Legal conversations are an optional system turn, then user and assistant turns in
alternation, from user to assistant.  A dynamic program over that automaton
(state: role of the last turn) chooses for each turn its role (relabelling costs)
and whether it is merged into the last turn of that role or preceded by empty
turns (inserting costs).  Then the repaired sequence is rendered.

A turn's choices are a min-plus matrix over the states, and those compose.  So a
conversation is cut into blocks of ``BLOCK`` rows: each block's matrix is
made on its own, the matrices of a conversation give each block's entry and exit
state, and each block is then repaired and rendered on its own.  No task holds
more text than a block, and concatenating a conversation's blocks in order gives
its text.  Rows are numbered within their conversation by sorted range partitions,
so repeated and null turn numbers fill blocks like others, in the order of role and
text.

Defined results: roles are compared trimmed and lower-cased, with the aliases
below; null and unknown roles cost one to relabel to any role; null text is empty;
null turn numbers come last; equal rows count each; rows with a null conversation id
are one conversation of their own; an empty table gives no row; ties prefer fewer insertions, then merges, then the earlier role; other columns are
ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

BLOCK = 1024
MERGE, RELABEL, GUESS, INSERT = 2, 3, 1, 4
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
# Other names of roles.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "developer": "system"}
INF = 1 << 40
#: roles inserted to get from one state to a turn of a role, and None where there is no way
BETWEEN = {(START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,), (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
           (USER, ASSISTANT): (), (USER, USER): (ASSISTANT,), (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,)}
#: roles inserted at the end
CLOSING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def moves(role: int) -> list[tuple[int, int, int, str, tuple[int, ...]]]:
    """(from, to, cost, action, inserted) for a turn of ``role`` (0: unknown), best ties first."""
    out = []
    for a in range(4):
        for t in (SYSTEM, USER, ASSISTANT):
            cost = 0 if t == role else RELABEL if role else GUESS
            label = "keep" if t == role else "relabel"
            if a == t:
                out.append((a, t, cost + MERGE, "merge" if t == role else "relabel+merge", ()))
            if (a, t) in BETWEEN:
                extra = BETWEEN[a, t]
                out.append((a, t, cost + INSERT * len(extra), label, extra))
    return sorted(out, key=lambda m: (len(m[4]), "merge" in m[3], m[1]))


_MOVES = [moves(r) for r in range(4)]


def transfer(roles: list[int]) -> np.ndarray:
    """Least cost from each state to each state over a run of turns."""
    out = np.full((4, 4), INF, np.int64)
    out[range(4), range(4)] = 0
    step = []
    for r in range(4):
        m = np.full((4, 4), INF, np.int64)
        for a, t, c, _, _ in _MOVES[r]:
            m[a, t] = min(m[a, t], c)
        step.append(m)
    for r in roles:
        out = np.minimum((out[:, :, None] + step[r][None]).min(1), INF)
    return out


def repair(roles: list[int], enter: int, leave: int) -> list[tuple[int, str, tuple[int, ...]]]:
    """(role, action, inserted before) per turn on a least-cost way between two states."""
    best = [INF] * 4
    best[enter] = 0
    trail = []
    for r in roles:
        new, how = [INF] * 4, [None] * 4
        for a, t, c, action, extra in _MOVES[r]:
            if best[a] + c < new[t]:
                new[t], how[t] = best[a] + c, (a, action, extra)
        best = new
        trail.append(how)
    out, state = [], leave
    for how in reversed(trail):
        a, action, extra = how[state]
        out.append((state, action, extra))
        state = a
    return out[::-1]


def _role_code():
    role = F.lower(F.trim(F.col("role")))
    code = F.lit(0)
    for name, to in {**{r: r for r in ROLES[1:]}, **ALIASES}.items():
        code = F.when(role == name, ROLES.index(to)).otherwise(code)
    return code


def render_block(roles: list[int], texts: list[str], enter: int, leave: int, last: bool):
    """Rendered fragment, counts (merged, relabelled, inserted) and cost of a block.
    A turn's end mark stands before the next header, so fragments join up."""
    out, merged, relabelled, inserted, cost, begun = [], 0, 0, 0, 0, enter != START

    def turn(role, text):
        nonlocal begun
        out.append(("<|end|>\n" if begun else "") + f"<|{ROLES[role]}|>\n{text}")
        begun = True

    for r, text, (role, action, extra) in zip(roles, texts, repair(roles, enter, leave)):
        for e in extra:
            turn(e, "")
        if "merge" in action:
            out.append("\n\n" + text)
            merged += 1
        else:
            turn(role, text)
        relabelled += "relabel" in action
        inserted += len(extra)
        cost += INSERT * len(extra) + MERGE * ("merge" in action) + (0 if role == r else RELABEL if r else GUESS)
    if last:
        for e in CLOSING[leave]:
            turn(e, "")
        inserted += len(CLOSING[leave])
        cost += INSERT * len(CLOSING[leave])
        if begun:
            out.append("<|end|>\n")
    return "".join(out), merged, relabelled, inserted, cost


#: rows are dealt to range partitions by so many characters of their text at most
PREFIX = 64


def _places(batches):
    """Place of each row among the rows of its conversation in a sorted partition."""
    last, seen = None, 0  # conversation of the row before, and its rows up to there
    for b in batches:
        if not b.num_rows:
            continue
        conv = b.column("conv")
        code = conv.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        at = np.arange(len(code))
        start = np.maximum.accumulate(np.where(np.concatenate([[True], code[1:] != code[:-1]]), at, 0))
        place = at - start
        if last is not None and conv[0].as_py() == last[0]:
            place[start == 0] += seen
        last, seen = (conv[len(code) - 1].as_py(),), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([conv, b.column("code"), b.column("text"), b.column("part"), pa.array(place, pa.int64())],
                                         ["conv", "code", "text", "part", "place"])


def ranked(rows: DataFrame, kind: str) -> DataFrame:
    """(conv, code, text, rank) of ``rows(conv, turn, role, code, text)``: rank from 0 in the
    order of turn, role, code and text.  A conversation may span partitions: the rows that
    it has in partitions before are added, one number for each partition at most."""
    order = ["conv", F.coalesce("turn", F.lit((1 << 63) - 1)), "role", "code"]
    placed = (rows.repartitionByRange(*order, F.left("text", F.lit(PREFIX))).sortWithinPartitions(*order, "text")
              .select("conv", "code", "text", F.spark_partition_id().alias("part"))
              .mapInArrow(_places, f"conv {kind}, code int, text string, part int, place long"))
    placed = stage(placed, "chat-places")
    before = Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # rows: partitions of a conversation
    runs = placed.groupBy(F.col("conv").alias("c"), F.col("part").alias("p")).agg(F.count("*").alias("n"))
    going_on = runs.select("c", "p", F.sum("n").over(before).alias("before")).where("before IS NOT NULL")  # a partition has one at most
    return placed.join(F.broadcast(going_on), F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left").select(
        "conv", "code", "text", (F.col("place") + F.coalesce("before", F.lit(0))).alias("rank"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", block: int = BLOCK) -> DataFrame:
    """Per conversation and block: conv id, block (from 0), is_last, n_turns, n_merged,
    n_relabelled, n_inserted, cost, rendered."""
    kind = turns.schema[conv_col].dataType.simpleString()
    rows = turns.select(F.col(conv_col).alias("conv"), F.col("turn").cast("long").alias("turn"), _role_code().alias("code"), F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    rows = ranked(rows, kind).withColumn("block", F.floor(F.col("rank") / block))
    key = F.struct("rank", "code", "text")
    blocks = stage(rows.groupBy("conv", "block").agg(F.array_sort(F.collect_list(key)).alias("turns"))
                   .select("conv", "block", F.col("turns.code").alias("codes"), F.col("turns.text").alias("texts")), "chat-blocks")

    def matrices(batches):
        for b in batches:
            m = [transfer(codes).ravel().tolist() for codes in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(m, pa.list_(pa.int64()))], ["conv", "block", "m"])

    def ways(batches):
        for b in batches:
            convs, out = b.column(0), ([], [], [], [], [])
            for i, steps in enumerate(b.column(1).to_pylist()):
                best, trail = np.array([0, INF, INF, INF], np.int64), []
                for s in steps:
                    total = best[:, None] + np.array(s["m"], np.int64).reshape(4, 4)
                    trail.append(total.argmin(0))
                    best = total.min(0)
                state = int((best + [INSERT * len(CLOSING[a]) for a in range(4)]).argmin())
                for n in range(len(steps) - 1, -1, -1):
                    enter = int(trail[n][state])
                    for c, x in zip(out, (i, steps[n]["block"], enter, state, n == len(steps) - 1)):
                        c.append(x)
                    state = enter
            yield pa.RecordBatch.from_arrays([convs.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()),
                                              pa.array(out[3], pa.int32()), pa.array(out[4], pa.bool_())], ["conv", "block", "enter", "leave", "is_last"])

    def render(batches):
        for b in batches:
            codes, texts = b.column("codes").to_pylist(), b.column("texts").to_pylist()
            got = [render_block(*x) for x in zip(codes, texts, b.column("enter").to_pylist(), b.column("leave").to_pylist(), b.column("is_last").to_pylist())]
            cols = list(zip(*got)) if got else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("conv"), b.column("block"), b.column("is_last"), pa.array([len(c) for c in codes], pa.int64()),
                 *(pa.array(cols[i], pa.int64()) for i in (1, 2, 3, 4)), pa.array(cols[0], pa.string())],
                [conv_col, "block", "is_last", "n_turns", "n_merged", "n_relabelled", "n_inserted", "cost", "rendered"])

    steps = blocks.select("conv", "block", "codes").mapInArrow(matrices, f"conv {kind}, block long, m array<long>")
    way = (steps.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "m"))).alias("steps"))
           .mapInArrow(ways, f"conv {kind}, block long, enter int, leave int, is_last boolean"))
    return (blocks.join(way.withColumnRenamed("conv", "c").withColumnRenamed("block", "k"), F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("k")))
            .select("conv", "block", "codes", "texts", "enter", "leave", "is_last")
            .mapInArrow(render, f"`{conv_col}` {kind}, block long, is_last boolean, n_turns long, n_merged long, n_relabelled long, n_inserted long, cost long, rendered string"))
