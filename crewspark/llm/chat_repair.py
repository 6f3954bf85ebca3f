"""Chat formatting with minimum-cost role repair.

Legal sequences: an optional system turn, then user and assistant in turn, an assistant last.  A
turn may keep its role, be given another one, be merged into the turn before it, or have empty
turns put in before it; the cheapest repair is found by dynamic programming.  A block of turns acts
on the costs of the four states as a matrix over (min, +); matrices are joined along a conversation,
so that a conversation of any length is repaired block by block in many tasks.
"""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewspark.llm.common import ARROW, pick, stage
from crewspark.shipping import map_in_arrow

#: States: before the first turn, and the role of the last turn.
STATES = ("start", "system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "model": "assistant", "gpt": "assistant", "ai": "assistant", "developer": "system"}
RELABEL, UNKNOWN, MERGE, INSERT, NEVER = 3, 1, 1, 2, 1 << 30
#: Empty turns to put in when a turn of the second role follows the first state.
INSERTED = {
    (0, 1): (), (0, 2): (), (0, 3): (2,),
    (1, 2): (), (1, 3): (2,),
    (2, 3): (), (3, 2): (),
}
#: Turns of one block.
BLOCK = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def role_code(role: str | None) -> int:
    """1 to 3, or 0 for a role that isn't known."""
    r = (role or "").strip().lower()
    r = ALIASES.get(r, r)
    return STATES.index(r) if r in STATES[1:] else 0


def link(p: int, q: int) -> int:
    if (p, q) in INSERTED:
        return INSERT * len(INSERTED[p, q])
    return MERGE if p == q else NEVER


def moves(role: int) -> list[list[int]]:
    """Cost of a turn of this role from each state to each."""
    own = [NEVER, *[0 if q == role else RELABEL if role else UNKNOWN for q in (1, 2, 3)]]
    return [[min(NEVER, link(p, q) + own[q]) if q else NEVER for q in range(4)] for p in range(4)]


MOVES = [moves(r) for r in range(4)]
#: Cost of ending in a state: the empty turns that are missing.
ENDING = [0, 2 * INSERT, INSERT, 0]
MISSING = [(), (2, 3), (3,), ()]


def times(a: list[list[int]], role: int) -> list[list[int]]:
    b = MOVES[role]
    return [[min(min(row[k] + b[k][q] for k in range(4)), NEVER) for q in range(4)] for row in a]


def best_path(roles: list[int], first: int, last: int) -> list[int]:
    """State after each turn, on the cheapest way from a state to a state; the least state first
    among equals, read from the end."""
    costs, back = [0 if p == first else NEVER for p in range(4)], []
    for r in roles:
        step = [min((costs[p] + MOVES[r][p][q], p) for p in range(4)) for q in range(4)]
        costs = [min(c, NEVER) for c, _ in step]
        back.append([p for _, p in step])
    path, q = [], last
    for prior in reversed(back):
        path.append(q)
        q = prior[q]
    return path[::-1]


def _grouped(batches, keys: int):
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return groupby(rows, key=lambda r: r[:keys])


def _emit(rows, schema: pa.Schema):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == 5000:
            yield _arrow(held, schema)
            held = []
    if held:
        yield _arrow(held, schema)


def _arrow(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _schema(text: str) -> pa.Schema:
    return pa.schema([(x.split(" ")[0], ARROW[x.split(" ")[1]]) for x in text.split(", ")])


NUMBERED = "conv_id long, block long, place long, turn long, role string, text string"
MATRIX = "conv_id long, block long, matrix array<long>"
BORDER = "conv_id long, block long, first int, last int, ends boolean, cost long"
REPAIRED = "conv_id long, turn long, role string, action string, inserted_before int, rendered string, cost long"


def repair(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row a turn: its repaired role, what was done (keep, relabel, merge), empty turns put in
    before it, its part of the rendered text, and the whole conversation's cost.  A conversation's
    parts, joined in order of turn, role and text, are its rendered form.

    Null conversation ids form one conversation, null turns come first, null or unknown roles get
    the cheapest legal role, null texts are empty; turns with one number are ordered by role and
    text; texts of any length are rendered whole; repeated rows stay; other columns are not read; an
    empty table gives an empty one.  Turns are sorted over all tasks, and a task's turns of one
    conversation are cut into blocks of at most ``block``, so that no turn number makes a large one.
    """
    turns = pick(conversations, "conv_id", "turn", "role", "text").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    matrix, border, repaired, numbered = _schema(MATRIX), _schema(BORDER), _schema(REPAIRED), _schema(NUMBERED)

    def number(batches):
        part = TaskContext.get().partitionId() << 40
        before, row, own = None, 0, 0
        for batch in batches:
            blocks, places = [], []
            for conv in batch.column(0).to_pylist():
                if row == 0 or conv != before or own == block:
                    before, own, start = conv, 0, row
                blocks.append(part + start)
                places.append(part + row)
                row, own = row + 1, own + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blocks, pa.int64()), pa.array(places, pa.int64()), *batch.columns[1:]], schema=numbered)

    # equal rows too may lie in several tasks; written once, as a range sort may deal otherwise again
    dealt = turns.withColumn("salt", F.rand(7)).repartitionByRange(*order, "salt").sortWithinPartitions(*order).drop("salt")
    turns = stage(map_in_arrow(dealt, number, NUMBERED))

    def matrices(batches):
        def rows():
            for (conv, b), group in _grouped(batches, 2):
                m = [[0 if p == q else NEVER for q in range(4)] for p in range(4)]
                for r in group:
                    m = times(m, role_code(r[3]))
                yield conv, b, [x for row in m for x in row]

        yield from _emit(rows(), matrix)

    def borders(batches):
        def rows():
            for (conv,), group in _grouped(batches, 1):
                costs, back, blocks = [0, NEVER, NEVER, NEVER], [], []
                for _, b, m in group:
                    step = [min((costs[p] + m[4 * p + q], p) for p in range(4)) for q in range(4)]
                    costs = [min(c, NEVER) for c, _ in step]
                    back.append([p for _, p in step])
                    blocks.append(b)
                cost, state = min((costs[q] + ENDING[q], q) for q in range(4))
                out = []
                for b, prior in zip(reversed(blocks), reversed(back), strict=True):
                    out.append((conv, b, prior[state], state, not out, cost))
                    state = prior[state]
                yield from reversed(out)

        yield from _emit(rows(), border)

    def renders(batches):
        def rows():
            for _, group in _grouped(batches, 2):
                group = list(group)
                first, last, ends, cost = group[0][6:10]
                roles = [role_code(r[4]) for r in group]
                path = best_path(roles, first, last)
                before = first
                for k, (r, own, now) in enumerate(zip(group, roles, path, strict=True)):
                    merged = before == now
                    added = () if merged else INSERTED[before, now]
                    text = "\n" + r[5] if merged else (CLOSE if before else "") + "".join(f"{OPEN}{STATES[x]}\n{CLOSE}" for x in added) + f"{OPEN}{STATES[now]}\n{r[5]}"
                    if ends and k == len(group) - 1:
                        text += CLOSE + "".join(f"{OPEN}{STATES[x]}\n{CLOSE}" for x in MISSING[now])
                    yield r[0], r[3], STATES[now], "merge" if merged else "keep" if own == now else "relabel", len(added), text, cost
                    before = now

        yield from _emit(rows(), repaired)

    roles = turns.select("conv_id", "block", "place", "role").repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "place")
    each = map_in_arrow(roles, matrices, MATRIX)
    ways = map_in_arrow(each.repartition("conv_id").sortWithinPartitions("conv_id", "block"), borders, BORDER)
    same = turns["conv_id"].eqNullSafe(ways["conv_id"]) & (turns["block"] == ways["block"])
    joined = turns.join(ways, same, "left").select(*[turns[c] for c in turns.columns], "first", "last", "ends", "cost")
    return map_in_arrow(joined.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "place"), renders, REPAIRED)
