"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in
turn, and ends with the assistant. A turn may open with its own role, be
relabelled, be merged into the turn before it, or have empty turns inserted
before it. Dynamic programming over the automaton of legal turns finds the
cheapest repair; ties go to opening before merging, then to the earlier role.

The result has one row per turn, whose ``rendered`` piece holds the marks it
needs; the pieces of a conversation in row order are the whole rendering. So no
conversation is ever put together in one place: rows are numbered in
conversation order and cut into blocks of ``BLOCK`` rows, a conversation that
crosses blocks is summed up by one cost matrix per block, the matrices are chained
per conversation, and each block is then solved between its known states.

Roles are compared trimmed and lower-cased, with common aliases; a null or unknown
role fits any role at a small cost. A null text is empty. A null conversation id
is a conversation of its own; repeated turn numbers follow in order of role and
text. Template marks inside texts are escaped. A table without rows gives none.
"""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import materialise, number_rows

BLOCK = 1024
STATES = ("start", "system", "user", "assistant")
OPENS = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
FINAL = 3
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
MERGE, INSERT, RELABEL, GUESS = 2, 3, 4, 1
NO = 1 << 40


def _paths() -> dict[tuple[int, int], tuple[int, ...]]:
    """Fewest empty user or assistant turns that let a role open in a state."""
    out = {}
    for s in OPENS:
        seen, level = {s: ()}, [s]
        while level:
            nxt = []
            for at in level:
                for q in OPENS[at]:
                    out.setdefault((s, q), seen[at])
                    if q > 1 and q not in seen:
                        seen[q] = (*seen[at], q)
                        nxt.append(q)
            level = nxt
    return out


PATHS = _paths()


def _steps(role: int) -> list[list[tuple[int, bool, tuple[int, ...]]]]:
    """For a turn of a role (0: unknown), by state before and after: cost, whether it merges, inserted turns."""
    table = []
    for s in range(4):
        row = []
        for q in range(4):
            relabel = 0 if role == q else GUESS if role == 0 else RELABEL
            ways = []
            if q and (s, q) in PATHS:
                ways.append((len(PATHS[s, q]) * INSERT + relabel, False, PATHS[s, q]))
            if q and s == q:
                ways.append((MERGE + relabel, True, ()))
            row.append(min(ways, key=lambda w: (w[0], w[1])) if ways else (NO, False, ()))
        table.append(row)
    return table


STEPS = [_steps(r) for r in range(4)]
#: Empty turns that end a conversation legally.
CLOSING = {0: (), 1: (2, 3), 2: (3,), 3: ()}


def role_code(role: str | None) -> int:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return STATES.index(name) if name in STATES[1:] else 0


def transfer(roles: list[int]) -> list[list[int]]:
    """Least cost of some turns, by state before and after them."""
    now = [[0 if s == q else NO for q in range(4)] for s in range(4)]
    for r in roles:
        step = STEPS[r]
        now = [[min(min(row[m] + step[m][q][0] for m in range(4)), NO) for q in range(4)] for row in now]
    return now


def solve(roles: list[int], enter: int = 0, leave: int | None = None) -> list[tuple[int, bool, tuple[int, ...]]]:
    """(role, merged, inserted before) of each turn on the cheapest way from ``enter``, to ``leave`` or to a legal end."""
    cost, back = [0 if s == enter else NO for s in range(4)], []
    for r in roles:
        step, new, frm = STEPS[r], [], []
        for q in range(4):
            best = min(range(4), key=lambda m: (cost[m] + step[m][q][0], m))
            new.append(min(cost[best] + step[best][q][0], NO))
            frm.append(best)
        cost = new
        back.append(frm)
    at = leave if leave is not None else min(range(4), key=lambda s: (cost[s] + len(CLOSING[s]) * INSERT, s))
    out = []
    for r, frm in zip(reversed(roles), reversed(back), strict=True):
        before = frm[at]
        _, merged, inserted = STEPS[r][before][at]
        out.append((at, merged, inserted))
        at = before
    return out[::-1]


def chain(matrices: list[list[list[int]]]) -> list[tuple[int, int | None]]:
    """States in which each part of one conversation begins and ends; the last ends legally (None)."""
    cost, back = [0, NO, NO, NO], []
    for m in matrices:
        frm = [min(range(4), key=lambda s, q=q, m=m: (cost[s] + m[s][q], s)) for q in range(4)]
        cost = [min(cost[frm[q]] + m[frm[q]][q], NO) for q in range(4)]
        back.append(frm)
    at = min(range(4), key=lambda s: (cost[s] + len(CLOSING[s]) * INSERT, s))
    out, leave = [], None
    for frm in reversed(back):
        before = frm[at]
        out.append((before, leave))
        at = leave = before
    return out[::-1]


def _open(role: int) -> str:
    return f"<|im_start|>{STATES[role]}\n"


END = "<|im_end|>\n"


def marks(turns: list[tuple[int, bool, tuple[int, ...]]], enter: int, last: bool) -> tuple[list[str], list[str]]:
    """What is rendered before and after the text of each turn. A turn is closed by whatever comes next, so nothing looks ahead."""
    heads, begun = [], enter != 0
    for role, merged, inserted in turns:
        heads.append("\n\n" if merged else (END if begun else "") + "".join(_open(q) + END for q in inserted) + _open(role))
        begun = True
    tails = [""] * len(turns)
    if last and turns:
        tails[-1] = END + "".join(_open(q) + END for q in CLOSING[turns[-1][0]])
    return heads, tails


def _segments(table: pa.Table) -> list[tuple[int | None, list[int]]]:
    ids = table["conv_id"].to_pylist()
    return [(k, list(rows)) for k, rows in groupby(range(len(ids)), key=ids.__getitem__)]


def _edges(table: pa.Table) -> pa.Table:
    """Cost matrices of the first and the last conversation of a block, which may go on elsewhere."""
    table = table.sort_by("row")
    roles = [role_code(r) for r in table["role"].to_pylist()]
    parts = _segments(table)
    block = table["block"][0].as_py()
    chosen = [parts[0]] if len(parts) == 1 else [parts[0], parts[-1]]
    flat = [[c for row in transfer([roles[i] for i in rows]) for c in row] for _, rows in chosen]
    return pa.table({"block": pa.array([block] * len(chosen), pa.int64()), "conv_id": pa.array([k for k, _ in chosen], pa.int64()), "cost": pa.array(flat, pa.list_(pa.int64()))})


def _chained(table: pa.Table) -> pa.Table:
    table = table.sort_by("block")
    costs = [[c[4 * s : 4 * s + 4] for s in range(4)] for c in table["cost"].to_pylist()]
    states = chain(costs)
    return pa.table({
        "block": table["block"], "conv_id": table["conv_id"],
        "enter": pa.array([a for a, _ in states], pa.int32()), "leave": pa.array([b for _, b in states], pa.int32()),
    })


def _solved(left: pa.Table, right: pa.Table) -> pa.Table:
    left = left.sort_by("row")
    known = {k: (a, b) for k, a, b in zip(right["conv_id"].to_pylist(), right["enter"].to_pylist(), right["leave"].to_pylist(), strict=True)}
    roles = [role_code(r) for r in left["role"].to_pylist()]
    turns, heads, tails = [], [], []
    for k, rows in _segments(left):
        enter, leave = known.get(k, (0, None))
        got = solve([roles[i] for i in rows], enter, leave)
        turns += got
        before, after = marks(got, enter, leave is None)
        heads += before
        tails += after
    action = [("merge" if m else "keep") if q == r else ("merge_relabel" if m else "relabel") for (q, m, _), r in zip(turns, roles, strict=True)]
    return pa.table({
        "row": left["row"], "role_out": pa.array([STATES[q] for q, _, _ in turns], pa.string()), "action": pa.array(action, pa.string()),
        "n_inserted": pa.array([len(i) for _, _, i in turns], pa.int32()), "head": pa.array(heads, pa.string()), "tail": pa.array(tails, pa.string()),
    })


DECISION = "row long, role_out string, action string, n_inserted int, head string, tail string"


def format_chats(conversations: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """One row per turn, numbered by ``row``: conv_id, turn, role, role_out, action, n_inserted, rendered.

    Python sees ids and roles alone; texts, however long, meet the decisions in the JVM.
    """
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    numbered, _ = number_rows(turns, "conv_id", "turn", "role", "text", name="row")
    blocks = numbered.select(F.floor(F.col("row") / block_rows).cast("long").alias("block"), "row", "conv_id", "role")
    edges = blocks.groupBy("block").applyInArrow(_edges, "block long, conv_id long, cost array<long>")
    states = edges.groupBy("conv_id").applyInArrow(_chained, "block long, conv_id long, enter int, leave int")
    states = materialise(states, "states")
    decided = blocks.groupBy("block").cogroup(states.groupBy("block")).applyInArrow(_solved, DECISION)
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("<\\|"))
    return numbered.join(decided, "row").select(
        "row", "conv_id", "turn", "role", "role_out", "action", "n_inserted", F.concat("head", text, "tail").alias("rendered")
    )
