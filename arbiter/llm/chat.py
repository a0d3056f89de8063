"""Chat formatting with minimum-cost role repair.

Legal turns are an automaton: start -> system or user, system -> user,
user -> assistant, assistant -> user; a conversation ends after assistant.
Dynamic programming over it chooses for every turn a role (its own, or another
at the cost of a relabel), whether it is merged into the turn before it, and
which empty turns are inserted before it and at the end. The sum of costs is
the least possible; of equal ones the sequence with fewer turns wins, then the
smaller state (start, system, user, assistant).

One row is a piece: a turn of the input or an inserted empty turn. The texts of
a conversation's pieces, in order, are its rendering.

Conversations are not gathered. Turns are range-sorted by conversation and
place, and written once; a conversation may then lie in many partitions. Each
partition reports the least costs between all pairs of states for the runs at
its two ends only, the driver (two rows a partition) links the runs of a
conversation, and each partition repairs its runs between the states it is
told. So one conversation may hold any share of all turns.

Defined results
  roles                lower case, trimmed, by `ALIASES`; null or any other must be relabelled
  null or empty text   an empty turn, kept
  equal turn numbers   in the order of role and text hash
  null turn            after all numbered turns; null conv_id is a conversation of its own
  chat markers in text a space goes into '<|'
  empty table          empty result
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbiter.llm.common import partitions, shared_dir

ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
START = 0
STATES = range(4)  # 0 start, then the roles
LEGAL = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
ACCEPT = 3
MERGE, INSERT, RELABEL = 1, 2, 3
FAR = 1 << 60
HEAD, FOOT, JOIN = "<|im_start|>{role}\n", "<|im_end|>\n", "\n"

#: (cost, turns out, inserted turns) of a path; compared in this order.
Cost = tuple[int, int, int]
NEVER: Cost = (FAR, 0, 0)


def role_state(role: str | None) -> int:
    """1 to 3 for a known role, else 0."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else 0


@lru_cache(maxsize=None)
def between(p: int, t: int) -> tuple[int, ...] | None:
    """The fewest roles to insert so that t may follow p, or None."""
    paths, seen = [(p, ())], set()
    while paths:
        nxt = []
        for at, path in paths:
            for q in LEGAL[at]:
                if q == t:
                    return path
                if q not in seen:
                    seen.add(q)
                    nxt.append((q, (*path, q)))
        paths = nxt
    return None


@lru_cache(maxsize=None)
def step(p: int, t: int, role: int) -> tuple[Cost, bool, tuple[int, ...]] | None:
    """The cheapest way for a turn of `role` to become t after p: (cost, merged, inserted)."""
    relabel = RELABEL * (t != role)
    ways = []
    if p == t:
        ways.append(((relabel + MERGE, 0, 0), True, ()))
    if (path := between(p, t)) is not None:
        ways.append(((relabel + INSERT * len(path), 1 + len(path), len(path)), False, path))
    return min(ways) if ways else None


@lru_cache(maxsize=None)
def ending(p: int) -> tuple[Cost, tuple[int, ...]]:
    """What must be inserted after the last turn."""
    if p == ACCEPT:
        return (0, 0, 0), ()
    path = (*between(p, ACCEPT), ACCEPT)
    return (INSERT * len(path), len(path), len(path)), path


def _add(a: Cost, b: Cost) -> Cost:
    return (a[0] + b[0], a[1] + b[1], a[2] + b[2])


def forward(roles: tuple[int, ...], entry: int) -> list[list[tuple[Cost, int]]]:
    """For every turn and state the least cost from `entry` and the state before."""
    row = [((0, 0, 0) if s == entry else NEVER, s) for s in STATES]
    out = []
    for role in roles:
        nxt: list[tuple[Cost, int]] = [(NEVER, 0)] * 4
        for t in (1, 2, 3):
            best = (NEVER, 0)
            for p in STATES:
                if row[p][0][0] < FAR and (way := step(p, t, role)) is not None:
                    best = min(best, (_add(row[p][0], way[0]), p))
            nxt[t] = best
        out.append(nxt)
        row = nxt
    return out


def repair(roles: tuple[int, ...], entry: int = START, leave: int | None = None) -> tuple[Cost, list[tuple[int, bool, tuple[int, ...]]]]:
    """The cheapest (state, merged, inserted before) of each turn; `leave` fixes the last state, else the end is paid for."""
    rows = forward(roles, entry)
    if leave is None:
        cost, leave = min((_add(rows[-1][t][0], ending(t)[0]), t) for t in (1, 2, 3))
    else:
        cost = rows[-1][leave][0]
    states, at = [], leave
    for row in reversed(rows):
        states.append(at)
        at = row[at][1]
    states.reverse()
    ways, p = [], entry
    for t, role in zip(states, roles):
        _, merged, inserted = step(p, t, role)
        ways.append((t, merged, inserted))
        p = t
    return cost, ways


@lru_cache(maxsize=20_000)
def _repair_short(roles: tuple[int, ...]) -> tuple[Cost, list]:
    return repair(roles)


def link(runs: list[tuple[int, str, str, list[list[Cost]]]]) -> dict[tuple[int, str], tuple]:
    """From border runs (partition, end, conversation, costs[entry][leave]) in order: how each run of a conversation in more than one partition is entered and left."""
    out: dict[tuple[int, str], tuple] = {}
    chains: list[list] = []
    for run in runs:
        follows = chains and chains[-1][-1][2] == run[2] and chains[-1][-1][0] < run[0] and chains[-1][-1][1] in ("last", "only") and run[1] in ("first", "only")
        if follows:
            chains[-1].append(run)
        else:
            chains.append([run])
    for chain in chains:
        if len(chain) == 1:
            continue
        row, back = {START: (0, 0, 0)}, []
        for _, _, _, costs in chain:
            nxt, came = {}, {}
            for t in (1, 2, 3):
                ways = [(_add(c, tuple(costs[p][t])), p) for p, c in row.items() if c[0] < FAR and costs[p][t][0] < FAR]
                if ways:
                    nxt[t], came[t] = min(ways)
            row = nxt
            back.append(came)
        _, leave = min((_add(c, ending(t)[0]), t) for t, c in row.items())
        exits = [leave]
        for came in reversed(back):
            exits.append(came[exits[-1]])
        exits.reverse()  # exits[k] enters run k, exits[k + 1] leaves it
        turns = inserts = places = 0
        for k, (pid, end, _, costs) in enumerate(chain):
            cost = costs[exits[k]][exits[k + 1]]
            out[pid, end] = (exits[k], exits[k + 1], turns, places + inserts, k == 0, k == len(chain) - 1)
            turns, inserts, places = turns + cost[1], inserts + cost[2], places + costs[4][0][0]
    return out


def _runs(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[list]]:
    """Consecutive rows of one conversation, as `columns` lists; conv_id is the first column."""
    held: list[list] | None = None
    for b in batches:
        cols = [c.to_pylist() for c in b.columns[:columns]]
        for i in range(b.num_rows):
            if held is not None and held[0][0] == cols[0][i]:
                for h, c in zip(held, cols):
                    h.append(c[i])
            else:
                if held is not None:
                    yield held
                held = [[c[i]] for c in cols]
    if held is not None:
        yield held


def _costs(roles: tuple[int, ...]) -> list[list[Cost]]:
    """costs[entry][leave]; row 4 holds the number of turns."""
    return [[c for c, _ in forward(roles, s)[-1]] for s in STATES] + [[(len(roles), 0, 0)]]


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, piece, out_turn, turn, role, action, text): the repaired conversations, a row a piece."""
    spark = turns.sparkSession
    shared_dir(spark)
    kinds = [turns.schema[c].dataType.simpleString() for c in (conv_col, turn_col)]
    rows = turns.select(*[F.col(f"`{c}`").alias(n) for c, n in ((conv_col, "conv_id"), (turn_col, "turn"), (role_col, "role"), (text_col, "text"))])
    order = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("role"), F.xxhash64("text")]
    sorted_rows = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    # Ranges come from a sample: both passes must see the same ones, and partitions must keep their numbers.
    sorted_rows = sorted_rows.checkpoint()

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, found, last = TaskContext.get().partitionId(), [], None
        for run in _runs(batches, 2):
            if last is None:
                found.append(run)
            last = run
        if found and last is not found[0]:
            found.append(last)
        names = ["only"] if len(found) == 1 else ["first", "last"]
        out = [(pid, name, repr(run[0][0]), repr(_costs(tuple(map(role_state, run[1]))))) for name, run in zip(names, found)]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int32(), pa.string(), pa.string(), pa.string()))], ["pid", "end", "conv", "costs"])

    import ast

    borders = sorted_rows.select("conv_id", "role").mapInArrow(ends, "pid int, end string, conv string, costs string").collect()
    borders = sorted(((r.pid, r.end, r.conv, ast.literal_eval(r.costs)) for r in borders), key=lambda r: (r[0], r[1] == "last"))
    linked = spark.sparkContext.broadcast(link(borders))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, table = TaskContext.get().partitionId(), linked.value
        out: list[tuple] = []

        def emit(run: list[list], how: tuple | None) -> None:
            roles = tuple(map(role_state, run[2]))
            if how is None:
                ways = (_repair_short(roles) if len(roles) <= 16 else repair(roles))[1]
                number = piece = 0
                first = end = True
            else:
                entry, leave, number, piece, first, end = how
                ways = repair(roles, entry, leave)[1]
            for k, ((state, merged, inserted), turn, text) in enumerate(zip(ways, run[1], run[3])):
                for q in inserted:
                    out.append((run[0][0], piece, number, None, ROLES[q - 1], "insert", (FOOT if piece else "") + HEAD.format(role=ROLES[q - 1])))
                    piece, number = piece + 1, number + 1
                body = (text or "").replace("<|", "< |")
                relabel = state != roles[k]
                action = ("relabel_merge" if relabel else "merge") if merged else ("relabel" if relabel else "keep")
                number += not merged
                out.append((run[0][0], piece, number - 1, turn, ROLES[state - 1], action, (JOIN if merged else (FOOT if piece else "") + HEAD.format(role=ROLES[state - 1])) + body))
                piece += 1
            if end:
                for q in ending(ways[-1][0])[1]:
                    out.append((run[0][0], piece, number, None, ROLES[q - 1], "insert", FOOT + HEAD.format(role=ROLES[q - 1])))
                    piece, number = piece + 1, number + 1
                out[-1] = (*out[-1][:6], out[-1][6] + FOOT)

        def flush() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((types[0], pa.int64(), pa.int64(), types[1], pa.string(), pa.string(), pa.string()))], ["conv_id", "piece", "out_turn", "turn", "role", "action", "text"])
            out.clear()
            return b

        types: list[pa.DataType] = []

        def typed() -> Iterator[pa.RecordBatch]:
            for b in batches:
                types[:] = [b.column(0).type, b.column(1).type]
                yield b

        held, k = None, 0
        for run in _runs(typed(), 4):
            if held is not None:
                emit(held, table.get((pid, "first")) if k == 0 else None)
                k += 1
                if len(out) >= 4096:
                    yield flush()
            held = run
        if held is not None:
            emit(held, table.get((pid, "last" if k else "only")))
            yield flush()

    return sorted_rows.mapInArrow(render, f"conv_id {kinds[0]}, piece long, out_turn long, turn {kinds[1]}, role string, action string, text string")
