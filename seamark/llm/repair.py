"""Conversation structure repair: cheapest edits to a well-formed order of roles, by Four-Russians block tables.

A conversation becomes a string over nine symbols (role class, truncated or not, or: must go).  The cost of
having written a well-formed prefix is a vector over four states; less its smallest entry it takes few
values, so the step for every vector and every block of `BLOCK` symbols is laid down once.  Long conversations
go block by block through that table; then blocks are expanded from the last to the first to mark the states
that cheapest repairs pass, and a walk from the front takes the ASCII-least edit among the marked ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import let, struct
from .common import unused

BLOCK = 4
WHITE = " \t\n\x0b\f\r"

# Role classes, and the bits that Spark adds to them.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
BLANK_BIT, CUT_BIT = 4, 8

# States: nothing written, after the system turn, after a user turn, after an assistant turn.
START, TOLD, ASKED, ANSWERED = range(4)
ACCEPT = (START, ANSWERED)
WRITES = (ASKED, ASKED, ANSWERED, ASKED)                       # state after a turn that the repair gives its role
KEEPS = {(START, SYSTEM): TOLD, (START, USER): ASKED, (TOLD, USER): ASKED, (ANSWERED, USER): ASKED, (ASKED, ASSISTANT): ANSWERED}
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
GONE, SYMBOLS = 8, 9                                            # symbol of a turn that must go; else 2 * class + truncated
FAR = 8     # no continuation is worth more than 7, so a state that much dearer than the best can be forgotten
NEVER = 1 << 20


def _closed(v: list[int]) -> tuple[int, ...]:
    """Costs once turns may be inserted too."""
    a, b, c, d = v
    c = min(c, a + INSERT, b + INSERT)
    d = min(d, c + INSERT)
    return a, b, min(c, d + INSERT), d


def _normal(v: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    least = min(v)
    return tuple(x - least if x - least < FAR else NEVER for x in v), least


def moves(state: int, symbol: int) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, next state) of consuming a turn, in ASCII order of the edits."""
    yield "D", DELETE, state
    if symbol != GONE:
        cut = CUT * (symbol % 2)
        if (state, symbol // 2) in KEEPS:
            yield "K", cut, KEEPS[state, symbol // 2]
        yield "R", REROLE + cut, WRITES[state]


@dataclass(frozen=True)
class Tables:
    vectors: list[tuple[int, ...]]
    step: list[list[int]]         # vector and symbol to vector
    rise: list[list[int]]         # ... and what the smallest entry grew by
    block: list[list[int]]        # vector and block of symbols to vector
    block_rise: list[list[int]]
    back: list[list[list[int]]]   # vector, symbol, marked states behind it: marked states before it
    first: int
    opening: int


@lru_cache(maxsize=1)
def tables() -> Tables:
    """All vectors that occur, and the steps between them; the same in every worker."""
    first, opening = _normal(_closed([0, NEVER, NEVER, NEVER]))
    vectors, number, step, rise = [first], {first: 0}, [], []
    at = 0
    while at < len(vectors):
        row, grown = [], []
        for symbol in range(SYMBOLS):
            new = [NEVER] * 4
            for state, cost in enumerate(vectors[at]):
                for _, price, to in moves(state, symbol):
                    new[to] = min(new[to], cost + price)
            found, least = _normal(_closed(new))
            if found not in number:
                number[found] = len(vectors)
                vectors.append(found)
            row.append(number[found])
            grown.append(least)
        step.append(row)
        rise.append(grown)
        at += 1
    one, up = np.array(step), np.array(rise)
    block, block_rise = one, up
    for _ in range(BLOCK - 1):      # one symbol more: the step from wherever the block before it led
        block_rise = (block_rise[:, :, None] + up[block]).reshape(len(vectors), -1)
        block = one[block].reshape(len(vectors), -1)

    def marked(v: int, symbol: int, behind: int) -> int:
        mask, here, there, least = 0, vectors[v], vectors[step[v][symbol]], rise[v][symbol]
        for state in range(4):
            if here[state] < NEVER and any(behind >> to & 1 and here[state] + price == least + there[to] for _, price, to in moves(state, symbol)):
                mask |= 1 << state
        return _before_inserts(here, mask)

    back = [[[marked(v, s, m) for m in range(16)] for s in range(SYMBOLS)] for v in range(len(vectors))]
    return Tables(vectors, step, rise, block.tolist(), block_rise.tolist(), back, 0, opening)


def _before_inserts(v: tuple[int, ...], mask: int) -> int:
    """Marked states and those that reach one by inserting turns at no more than its cost."""
    for _ in range(2):
        for state in range(4):
            if v[state] < NEVER and mask >> WRITES[state] & 1 and v[state] + INSERT == v[WRITES[state]]:
                mask |= 1 << state
    return mask


@lru_cache(maxsize=1 << 16)
def _walk(v: int, symbol: int, here: int, behind: int, state: int) -> tuple[str, tuple[int, ...], int]:
    """Edits up to and with a turn: letters, the state each wrote (-1: none, -2: as it was), and the next state."""
    t = tables()
    now, then, least = t.vectors[v], t.vectors[t.step[v][symbol]], t.rise[v][symbol]
    letters, wrote = "", []
    while True:
        taken = {edit: to for edit, price, to in moves(state, symbol) if behind >> to & 1 and now[state] + price == least + then[to]}
        inserts = here >> WRITES[state] & 1 and now[state] + INSERT == now[WRITES[state]]
        edit = min([*taken, *(["I"] if inserts else [])])
        letters += edit
        state = WRITES[state] if edit == "I" else taken[edit]
        wrote.append({"D": -1, "K": -2}.get(edit, state))
        if edit != "I":
            return letters, tuple(wrote), state


def repair(symbols: list[int]) -> tuple[int, str, list[tuple[int, int]]]:
    """Least cost, ASCII-least edits of that cost, and the turns they leave: (row or -1, state written or -2 for its own role)."""
    t = tables()
    n, whole = len(symbols), len(symbols) // BLOCK
    v, cost, at = t.first, t.opening, [t.first]
    for k in range(whole):
        code = 0
        for symbol in symbols[k * BLOCK:(k + 1) * BLOCK]:
            code = code * SYMBOLS + symbol
        cost += t.block_rise[v][code]
        v = t.block[v][code]
        at.append(v)
    tail = [v]
    for symbol in symbols[whole * BLOCK:]:
        cost += t.rise[v][symbol]
        v = t.step[v][symbol]
        tail.append(v)
    final = t.vectors[v]
    least = min(final[s] for s in ACCEPT)
    mask = _before_inserts(final, sum(1 << s for s in ACCEPT if final[s] == least))
    masks, passed = [0] * n + [mask], [0] * n + [v]
    for k in range(whole, -1, -1):          # blocks backward, each expanded from the vector it began with
        first, own = k * BLOCK, tail
        if k < whole:
            own = [at[k]]
            for symbol in symbols[first:first + BLOCK]:
                own.append(t.step[own[-1]][symbol])
        for i in range(min(n, first + BLOCK) - 1, first - 1, -1):
            passed[i] = own[i - first]
            masks[i] = t.back[passed[i]][symbols[i]][masks[i + 1]]
    state, letters, left = START, [], []
    for i, symbol in enumerate(symbols):
        edits, wrote, state = _walk(passed[i], symbol, masks[i], masks[i + 1], state)
        letters.append(edits)
        left.extend((-1 if edit == "I" else i, w) for edit, w in zip(edits, wrote) if w != -1)
    while not (state in ACCEPT and final[state] == least):
        state = WRITES[state]
        letters.append("I")
        left.append((-1, state))
    return cost + least, "".join(letters), left


_PLAN = "struct<blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,cost:bigint,audit:string,turns:array<struct<row:int,wrote:int>>>"
_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


def _planned(kinds: np.ndarray, keys: np.ndarray) -> tuple:
    roles, blank = kinds % 4, (kinds & BLANK_BIT) > 0
    duplicate = np.ones(len(kinds), dtype=bool)
    duplicate[np.unique(keys, return_index=True)[1]] = False
    duplicate &= ~blank
    cut = ((kinds & CUT_BIT) > 0) & ~blank & ~duplicate
    symbols = np.where(blank | duplicate, GONE, 2 * roles + cut)
    illegal = sum((a, b) not in _LEGAL for a, b in zip(roles[:-1].tolist(), roles[1:].tolist()))
    return int(blank.sum()), int(duplicate.sum()), int(cut.sum()), illegal, *repair(symbols.tolist())


def _plan(given: pa.Array, _same: pa.Array) -> pa.Array:
    if isinstance(given, pa.ChunkedArray):
        given = given.combine_chunks()
    kinds, keys = given.field("kinds"), given.field("keys")
    offsets, flat, names = kinds.offsets.to_numpy(), kinds.values.to_numpy(), keys.values.to_numpy()
    base = keys.offsets.to_numpy()
    rows = [_planned(flat[a:b], names[c:c + b - a]) for a, b, c in zip(offsets[:-1], offsets[1:], base[:-1])]
    left = [r[6] for r in rows]
    turns = np.array([t for r in left for t in r], dtype=np.int32).reshape(-1, 2)
    plan = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, left)], dtype=np.int32)), pa.StructArray.from_arrays(
        [pa.array(np.ascontiguousarray(turns[:, 0])), pa.array(np.ascontiguousarray(turns[:, 1]))], ["row", "wrote"]))
    figures = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
    return pa.StructArray.from_arrays([*figures, pa.array([r[5] for r in rows], pa.string()), plan],
                                      ["blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns"])


def _kind(turn: Column) -> Column:
    """Class of the role by its initial, and whether the text is blank or ends without a full stop."""
    initial = F.substring(turn["role"], 1, 1)
    role = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    return let(F.substring(F.rtrim(turn["text"], F.lit(WHITE)), -1, 1), lambda last: role + F.when(last == "", BLANK_BIT).when(
        ~last.isin(".", "!", "?"), CUT_BIT).otherwise(0))


def gather(rows: DataFrame, copies: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", null: str = " ") -> DataFrame:
    """One row per conversation: its id and `turns` by number (nulls first), then role and text.

    `copies` says how often a row counts (once); a conversation all of whose rows count zero times has no turns.
    Null roles and texts become `null`; rows with a null id are one conversation.
    """
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(null)).alias("role"), F.coalesce(F.col(text_col), F.lit(null)).alias("text"))
    kept = F.array_repeat(turn, F.lit(1) if copies is None else copies)
    return rows.groupBy(F.col(conv_col)).agg(F.sort_array(F.flatten(F.collect_list(kept))).alias("turns"))


def repair_conversations(talks: DataFrame, turns: str = "turns", column: str = "repair") -> DataFrame:
    """Add `column`: faults of each conversation and its cheapest repair.

    `turns` is an array of (turn, role, text) in order, as `gather` makes it; a conversation is one training
    example and one row, nothing larger meets in a task.  The result is a struct: gaps in the numbers, blank,
    duplicate, truncated (a turn's first fault counts), illegal (neighbouring roles), cost, audit (the edits
    Keep, Rerole, Delete, Insert by initial), turns (role and text after the repair).

    Empty conversations cost nothing and stay empty; null roles, texts and numbers: as `gather` says, a null
    `turns` counts as empty.  Very long texts stay in the JVM, only a few bytes per turn cross to Python.
    Repeated turns are duplicates; they are told apart by 64-bit hashes of role and text.  Equal costs take
    the ASCII-least audit.  An empty table gives an empty result.  Other columns are kept; one named like
    `column` is an error.
    """
    if column.lower() in {c.lower() for c in talks.columns}:
        raise ValueError(f"there is a column {column} already")
    own, given, plan = unused(talks, "_turns"), unused(talks, "_given"), unused(talks, "_plan")
    known = talks.withColumn(own, F.coalesce(F.col(turns), F.expr("cast(array() as array<struct<turn:bigint,role:string,text:string>>)")))
    asked = known.withColumn(given, F.struct(
        F.transform(own, _kind).alias("kinds"), F.transform(own, lambda t: F.xxhash64(t["role"], t["text"])).alias("keys")))
    run = F.arrow_udf(_plan, _PLAN).asNondeterministic()     # two references keep its input in a projection of its own
    found = asked.withColumn(plan, run(F.col(given), F.col(given)))
    numbers = F.filter(F.transform(own, lambda t: t["turn"]), lambda n: n.isNotNull())
    gaps = let(numbers, lambda ns: F.coalesce(F.array_max(ns) - F.array_min(ns) + 1 - F.size(F.array_distinct(ns)), F.lit(0)).cast("long"))
    p = F.col(plan)

    def after(t):
        source = F.get(F.col(own), t["row"])
        role = F.when(t["wrote"] == ASKED, "user").when(t["wrote"] == ANSWERED, "assistant").otherwise(source["role"])
        return struct(role=role, text=F.when(t["row"] < 0, "").otherwise(source["text"]))

    return found.withColumn(column, struct(
        gaps=gaps, blank=p["blank"], duplicate=p["duplicate"], truncated=p["truncated"], illegal=p["illegal"], cost=p["cost"], audit=p["audit"],
        turns=F.transform(p["turns"], after))).drop(own, given, plan)


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's faults, one turn in four, by CRC-32 of its id; `copies` is 0 for a dropped turn, 2 for a repeated one."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    known = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), fault.alias("fault"))
    return known.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
                        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                        F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1).alias("copies"))


def digest(found: DataFrame, column: str = "repair") -> DataFrame:
    r = F.col(column)
    lines = F.array_join(F.transform(r["turns"], lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return found.select("conv_id", *[r[n].alias(n) for n in names], F.sha2(lines, 256).alias("repaired_sha256"))
