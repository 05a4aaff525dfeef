"""Conversation structure repair by a square-root checkpointed dynamic programme.

Rows of a conversation, in order, are kept, given another role or deleted, and empty turns
are inserted, at the least cost that gives the roles ``(s?(ua)+)?``. Four states say what
may follow: nothing yet, after a system turn, after a user turn, after an assistant turn.
``costs[i][q]`` is the least cost of finishing from row i in state q.

A conversation of n rows is cut into blocks of about the square root of n, and costs are
held only at the ends of blocks:

1. Each block is reduced to a 4 x 4 table of the costs from state to state, by stepping
   back over its rows from each state at its end.
2. One pass over a conversation's blocks from the last to the first gives the cost vector
   at every checkpoint.
3. Each block steps back from its checkpoint once more and walks forward from each of the
   four states it can be entered in, along tight edits only, the first letter first.
4. One pass over the blocks from the first to the last follows the walks from the state
   the conversation begins in.

So rows meet only in blocks, blocks only as small tables in one stream per conversation,
and a conversation that holds a third of all rows is spread over the cluster: it is sorted
by range, and repeated turns are found by counts that are summed before they are shuffled.
Steps 1 and 3 stream sorted partitions and hold one block, steps 2 and 4 one block's table.

Defined cases: null roles and texts count as one space (no role, and blank); rows stand in
the order of turn, nulls first, then role, text; equal rows are repeated turns; a role
counts by its first letter; rows without a conversation are one; empty tables give empty
results; further columns are ignored. Turns are integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.order import number_rows
from tessera.runtime import keep, require, require_columns

FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3  # costs
START, SYSTEM, USER, ASSISTANT = range(4)  # what came last
FOLLOWS = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {"u": "user", "a": "assistant"}
NEVER = 1 << 40
# A block has the square root of its conversation's rows, but no fewer than these.
LEAST_BLOCK = 64
WORD = r"[^\x20\x09-\x0D]"
_SPACES = " \t\n\x0b\x0c\r"

Vector = tuple[int, int, int, int]
FINAL: Vector = (0, NEVER, NEVER, 0)


def _next(state: int) -> int:
    return AFTER[FOLLOWS[state]]


def _kept_state(initial: str, state: int) -> int | None:
    """The state after keeping a turn of this initial, if it may stand here."""
    if initial == FOLLOWS[state] or (initial == "s" and state == START):
        return AFTER[initial]
    return None


def _with_inserts(costs: Vector) -> Vector:
    """The same where empty turns may come first; two bring back the state."""
    return tuple(min(c, INSERT + costs[_next(q)], 2 * INSERT + costs[_next(_next(q))]) for q, c in enumerate(costs))


@lru_cache(maxsize=1 << 14)
def step_back(initial: str, fault: int, after: Vector) -> Vector:
    """The costs before a row from those behind it, inserts before the row included."""
    out = []
    for q in range(4):
        best = DELETE + after[q]
        if fault not in (BLANK, DUPLICATE):
            more = UNFINISHED if fault == TRUNCATED else 0
            best = min(best, REROLE + more + after[_next(q)])
            kept = _kept_state(initial, q)
            if kept is not None:
                best = min(best, KEEP + more + after[kept])
        out.append(best)
    return _with_inserts(tuple(out))


def walk(rows: list[tuple[str, int]], costs: list[Vector], state: int, last: bool) -> tuple[list[str], int]:
    """The edits of each row, inserts before it included, and the state behind them.
    Letters D, I, K, R; I and R are followed by the new role's letter. Only tight edits
    are taken, the least letter of them, so the whole is the least of all cheapest ones.
    Behind the last row of a conversation come its last inserts."""
    edits = []
    for i, (initial, fault) in enumerate(rows):
        said = ""
        while True:
            now, after = costs[i][state], costs[i + 1]
            if now == DELETE + after[state]:
                said += "D"
                break
            if now == INSERT + costs[i][_next(state)]:
                said += "I" + FOLLOWS[state]
                state = _next(state)
                continue
            more = UNFINISHED if fault == TRUNCATED else 0
            kept = _kept_state(initial, state)
            if kept is not None and now == KEEP + more + after[kept]:
                said, state = said + "K", kept
            else:
                said += "R" + FOLLOWS[state]
                state = _next(state)
            break
        edits.append(said)
    while last and costs[-1][state] > 0:
        edits[-1] += "I" + FOLLOWS[state]
        state = _next(state)
    return edits, state


def _streamed(make: Callable[[tuple, list[tuple]], Iterator[tuple]], key: int, names: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function for ``mapInPandas`` over sorted partitions: ``make`` gets each run of
    rows that agree in their first ``key`` columns, also across batches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for part in parts:
            out: list[tuple] = []
            for row in part.itertuples(index=False, name=None):
                if held and row[:key] != held[0][:key]:
                    out += make(held[0][:key], held)
                    held = []
                held.append(row)
            if out:
                yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(list(make(held[0][:key], held)), columns=names)

    return run


def _block_table(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
    """Step 1; the row also counts faults and breaks, and names the block's border roles."""
    unit: list[Vector] = [tuple(0 if p == q else NEVER for p in range(4)) for q in range(4)]
    initials, faults = [r[3] for r in rows], [r[4] for r in rows]
    for initial, fault in zip(reversed(initials), reversed(faults), strict=True):
        unit = [step_back(initial, fault, v) for v in unit]
    breaks = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    yield (*key, [c for v in unit for c in v], *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), breaks, initials[0], initials[-1])


_TABLE = "conv string, block long, table array<long>, blank long, duplicate long, truncated long, breaks long, first_role string, last_role string"


def _checkpoints(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Step 2 over blocks from the last to the first."""
    conv, costs = None, FINAL
    for part in parts:
        out = []
        for c, block, table in part.itertuples(index=False, name=None):
            last = c != conv
            if last:
                conv, costs = c, _with_inserts(FINAL)
            out.append((c, block, list(costs), last))
            costs = tuple(min(int(table[4 * p + q]) + costs[p] for p in range(4)) for q in range(4))
        yield pd.DataFrame(out, columns=["conv", "block", "costs", "last"])


def _walks(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
    """Step 3: the walk from each state, and where each ends."""
    states = [(r[3], r[4]) for r in rows]
    costs = [tuple(int(c) for c in rows[0][5])]
    for initial, fault in reversed(states):
        costs.append(step_back(initial, fault, costs[-1]))
    costs.reverse()
    walked = [walk(states, costs, q, rows[0][6]) for q in range(4)]
    yield (*key, [w[0] for w in walked], [w[1] for w in walked], costs[0][START])


def _followed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Step 4 over blocks from the first to the last."""
    conv, state = None, START
    for part in parts:
        out = []
        for c, block, walks, ends, cost in part.itertuples(index=False, name=None):
            first = c != conv
            if first:
                conv, state = c, START
            out.append((c, block, list(walks[state]), int(cost) if first else 0))
            state = int(ends[state])
        yield pd.DataFrame(out, columns=["conv", "block", "edits", "cost"])


@dataclass(frozen=True)
class Repair:
    """``rows``: conv_id, place, role, text, edit of the repaired turns, in the order of
    place. ``report``: one row per conversation with its counts, cost and audit."""

    rows: DataFrame
    report: DataFrame


def _name(conv_id: Column) -> Column:
    """A conversation's id as text that is never null."""
    return F.coalesce(F.concat(F.lit("c"), conv_id.cast("string")), F.lit("-"))


def _dealt(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*order)


def repair(rows: DataFrame, least_block: int = LEAST_BLOCK) -> Repair:
    """Find the cheapest edits of every conversation of ``rows`` (conv_id, turn, role,
    text) and apply them. Of several the audit, their letters in order, is the least."""
    require_columns(rows, ["conv_id", "turn", "role", "text"], "conversations")
    require(least_block > 0, "a block needs a row")
    blank = F.lit(" ")
    clean = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    placed = keep(number_rows(clean, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "place", hot=True))
    placed = placed.withColumn("conv", _name(F.col("conv_id")))
    # Only turns that occur twice are looked up again, and those by one row each.
    same = [F.col("conv"), F.col("role"), F.sha2("text", 256).alias("said")]
    repeated = keep(placed.groupBy(*same).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("conv", "role", "said", "first"))
    sizes = keep(placed.groupBy("conv", "conv_id").agg(F.max("place").alias("n"), F.min("turn").alias("low"), F.max("turn").alias("high")))
    turns = placed.where(F.col("turn").isNotNull()).groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(F.count("one").alias("turns"))
    later = placed.select("conv", "place", "role", "text", *same[2:]).join(repeated, ["conv", "role", "said"], "left")
    wordless = ~F.rlike("text", F.lit(WORD))
    fault = F.when(wordless, BLANK).when(F.col("place") > F.col("first"), DUPLICATE).when(~F.substring(F.rtrim("text", F.lit(_SPACES)), -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    judged = later.select("conv", "place", F.substring("role", 1, 1).alias("initial"), fault.cast("int").alias("fault"))
    length = F.greatest(F.lit(least_block), F.ceil(F.sqrt("n"))).cast("long")
    block = F.floor((F.col("place") - 1) / length).alias("block")
    narrow = keep(judged.join(sizes.select("conv", "n"), "conv").select("conv", block, "place", "initial", "fault"))
    by_block, in_order = ["conv", "block"], [F.col("conv"), F.col("block"), F.col("place")]

    tables = keep(_dealt(narrow, by_block, in_order).mapInPandas(_streamed(_block_table, 2, [f.split()[0] for f in _TABLE.split(", ")]), _TABLE))
    backwards = _dealt(tables.select("conv", "block", "table"), ["conv"], [F.col("conv"), F.col("block").desc()])
    ends = backwards.mapInPandas(_checkpoints, "conv string, block long, costs array<long>, last boolean")
    met = narrow.join(keep(ends), by_block).select("conv", "block", "place", "initial", "fault", "costs", "last")
    walked = _dealt(met, by_block, in_order).mapInPandas(
        _streamed(_walks, 2, ["conv", "block", "walks", "ends", "cost"]), "conv string, block long, walks array<array<string>>, ends array<long>, cost long"
    )
    chosen = keep(_dealt(walked, ["conv"], [F.col("conv"), F.col("block")]).mapInPandas(_followed, "conv string, block long, edits array<string>, cost long"))

    audit = F.regexp_replace(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", F.array_join("edits", "").alias("e")))), lambda x: x["e"]), ""), "[a-z]", "")
    edits = chosen.groupBy("conv").agg(F.sum("cost").alias("cost"), audit.alias("audit"))
    border = F.sort_array(F.collect_list(F.struct("block", "first_role", "last_role")))
    counted = tables.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "breaks")], border.alias("borders"))
    met_roles = F.transform(F.sequence(F.lit(1), F.size("borders") - 1), lambda i: F.concat(F.element_at("borders", i)["last_role"], F.element_at("borders", i + 1)["first_role"]))
    across = F.when(F.size("borders") > 1, F.size(F.filter(met_roles, lambda r: ~r.isin("su", "ua", "au")))).otherwise(0)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    report = sizes.join(turns, "conv", "left").join(counted, "conv").join(edits, "conv").select(
        "conv_id", "n", gaps, "blank", "duplicate", "truncated", (F.col("breaks") + across).alias("illegal"), "cost", "audit"
    )

    each = placed.join(sizes.select("conv", "n"), "conv").withColumn("block", block).join(chosen.select("conv", "block", "edits"), by_block)
    own = F.element_at("edits", (F.col("place") - F.col("block") * length).cast("int"))
    done = each.select("conv_id", "place", "role", "text", F.posexplode(F.regexp_extract_all(own, F.lit("[DIKR][ua]?"), F.lit(0))).alias("at", "edit")).where("edit <> 'D'")
    new_role = F.when(F.col("edit") == "K", F.col("role")).when(F.endswith("edit", F.lit("u")), NAMES["u"]).otherwise(NAMES["a"])
    repaired = done.select(
        "conv_id", F.struct("place", "at").alias("place"), new_role.alias("role"), F.when(F.startswith("edit", F.lit("I")), "").otherwise(F.col("text")).alias("text"),
        F.substring("edit", 1, 1).alias("edit"),
    )
    return Repair(repaired, report)


def _digests(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import hashlib

    conv, state, lines = None, hashlib.sha256(), 0
    for part in parts:
        out = []
        for c, role, text in part.itertuples(index=False, name=None):
            if c != conv:
                if conv is not None:
                    out.append((conv, state.hexdigest()))
                conv, state, lines = c, hashlib.sha256(), 0
            state.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
            lines += 1
        yield pd.DataFrame(out, columns=["conv", "sha256"])
    if conv is not None:
        yield pd.DataFrame([(conv, state.hexdigest())], columns=["conv", "sha256"])


def text_digests(rows: DataFrame) -> DataFrame:
    """(conv, sha256) of the repaired turns of each conversation, ``role:text`` with a line
    break between. A digest runs over its text in order, so each conversation is streamed
    through one task, which holds one batch of rows; ``conv`` is ``_name`` of its id."""
    named = rows.select(_name(F.col("conv_id")).alias("conv"), "place", "role", "text")
    ordered = _dealt(named, ["conv"], [F.col("conv"), F.col("place")]).select("conv", "role", "text")
    return ordered.mapInPandas(_digests, "conv string, sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with faults by the hash of conversation and turn: of each 20 hashes one
    row is dropped, one emptied, one loses its sentence ends, one stands twice and one
    becomes a user turn. Nulls read as one space."""
    blank = F.lit(" ")
    part = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    text = F.coalesce("text", blank)
    text = F.when(F.col("part") == 1, "").when(F.col("part") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(F.col("part") == 4, "user").otherwise(F.coalesce("role", blank))
    copies = F.explode(F.when(F.col("part") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    told = rows.select("conv_id", "turn", "role", "text", part.alias("part")).where("part <> 0")
    return told.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repair_digest(original: DataFrame, rows: DataFrame) -> DataFrame:
    """The report of ``rows`` and the digest of their repair for every conversation of
    ``original``; one without rows has zeros, no edits and the digest of no text."""
    done = repair(rows)
    ids = original.select("conv_id").distinct().withColumn("conv", _name(F.col("conv_id")))
    report = done.report.withColumn("conv", _name(F.col("conv_id"))).drop("conv_id")
    joined = ids.join(report, "conv", "left").join(text_digests(done.rows), "conv", "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select(
        "conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
