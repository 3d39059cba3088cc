r"""Chat formatting with minimum-cost role repair (operator 6).

A conversation's turns pass through an automaton of legal sequences: an optional system message, then user and assistant
in alternation. Each turn is kept, relabelled, merged into the message before it, or preceded by an inserted empty
message; dynamic programming finds the cheapest way, and the repaired sequence is rendered.

A turn's choices are a matrix of costs from state to state, and matrices of neighbouring stretches combine (least sum), so
a conversation of any length is cut into stretches of SPAN turn numbers, and where more than SPAN rows share a number or have
none, into ranges of role and text: stretches are solved in parallel for every state they may begin in, a short pass over
the stretches fixes the states between them, and each stretch is then rendered on its own. A conversation within one
stretch needs a single pass.

Where several ways cost the same, a number by turn and choice decides, whose sum is part of the cost; costs are whole numbers,
so what is chosen doesn't depend on where stretches end.

The result has a row for each turn, in the order of `place` within its conversation; joining `rendered` in that order
gives the conversation's text.

Nulls: a null role counts as none of the legal ones and is relabelled; a null text is an empty one; turns without a number
come first; a null conv_id is one conversation. Rows that repeat (conversation, number, role and text) count once; other
rows with the same number stand in order of role and text (null ones last). Unknown roles are relabelled, known aliases are free. Extra
columns are dropped.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import cut

SPAN = 256
#: What tells the stretches of a conversation apart and orders them.
STRETCH = ("part", "step", "slot")
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = ("", "system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
#: Messages that may follow each state.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
COSTS = {"relabel": 1.0, "merge": 0.6, "insert": 1.25, "no_user": 0.9}
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
OUT = "conv_id long, turn long, place long, role_in string, role string, action string, inserted string, cost double, rendered string"


def choices(role: str | None, state: int) -> list[tuple[float, int, str, int]]:
    """Ways to place a turn after a state: cost, next state, action, inserted role (0 for none)."""
    name = (role or "").strip().lower()
    own = ROLES.get(ALIASES.get(name, name), START)
    out = []
    for to in LEGAL[state]:
        out.append((0.0 if to == own else COSTS["relabel"], to, "keep" if to == own else "relabel", 0))
        for then in LEGAL[to]:
            out.append((COSTS["insert"] + (0.0 if then == own else COSTS["relabel"]), then, "keep" if then == own else "relabel", to))
    if state != START:
        out.append((COSTS["merge"] + (0.0 if state == own else COSTS["relabel"]), state, "merge", 0))
    return out


#: Costs are counted in hundredths, times UNIT; below it adds up what decides between equal ones.
UNIT = 1 << 48
_MIXED = 0x9E3779B97F4A7C15


def lots(turn: int | None, role: str | None, text: str | None) -> int:
    """A number by which a turn's choices are told apart."""
    return zlib.crc32((text or "").encode(errors="replace"), zlib.crc32(f"{turn} {role} ".encode(errors="replace"))) | 1 << 32


def _forward(turns: list[tuple[str | None, int]], begin: int) -> tuple[list[int | None], list[list[tuple[int, tuple] | None]]]:
    """turns: role and lots. Least cost to each state after all turns, and how each was reached."""
    best: list[int | None] = [None] * 4
    best[begin], steps, known = 0, [], {}
    for role, lot in turns:
        if role not in known:
            known[role] = [(state, [(round(c[0] * 100) * UNIT, c) for c in choices(role, state)]) for state in range(4)]
        after: list[int | None] = [None] * 4
        how: list[tuple[int, tuple] | None] = [None] * 4
        mixed = lot
        for state, ways in known[role]:
            sofar = best[state]
            for base, choice in ways:
                mixed = (mixed * _MIXED + 1) & 0xFFFFFFFFFFFFFFFF  # moved on for each way, so a way's lot doesn't depend on `best`
                if sofar is None:
                    continue
                cost = sofar + base + (mixed >> 40)
                if after[choice[1]] is None or cost < after[choice[1]]:
                    after[choice[1]], how[choice[1]] = cost, (state, choice)
        best = after
        steps.append(how)
    return best, steps


def final(state: int) -> int:
    """What it costs to end in a state: a lone system message is followed by an empty user message."""
    return round(COSTS["no_user"] * 100) * UNIT if state == SYSTEM else 0


def repaired(turns: list[tuple[str | None, int]], begin: int = START, end: int | None = None) -> list[tuple[int, tuple]]:
    """For each turn (role and lots) the state before it and the choice, at least cost."""
    best, steps = _forward(turns, begin)
    if end is None:
        end = min((s for s in range(4) if best[s] is not None), key=lambda s: (best[s] + final(s), s))
    path = []
    for how in reversed(steps):
        path.append(how[end])
        end = how[end][0]
    return path[::-1]


def rendered(path: list[tuple[int, tuple]], texts: list[str], last: bool) -> list[str]:
    """What each turn adds to the conversation's text: a message is closed where the next one begins, or at the end."""
    out = []
    for (before, (_, to, action, inserted)), text in zip(path, texts):
        text = (text or "").replace("<|", "< |")
        if action == "merge":
            out.append("\n" + text)
            continue
        piece = CLOSE if before != START else ""
        if inserted:
            piece += f"{OPEN}{NAMES[inserted]}\n{CLOSE}"
        out.append(f"{piece}{OPEN}{NAMES[to]}\n{text}")
    if last and path:
        out[-1] += CLOSE
        if path[-1][1][1] == SYSTEM:
            out[-1] += f"{OPEN}user\n{CLOSE}"
    return out


def _ordered(table: pa.Table) -> pa.Table:
    """Turns in their order: those without a number first, then by role and text, null ones last."""
    table = table.sort_by([("turn", "ascending"), ("role", "ascending"), ("text", "ascending")])
    known = pc.is_valid(table.column("turn"))
    return pa.concat_tables([table.filter(pc.invert(known)), table.filter(known)])


def _turns(table: pa.Table) -> list[tuple[str | None, int]]:
    return [(role, lots(turn, role, text)) for turn, role, text in zip(*(table.column(c).to_pylist() for c in ("turn", "role", "text")))]


def _told(table: pa.Table, begin: int = START, end: int | None = None, last: bool = True, place: int = 0) -> pa.Table:
    table = _ordered(table.select(["conv_id", "turn", "role", "text"]))
    path = repaired(_turns(table), begin, end)
    texts = rendered(path, table.column("text").to_pylist(), last)
    return pa.table({
        "conv_id": table.column("conv_id"), "turn": table.column("turn"), "place": pa.array(range(place, place + len(path)), pa.int64()), "role_in": table.column("role"),
        "role": pa.array([NAMES[c[1]] for _, c in path], pa.string()), "action": pa.array([c[2] for _, c in path], pa.string()),
        "inserted": pa.array([NAMES[c[3]] or None for _, c in path], pa.string()), "cost": pa.array([c[0] for _, c in path], pa.float64()), "rendered": pa.array(texts, pa.string()),
    })


def _stretch(table: pa.Table) -> pa.Table:
    """A stretch's matrix: least cost from each state before it to each state after it, as decimal numbers."""
    turns = _turns(_ordered(table))
    matrix = [None if c is None else str(c) for begin in range(4) for c in _forward(turns, begin)[0]]
    return pa.table({"conv_id": table.column("conv_id")[:1], **{c: table.column(c)[:1] for c in STRETCH}, "n": pa.array([len(turns)], pa.int64()), "matrix": pa.array([matrix], pa.list_(pa.string()))})


def _chained(table: pa.Table) -> pa.Table:
    """The states between the stretches of a conversation."""
    table = table.sort_by([(c, "ascending") for c in STRETCH])
    matrices = [[None if c is None else int(c) for c in m] for m in table.column("matrix").to_pylist()]
    costs: list[list[int | None]] = [[0, None, None, None]]

    def ways(m: list, before: list, end: int) -> list[tuple[int, int]]:
        return [(before[s] + m[4 * s + end], s) for s in range(4) if before[s] is not None and m[4 * s + end] is not None]

    for m in matrices:
        costs.append([min(ways(m, costs[-1], end), default=(None,))[0] for end in range(4)])
    state = min((s for s in range(4) if costs[-1][s] is not None), key=lambda s: (costs[-1][s] + final(s), s))
    ends = [state]
    for m, before in zip(reversed(matrices), reversed(costs[:-1])):
        state = min(ways(m, before, state))[1]
        ends.append(state)
    ends = ends[::-1]
    n = np.array(table.column("n").to_pylist(), np.int64)
    return pa.table({
        "conv_id": table.column("conv_id"), **{c: table.column(c) for c in STRETCH}, "begin": pa.array(ends[:-1], pa.int32()), "end": pa.array(ends[1:], pa.int32()),
        "last": pa.array([k == len(n) - 1 for k in range(len(n))]), "first_place": pa.array(np.cumsum(n) - n),
    })


def _placed(table: pa.Table) -> pa.Table:
    one = {c: table.column(c)[0].as_py() for c in ("begin", "end", "last", "first_place")}
    return _told(table, one["begin"], one["end"], one["last"], one["first_place"])


def number() -> Column:
    """Turn numbers, those without one first."""
    return F.coalesce(F.col("turn"), F.lit(-(1 << 62)))


def _slots(turns: DataFrame, crowds: DataFrame, span: int) -> DataFrame:
    """turns(conv_id, turn, role, text, part) with `step`, the turn itself in parts where some number has more than `span` rows,
    and `slot`, ranges of role and text within such a number. Ranges are sorted each on their own, and rows of a range are cut
    by the `span`, so no stretch grows with a conversation, nor with rows that share a number or have none."""
    zero = F.lit(0).cast("long")
    crowded = crowds.select(F.col("conv_id").alias("c"), F.col("part").alias("p")).distinct().withColumn("crowded", F.lit(True))
    d = turns.join(crowded, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    d = d.select("conv_id", "turn", "role", "text", "part", F.when(F.col("crowded"), number()).otherwise(zero).alias("step"))
    many = crowds.select(F.col("conv_id").alias("k"), F.col("turn").alias("t"))
    same = F.col("conv_id").eqNullSafe(F.col("k")) & F.col("turn").eqNullSafe(F.col("t"))
    order = (F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc_nulls_last("role"), F.asc_nulls_last("text"))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = d.join(many, same, "left_semi").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = cut(ranged.withColumn("row", F.monotonically_increasing_id()))  # written, so that ranges stay as they were
    return d.join(many, same, "left_anti").withColumn("slot", zero).union(ranged.withColumn("slot", F.floor(F.col("row") / span).cast("long")).drop("row"))


def repair(conversations: DataFrame, span: int = SPAN) -> DataFrame:
    """One row for each distinct turn of conversations(conv_id, turn, role, text)."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").distinct()
    turns = turns.withColumn("part", F.floor(number() / span).cast("long"))
    counts = turns.groupBy("conv_id", "part", "turn").agg(F.count(F.lit(1)).alias("n"))
    # One small table tells which conversations take more than one stretch, and which of their numbers have many rows.
    crowded = F.filter(F.collect_list(F.when(F.col("n") > span, F.struct("part", "turn"))), lambda x: x.isNotNull())
    long = counts.groupBy("conv_id").agg(F.min("part").alias("low"), F.max("part").alias("high"), crowded.alias("crowds"))
    long = cut(long.where("low != 0 or high != 0 or size(crowds) > 0").select("conv_id", "crowds"))
    same = F.col("t.conv_id").eqNullSafe(F.col("l.conv_id"))
    if long.isEmpty():
        return turns.groupBy("conv_id").applyInArrow(lambda t: _told(t), OUT)
    short = turns.alias("t").join(long.alias("l"), same, "left_anti").groupBy("conv_id").applyInArrow(lambda t: _told(t), OUT)
    crowds = long.select("conv_id", F.inline("crowds"))
    parts = turns.alias("t").join(long.alias("l"), same, "left_semi")
    zero = F.lit(0).cast("long")
    parts = parts.withColumns({"step": zero, "slot": zero}) if crowds.isEmpty() else _slots(parts, crowds, span)
    matrices = parts.groupBy("conv_id", *STRETCH).applyInArrow(_stretch, "conv_id long, part long, step long, slot long, n long, matrix array<string>")
    chain = matrices.groupBy("conv_id").applyInArrow(_chained, "conv_id long, part long, step long, slot long, begin int, end int, last boolean, first_place long")
    met = F.col("p.conv_id").eqNullSafe(F.col("c.conv_id"))
    for name in STRETCH:
        met = met & (F.col(f"p.{name}") == F.col(f"c.{name}"))
    joined = parts.alias("p").join(chain.alias("c"), met)
    joined = joined.select("p.conv_id", "p.turn", "p.role", "p.text", *[f"p.{name}" for name in STRETCH], "begin", "end", "last", "first_place")
    return short.union(joined.groupBy("conv_id", *STRETCH).applyInArrow(_placed, OUT))
