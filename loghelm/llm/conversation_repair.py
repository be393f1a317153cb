"""Structure repair of conversations: faults, the cheapest edits, and the repaired turns.

The turns of a conversation are taken by turn number (nulls first), then role and text. A turn is
blank (no character but space, tab to carriage return), else a duplicate (its role and text were
seen earlier in the conversation), else truncated (its last such character is not `.`, `!` or `?`).
The edits give a conversation whose roles are nothing, or pairs of user and assistant after at
most one system turn. Keep costs 0, Rerole to user or assistant 2, Delete 3 (required for blank
and duplicate turns), Insert of an empty user or assistant turn 2, and a truncated turn that is
not deleted 1 more. Of equally cheap audits (the edits' initials) the least in ASCII is taken.

1. The turns are range-partitioned and numbered in order; a conversation of any size is spread
   over as many tasks as its turns fill.
2. A turn's role initial and fault are one character; the characters of up to BLOCK turns that
   follow each other are a signature. A block is a whole conversation but for long ones and those
   on the border of two partitions.
3. Each distinct signature is solved once, by recursion over its halves with a memo that all
   signatures of a task share. What a signature does to the four states of the role pattern
   (nothing yet, after system, after user, after assistant) is a 4 x 4 table of least costs, and
   tables of halves make the table of the whole. Blocks of one conversation are chained by such
   tables: costs to go from the last block to the first, then states from the first to the last.
4. Audits are joined back to the blocks by signature, and their edits to the turns by number.

Defined cases: null roles and texts count as one space; roles are judged by their first letter,
and one other than s, u, a is never legal; a null conversation id is one conversation; turns alike
in all columns are repeats of each other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loghelm.llm.common import Scratch

BLOCK = 4096
SPACE = " \t\n\x0b\x0c\r"
#: states of the role pattern: nothing yet, after system, after user, after assistant
STATES = range(4)
#: the state that a user or assistant turn of free choice leads to
FREE = (2, 2, 3, 2)
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: cost to go at the end of a conversation, and the turns inserted there
END = (0, 4, 2, 0)
TAIL = ("", "ua", "a", "")
NEVER = 1 << 40
ROLE = {2: "u", 3: "a"}

# A signature's characters: s, u, a, o (any other role); in capitals if truncated; 0 to 3 in the
# same order if the turn must go.


def _options(mark: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, next state) of a turn."""
    yield "D", 3, state
    if not mark.isdigit():
        more = 1 if mark.isupper() else 0
        if mark.lower() in KEPT[state]:
            yield "K", more, KEPT[state][mark.lower()]
        yield "R", 2 + more, FREE[state]


def _inserts(state: int) -> Iterator[tuple[int, int]]:
    """(cost, state) after none, one or two inserted turns; a third would only repeat a state."""
    for n in range(3):
        yield 2 * n, state
        state = FREE[state]


@lru_cache(maxsize=1 << 16)
def through(signature: str) -> tuple[tuple[int, ...], ...]:
    """Least cost from each state before the turns to each state right after the last of them."""
    if len(signature) == 1:
        table = [[NEVER] * 4 for _ in STATES]
        for state in STATES:
            for paid, now in _inserts(state):
                for _, cost, then in _options(signature, now):
                    table[state][then] = min(table[state][then], paid + cost)
        return tuple(map(tuple, table))
    half = len(signature) // 2
    a, b = through(signature[:half]), through(signature[half:])
    return tuple(tuple(min(a[s][m] + b[m][e] for m in STATES) for e in STATES) for s in STATES)


def to_go(signature: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Least cost from each state before the turns, where `after` is it for the states after them.
    Only differences matter to choices, so the least is 0."""
    table = through(signature)
    cost = [min(table[s][e] + after[e] for e in STATES) for s in STATES]
    return tuple(c - min(cost) for c in cost)


@lru_cache(maxsize=1 << 16)
def solve(signature: str, after: tuple[int, ...], state: int) -> tuple[int, int, tuple[tuple[str, str, str], ...]]:
    """(cost, state at the end, steps) of the least of the cheapest audits; a step is the roles
    inserted before a turn, its edit, and the role that it then has."""
    if len(signature) > 1:
        half = len(signature) // 2
        cost_a, mid, steps_a = solve(signature[:half], to_go(signature[half:], after), state)
        cost_b, end, steps_b = solve(signature[half:], after, mid)
        return cost_a + cost_b, end, steps_a + steps_b
    turn = {s: min(c + after[e] for _, c, e in _options(signature, s)) for s in STATES}
    best = {s: min(paid + turn[now] for paid, now in _inserts(s)) for s in STATES}
    before, paid = "", 0
    while True:
        left = {edit: (c, e) for edit, c, e in _options(signature, state) if c + after[e] == best[state]}
        if "D" not in left and 2 + best[FREE[state]] == best[state]:
            state, paid = FREE[state], paid + 2
            before += ROLE[state]
            continue
        edit = min(left)
        cost, end = left[edit]
        return paid + cost, end, ((before, edit, ROLE.get(end, "s") if edit == "R" else ""),)


@dataclass(frozen=True)
class Repaired:
    """audits: a row for each conversation that has turns. turns: the turns that each conversation
    has after the repair, in the order of (pos, k), with the edit that each comes from."""

    audits: DataFrame
    turns: DataFrame


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> Repaired:
    """Audits and repaired turns of all conversations; see the module."""
    scratch = Scratch(turns.sparkSession)
    placed = scratch.keep(_placed(turns, conv_col, turn_col, role_col, text_col))
    blocks = scratch.keep(_blocks(placed, block))
    solved = scratch.keep(_solved(blocks, scratch))
    whole = _audits(placed, solved)
    return Repaired(whole.withColumnRenamed("c", conv_col), _replayed(placed, solved).withColumnRenamed("c", conv_col))


def _placed(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Turns numbered in order: the partition is in the upper bits of `pos`, and numbers of one
    partition follow each other without a gap."""
    space = F.lit(" ")
    rows = turns.select(F.col(f"`{conv_col}`").alias("c"), F.col(f"`{turn_col}`").cast("long").alias("t"), F.coalesce(F.col(f"`{role_col}`").cast("string"), space).alias("r"), F.coalesce(F.col(f"`{text_col}`").cast("string"), space).alias("x"))
    keys = [F.asc_nulls_first("c"), F.asc_nulls_first("t"), F.asc("r"), F.asc("x")]
    spread = rows.withColumn("same", F.monotonically_increasing_id()).repartitionByRange(*keys, F.asc("same")).sortWithinPartitions(*keys).drop("same")
    ending = F.right(F.rtrim("x", F.lit(SPACE)), F.lit(1))
    initial = F.substring("r", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    told = F.sha2(F.concat(F.length("r").cast("string"), F.lit(":"), F.col("r"), F.col("x")).cast("binary"), 256)
    return spread.select("*", F.monotonically_increasing_id().alias("pos"), kind.alias("kind"), (ending == "").alias("blank"), (~ending.isin("", ".", "!", "?")).alias("cut"), F.unhex(told).alias("said"))


def _blocks(placed: DataFrame, block: int) -> DataFrame:
    """(c, part, nth, first, last, signature, blank, duplicate, truncated) of each block."""
    narrow = placed.select("c", "pos", "kind", "blank", "cut", "said")
    seen = narrow.groupBy("c", "said").agg(F.min("pos").alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("c").alias("c2"), F.col("said").alias("said2"), "earliest")
    met = narrow.join(seen, F.col("c").eqNullSafe(F.col("c2")) & (F.col("said") == F.col("said2")), "left")
    again = ~F.col("blank") & F.coalesce(F.col("pos") > F.col("earliest"), F.lit(False))
    cut = F.col("cut") & ~again
    letters = F.when(F.col("blank") | again, "0123").when(cut, "SUAO").otherwise("suao")
    rows = met.select("c", F.shiftright("pos", 33).alias("part"), "pos", "blank", again.alias("again"), cut.alias("cut"), F.substring(letters, F.col("kind") + 1, F.lit(1)).alias("mark"))
    at = F.row_number().over(Window.partitionBy("c", "part").orderBy("pos")) - 1
    gone = lambda name: F.sum(F.col(name).cast("long"))
    return (
        rows.withColumn("nth", F.floor(at / block).cast("int"))
        .groupBy("c", "part", "nth")
        .agg(
            F.min("pos").alias("first"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mark"))), lambda s: s["mark"]), "").alias("signature"),  # of `block` turns at most
            gone("blank").alias("blank"),
            gone("again").alias("duplicate"),
            gone("cut").alias("truncated"),
        )
    )


def _solved(blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """blocks with audit, cost and steps."""
    one = Window.partitionBy("c")
    told = blocks.withColumn("blocks", F.count(F.lit(1)).over(one))
    single = told.where("blocks = 1").withColumn("after", F.array(*map(F.lit, END))).withColumn("state", F.lit(0)).withColumn("final", F.lit(True))
    asked = scratch.keep(single.drop("blocks").unionByName(_chained(told.where("blocks > 1").drop("blocks"), scratch)))
    key = ["signature", "after", "state", "final"]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for signature, after, state, final in zip(f["signature"], f["after"], f["state"], f["final"], strict=True):
                cost, end, steps = solve(signature, tuple(int(x) for x in after), int(state))
                tail = TAIL[end] if final else ""
                audit = "".join("I" * len(before) + edit for before, edit, _ in steps) + "I" * len(tail)
                out.append((cost + 2 * len(tail), audit, [{"before": b, "edit": e, "role": r} for b, e, r in steps], tail))
            yield pd.concat([f.reset_index(drop=True), pd.DataFrame(out, columns=["cost", "audit", "steps", "tail"])], axis=1)

    # signatures that many conversations share are solved once
    found = asked.select(*key).distinct().mapInPandas(work, "signature string, after array<int>, state int, final boolean, cost long, audit string, steps array<struct<before: string, edit: string, role: string>>, tail string")
    return asked.join(found, key)


def _chained(blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """Blocks of conversations of several, with the cost to go after each and the state before it.
    Only tables of 16 and 4 numbers for each block meet in a conversation's task."""

    def tables(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(costs=[[x for row in through(s) for x in row] for s in f["signature"]])

    def backward(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["part", "nth"], kind="stable")
        after, out = END, []
        for costs in reversed(f["costs"].tolist()):
            out.append(list(after))
            after = [min(int(costs[4 * s + e]) + after[e] for e in STATES) for s in STATES]
            after = [a - min(after) for a in after]
        return f[["c", "part", "nth"]].assign(after=out[::-1], final=[False] * (len(f) - 1) + [True])

    def ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(ends=[[solve(s, tuple(int(x) for x in a), q)[1] for q in STATES] for s, a in zip(f["signature"], f["after"], strict=True)])

    def forward(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["part", "nth"], kind="stable")
        state, out = 0, []
        for each in f["ends"]:
            out.append(state)
            state = int(each[state])
        return f[["c", "part", "nth"]].assign(state=out)

    kind = blocks.schema["c"].dataType.simpleString()
    place = lambda a, b: F.col(f"{a}.c").eqNullSafe(F.col(f"{b}.c")) & (F.col(f"{a}.part") == F.col(f"{b}.part")) & (F.col(f"{a}.nth") == F.col(f"{b}.nth"))
    costs = blocks.select("signature").distinct().mapInPandas(tables, "signature string, costs array<long>")
    rest = blocks.join(costs, "signature").select("c", "part", "nth", "costs").groupBy("c").applyInPandas(backward, f"c {kind}, part long, nth int, after array<int>, final boolean")
    told = scratch.keep(blocks.alias("b").join(rest.alias("r"), place("b", "r")).select("b.*", "r.after", "r.final"))
    over = told.select("signature", "after").distinct().mapInPandas(ends, "signature string, after array<int>, ends array<int>")
    states = told.join(over, ["signature", "after"]).select("c", "part", "nth", "ends").groupBy("c").applyInPandas(forward, f"c {kind}, part long, nth int, state int")
    return told.alias("b").join(states.alias("r"), place("b", "r")).select("b.*", "r.state")


def _audits(placed: DataFrame, solved: DataFrame) -> DataFrame:
    """(c, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation."""
    exact = "decimal(20,0)"
    least, most = F.min("t").cast(exact), F.max("t").cast(exact)
    gaps = F.coalesce(most - least + 1 - F.count_distinct("t"), F.lit(0)).cast("long")
    turns = placed.groupBy("c").agg(gaps.alias("gaps"))
    roles = F.translate("signature", "SUAO0123", "suaosuao")
    inside = F.length("signature") - 1 - F.regexp_count(roles, F.lit("(?=su|ua|au)"))
    border = F.concat(F.lag(F.right(roles, F.lit(1))).over(Window.partitionBy("c").orderBy("part", "nth")), F.substring(roles, 1, 1))
    rows = solved.withColumn("illegal", inside + F.when(border.isNull() | border.isin("su", "ua", "au"), 0).otherwise(1))
    sums = [F.sum(n).cast("long").alias(n) for n in ("blank", "duplicate", "truncated", "illegal", "cost")]
    pieces = F.array_sort(F.collect_list(F.struct("part", "nth", "audit")))  # a conversation's audit is one text
    found = rows.groupBy(F.col("c").alias("c2")).agg(*sums, F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit"))
    return turns.join(found, F.col("c").eqNullSafe(F.col("c2"))).drop("c2")


def _replayed(placed: DataFrame, solved: DataFrame) -> DataFrame:
    """(c, pos, k, turn, role, text, edit): the turns after the edits; inserted ones have no turn."""
    each = solved.select("first", F.size("steps").alias("n"), "tail", F.posexplode("steps").alias("i", "step"))
    steps = each.select((F.col("first") + F.col("i")).alias("pos"), "step.*", F.when(F.col("i") == F.col("n") - 1, F.col("tail")).otherwise("").alias("tail"))
    steps = steps.where("edit <> 'D' OR before <> '' OR tail <> ''")
    role = lambda one: F.when(one == "u", "user").otherwise("assistant")
    none = F.lit(None)
    turn = lambda t, r, x, e: F.struct(t.cast("long").alias("turn"), r.alias("role"), x.alias("text"), F.lit(e).alias("edit") if isinstance(e, str) else e.alias("edit"))
    # split('') gives one empty text, which is no role
    added = lambda roles: F.transform(F.filter(F.split(roles, ""), lambda c: c != ""), lambda c: turn(none, role(c), F.lit(""), "I"))
    own = turn(F.col("t"), F.when(F.col("edit") == "R", role(F.col("role"))).otherwise(F.col("r")), F.col("x"), F.col("edit"))
    kept = F.filter(F.array(own), lambda _: F.col("edit") != "D")
    rows = placed.select("c", "pos", "t", "r", "x").join(steps, "pos")
    return rows.select("c", "pos", F.posexplode(F.concat(added(F.col("before")), kept, added(F.col("tail")))).alias("k", "one")).select("c", "pos", "k", "one.*")


def conversation_digests(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """SHA-256 of the `role:text` lines of each conversation, hashed as they stream by in order."""
    kind = turns.schema[conv_col].dataType.simpleString()
    lines = turns.select(F.col(f"`{conv_col}`").alias("c"), "pos", "k", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None
        for batch in batches:
            keys, hashes = [], []
            for c, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if running is None or c != key:
                    if running is not None:
                        keys.append(key)
                        hashes.append(running.hexdigest())
                    key, running = c, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(line.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.types[0]), pa.array(hashes, pa.string())], ["c", "digest"])
        if running is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], batch.schema.types[0]), pa.array([running.hexdigest()], pa.string())], ["c", "digest"])

    ordered = lines.repartition("c").sortWithinPartitions("c", "pos", "k").select("c", "line")
    return ordered.mapInArrow(work, f"c {kind}, digest string").withColumnRenamed("c", conv_col)


def damaged(turns: DataFrame) -> DataFrame:
    """conversations with the faults that the crc32 of `conv_id:turn` calls for: a remainder by 20
    of 0 drops a turn, 1 empties its text, 2 removes its ends of sentences, 3 repeats it, 4 makes
    its role user. Nulls count as one space."""
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    rows = turns.where(h != 0).select("conv_id", "turn", F.when(h == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(h == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def repair_digests(turns: DataFrame) -> DataFrame:
    """The audit of every conversation of turns after `damaged`, and the digest of its repair."""
    found = repair_conversations(damaged(turns))
    zeros = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    audits = found.audits.withColumnRenamed("conv_id", "c1")
    hashes = conversation_digests(found.turns).withColumnRenamed("conv_id", "c2")
    every = turns.select("conv_id").distinct()
    met = every.join(audits, F.col("conv_id").eqNullSafe(F.col("c1")), "left").join(hashes, F.col("conv_id").eqNullSafe(F.col("c2")), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return met.select("conv_id", *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in zeros], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.lit(empty)).alias("repaired_sha256"))
