"""Repairs against a search over all edits, and whole conversations against a plain replay."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from loghelm.llm.conversation_repair import END, TAIL, conversation_digests, damaged, repair_conversations, repair_digests, solve, through, to_go

SHAPE = "conv_id long, turn long, role string, text string, cost string, c int"
WORD = re.compile(r"[^\x20\x09-\x0D]")
LEGAL = re.compile(r"(s?(ua)+)?")


def table(spark, rows):
    """rows of (conv_id, turn, role, text), with extra columns whose names clash."""
    return spark.createDataFrame([(*r, "z", 1) for r in rows], SHAPE)


def plain_faults(rows):
    out, seen = [], set()
    for role, text in rows:
        last = WORD.findall(text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows, faults):
    """The cheapest (cost, audit, lines) by Dijkstra over (turns done, roles so far reduced)."""
    start = (0, "", 0, "", ())
    heap, done = [start], set()
    while heap:
        cost, audit, i, tail, lines = heapq.heappop(heap)
        if i == len(rows) and tail in ("", "ua"):
            return cost, audit, list(lines)
        if (i, tail) in done:
            continue
        done.add((i, tail))

        def go(more, letter, j, initial, line):
            roles = {"": "", "s": "s", "u": "u", "ua": "ua"}[tail] + initial
            now = {"": "", "s": "s", "u": "u", "su": "u", "ua": "ua", "uau": "u"}.get(roles)
            if now is not None and (not initial or LEGAL.fullmatch(roles + {"s": "ua", "u": "a", "ua": ""}.get(now, ""))):
                heapq.heappush(heap, (cost + more, audit + letter, j, now, (*lines, line) if line is not None else lines))

        for name in ("user", "assistant"):
            go(2, "I", i, name[0], name + ":")
        if i < len(rows):
            (role, text), fault = rows[i], faults[i]
            go(3, "D", i + 1, "", None)
            if fault not in ("blank", "duplicate"):
                more = 1 if fault == "truncated" else 0
                if role[:1] in ("s", "u", "a"):
                    go(more, "K", i + 1, role[0], f"{role}:{text}")
                for name in ("user", "assistant"):
                    go(2 + more, "R", i + 1, name[0], f"{name}:{text}")


def plain(rows):
    """The contract's row of each conversation, of rows after damage."""
    groups = {}
    for c, t, r, x in rows:
        groups.setdefault(c, []).append((t is not None, t or 0, " " if r is None else r, " " if x is None else x, t))
    out = {}
    for c, group in groups.items():
        group.sort(key=lambda g: g[:4])
        turns = [(g[2], g[3]) for g in group]
        faults = plain_faults(turns)
        cost, audit, lines = plain_repair(turns, faults)
        numbers = [g[4] for g in group if g[4] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        out[c] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_signatures_against_a_search():
    rng = random.Random(2)
    names = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for _ in range(600):
        signature = "".join(rng.choice("suaoSUAO0123uaua") for _ in range(rng.randrange(1, 10)))
        rows = [(names["suao"[int(c)] if c.isdigit() else c.lower()], "") for c in signature]
        faults = ["blank" if c.isdigit() else "truncated" if c.isupper() else "" for c in signature]
        cost, end, steps = solve(signature, END, 0)
        audit = "".join("I" * len(b) + e for b, e, _ in steps) + "I" * len(TAIL[end])
        assert (cost + 2 * len(TAIL[end]), audit) == plain_repair(rows, faults)[:2]
        assert min(through(signature)[0][e] + END[e] for e in range(4)) == cost + 2 * len(TAIL[end])


def test_a_long_signature_is_solved_without_deep_recursion():
    signature = "sua" + "uA0" * 30_000
    cost, _, steps = solve(signature, END, 0)
    assert len(steps) == len(signature) and cost == 30_000 * 4 and to_go(signature, END)[0] >= 0


def some_rows(rng, n):
    texts = ["Yes.", "No!", "why?", "cut off", "", "  \t", "Fine. ", "\x1c", "é.", None]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]
    return [(rng.randrange(n), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}.") for _ in range(6 * n)]


@pytest.mark.parametrize("block", [4096, 2])
def test_repairs_of_awkward_tables(spark, block):
    rng = random.Random(block)
    rows = [*some_rows(rng, 25), (None, 1, "user", "a."), (None, 1, "user", "a."), (None, None, None, None), (90, None, "user", ""), (91, None, "user", "x" * 300_000 + ".")]
    rows += [(92, 1, "user", "same.")] * 40
    rows += [(93, i, rng.choice(["user", "assistant"]), rng.choice(["a.", "b", f"{i}.", f"{i}"])) for i in range(60)]
    found = repair_conversations(table(spark, rows), block=block)
    hashes = {r.conv_id: r.digest for r in conversation_digests(found.turns).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, hashes.get(r.conv_id, empty)) for r in found.audits.collect()}
    assert got == plain(rows)
    kept = {}
    for r in found.turns.orderBy("pos", "k").collect():
        kept.setdefault(r.conv_id, []).append(r.role[0])
        assert (r.edit == "I") == (r.turn is None and r.text == "") or r.turn is None
    assert all(LEGAL.fullmatch("".join(v)) for v in kept.values())


def test_whole_query_on_damaged_turns(spark):
    rng = random.Random(8)
    rows = some_rows(rng, 40) + [(None, None, "user", "A. B? C!")] * 3 + [(200, t, "user", f"{t}") for t in range(30)]
    after = []
    for c, t, r, x in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = {1: "", 2: re.sub("[.!?]", "", x)}.get(h, x)
        after += [(c, t, "user" if h == 4 else r, x)] * {0: 0, 3: 2}.get(h, 1)
    key = lambda r: (str(r[0]), str(r[1]), r[2], r[3])
    assert sorted(map(tuple, damaged(table(spark, rows)).collect()), key=key) == sorted(after, key=key)
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    want = plain(after) | {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    got = {r[0]: tuple(r[1:]) for r in repair_digests(table(spark, [*rows, (dropped, 1, "user", "x.")])).collect()}
    assert {c: want.get(c, want[dropped]) for c in got} == got and set(want) <= set(got)
    nothing = table(spark, [])
    assert repair_digests(nothing).collect() == [] and repair_conversations(nothing).turns.collect() == []
    none_left = repair_digests(table(spark, [(dropped, 1, "user", "x.")])).collect()
    assert [tuple(r) for r in none_left] == [(dropped, *want[dropped])]
    assert dict(repair_digests(table(spark, rows)).dtypes)["audit"] == "string"
