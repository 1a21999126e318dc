"""Conversation repair against exhaustive search, and against Dijkstra with labels for longer ones."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from musterline.llm import conversations as C
from musterline.llm.auction import auction, cheapest
from tests.llm import odd

STEPS = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]


def best(rows):
    """(cost, audit) of rows of (initial, fault), by least cost, then least initials."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if (i, q, "end") in done:
            return cost, audit
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(rows) and q in (0, 3):
            return cost, audit
        for said in ("u", "a"):
            if said in STEPS[q]:
                heapq.heappush(heap, (cost + 5, audit + "I", i, STEPS[q][said]))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, q))
            if fault in (C.FINE, C.CUT_OFF):
                more = 5 if fault == C.CUT_OFF else 0
                if initial in STEPS[q]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, STEPS[q][initial]))
                for said in ("u", "a"):
                    if said in STEPS[q]:
                        heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, STEPS[q][said]))
    raise AssertionError


def some_rows(rand, n):
    return [(rand.choice("suuuaaat") if rand.random() < 0.9 else "", rand.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_cheapest_and_least(seed, monkeypatch):
    rand = random.Random(seed)
    for _ in range(250):
        rows = some_rows(rand, rand.randrange(14))
        assert C.solve(rows) == best(rows), rows


@pytest.mark.parametrize("block", [1, 2, 3, 64])
def test_blocks_give_the_same(block, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", block)
    rand = random.Random(block)
    for n in (1, 2, 3, 7, 30, 150, 400):
        rows = some_rows(rand, n)
        assert C.solve(rows) == best(rows)
        cut = rand.randrange(1, n + 1)
        pieces = [C.between(x) for x in (rows[:cut], rows[cut:]) if x]
        assert C._whole(pieces) == best(rows)


def test_prices_stay_feasible_and_a_dead_end_is_told():
    arcs = [[(3, "x", 1), (1, "y", 2)], [(1, "x", 3)], [(4, "y", 3)], []]
    price = [0.0] * 4
    assert auction(arcs, price, 0, 3) and price[0] == 4
    assert all(price[i] <= c + price[j] for i, out in enumerate(arcs) for c, _, j in out)
    assert cheapest(arcs, [0.0] * 4, 0, 3) == (4, "xx")
    assert cheapest([[], []], [0.0, 0.0], 0, 1) is None


# Whole tables


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (conv, turn, "user" if kind == 4 else role, text)
        out += [row, row] if kind == 3 else [row]
    return out


def wanted(original, rows):
    out = {}
    for conv in {r[0] for r in original}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in own if r[1] is not None]
        seen, faults = set(), []
        for _, _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append(C.BLANK if not bare.strip(" \t\n\x0b\x0c\r") else C.DUPLICATE if (role, text) in seen else C.CUT_OFF if bare[-1] not in ".!?" else C.FINE)
            seen.add((role, text))
        initials = [r[2][:1] for r in own]
        cost, audit = best(list(zip(initials, faults)))
        lines, q, i = [], 0, 0
        for edit in audit:
            target = "a" if q == 2 else "u"
            if edit == "I":
                lines.append({"u": "user:", "a": "assistant:"}[target])
            else:
                _, _, role, text = own[i]
                i += 1
                if edit == "D":
                    continue
                target = role[:1] if edit == "K" else target
                lines.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[target]}:{text}")
            q = STEPS[q][target]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(C.BLANK), faults.count(C.DUPLICATE), faults.count(C.CUT_OFF),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def some_conversations():
    rand, out = random.Random(3), []
    for conv in [*range(60), None, -4]:
        for turn in range(rand.randrange(12)):
            text = rand.choice(["Hello there.", "hello", "What?", " \n", "", None, "Yes!", "No", "é. \t", "x" * 50 + "."])
            out.append((conv, rand.choice([turn, turn, turn, turn, 2 * turn, None]), rand.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"]), text))
    out += out[:20]  # repeated rows
    return out


def frame(spark, rows, parts=4):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)


def found(repaired):
    totals = {r["conv_id"]: tuple(r)[1:] for r in repaired.totals.collect()}
    return {r["conv_id"]: (*totals[r["conv_id"]], r["repaired_sha256"]) for r in repaired.digests().collect()}


def test_damage_and_repair_equal_search(spark):
    rows = some_conversations()
    given = odd.clashing(frame(spark, rows))
    assert found(C.repair(C.damage(given), given)) == wanted(rows, damaged(rows))


def test_a_conversation_over_many_partitions(spark):
    """One conversation holds nearly all rows; it is laid out over all partitions and solved in pieces."""
    rand = random.Random(8)
    rows = [(1, i // 2 if i % 7 else None, rand.choice(["user", "assistant", "system"]), rand.choice([f"Text {i % 40}.", "cut", "", f"Other {i}!"])) for i in range(3000)]
    rows += [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho."), (3, None, "system", "S.")]
    repaired = C.repair(frame(spark, rows, 6))
    assert found(repaired) == wanted(rows, rows)
    lines = [f"{r['role']}:{r['text']}" for r in sorted((r for r in repaired.rows().collect() if r["conv_id"] == 1), key=lambda r: r["place"])]
    assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == found(repaired)[1][-1]


def test_dropped_conversations_and_no_rows(spark):
    given = frame(spark, [(5, 1, "user", "a.")])
    nothing = found(C.repair(given.where("false"), given))
    assert nothing == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert found(C.repair(given.where("false"))) == {}


def test_editor_follows_the_pattern():
    rand = random.Random(1)
    for _ in range(300):
        rows = some_rows(rand, rand.randrange(10))
        editor, said = C.Editor(C.solve(rows)[1]), ""
        for initial, _ in rows:
            said += "".join(r[0] for r in editor.inserted())
            said += (editor.row({"s": "system", "u": "user", "a": "assistant", "t": "tool", "": ""}[initial]) or "")[:1]
        said += "".join(r[0] for r in editor.inserted())
        assert re.fullmatch("(s?(ua)+)?", said)
