"""Repairs against a search over all edit sequences; damage, faults and digests against plain Python."""

import random
import zlib
from functools import lru_cache

from pairlab.llm import catalog, conversation_repair as CR
from tests.llm import helpers as H


def plain_best(codes):
    """(cost, edits) of the cheapest and then ASCII-least edits: all sequences, by recursion."""
    @lru_cache(maxsize=None)
    def go(i, state):
        found = []
        if i == len(codes):
            if state in (0, 3):
                found.append((0, ""))
        else:
            c = codes[i]
            cost, rest = go_with_inserts(i + 1, state)
            found.append((cost + 2, "D" + rest))
            if c:
                extra = 5 * ((c - 1) & 1)
                k = CR.KEEP[(c - 1) >> 1][state]
                if k >= 0:
                    cost, rest = go_with_inserts(i + 1, k)
                    found.append((cost + extra, "K" + rest))
                cost, rest = go_with_inserts(i + 1, CR.NEXT[state])
                found.append((cost + extra + 1, "R" + rest))
        return min(found, default=(10**9, ""))

    @lru_cache(maxsize=None)
    def go_with_inserts(i, state):
        found, s = [], state
        for n in range(4):
            cost, rest = go(i, s)
            found.append((cost + 5 * n, "I" * n + rest))
            s = CR.NEXT[s]
        return min(found)

    return go_with_inserts(0, 0)


def test_walk_is_cheapest_and_ascii_least():
    rnd = random.Random(3)
    for n in list(range(9)) * 30 + [40, 90]:
        codes = bytes(rnd.choice([0, 1, 2, 3, 3, 4, 5, 5, 6, 7, 8]) for _ in range(n))
        cost, edits = plain_best(codes)
        assert CR.walk(codes, CR.FINAL, (0,), True)[0][0] == edits
        total, vector = CR._back(codes, CR.FINAL)
        assert total + vector[0] == cost


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(ch for ch in text if ch not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_report(rows):
    """rows of one conversation in order -> the contract's columns."""
    spaces, seen, codes, n = " \t\n\x0b\x0c\r", set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, _, role, text in rows:
        shown = text.rstrip(spaces)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            n[fault] += 1
        codes.append(0 if fault in ("blank", "duplicate") else 1 + 2 * "sua".find(role[:1]) + (fault == "truncated")
                     if role[:1] and role[0] in "sua" else 0 if fault in ("blank", "duplicate") else 7 + (fault == "truncated"))
    turns = [t for _, t, _, _ in rows if t is not None]
    cost, audit = plain_best(bytes(codes))
    state, i, lines = 0, 0, []
    for e in audit:
        if e == "I":
            state = CR.NEXT[state]
            lines.append(CR.ROLE[state] + ":")
            continue
        _, _, role, text = rows[i]
        i += 1
        if e == "K":
            state = CR.KEEP["sua".index(role[0])][state]
            lines.append(f"{role}:{text}")
        elif e == "R":
            state = CR.NEXT[state]
            lines.append(f"{CR.ROLE[state]}:{text}")
    pairs = [(a[2][:1] + b[2][:1]) for a, b in zip(rows, rows[1:])]
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **n, "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
            "cost": cost, "audit": audit, "repaired_sha256": H.sha("\n".join(lines))}


def compare(spark, rows, monkeypatch=None):
    given = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, code string, segment int")
    out = H.by_id(CR.digest(given, CR.repair(CR.damaged(given))), "conv_id")
    assert set(out) == {r[0] for r in rows} and all(len(v) == 1 for v in out.values())
    by = {}
    for r in plain_damage(rows):
        by.setdefault(r[0], []).append(r)
    for conv, got in out.items():
        mine = sorted(by.get(conv, []), key=lambda r: (r[1] is not None, r[1] or 0))
        assert {k: got[0][k] for k in plain_report(mine)} == plain_report(mine), (conv, mine)
    return out


def test_awkward_conversations(spark):
    rnd, rows = random.Random(9), []
    for conv in [*range(60), None]:
        turn = 0
        for _ in range(rnd.randint(1, 14)):
            turn += rnd.choice([1, 1, 1, 2, 3])
            rows.append((conv, turn, rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", None]),
                         rnd.choice(["Yes.", "No!", "and then", " ", None, "a b.\n", "Well?\t", "x" * 50 + "."])))
    rows += [(500, None, "user", "Only."), (501, 3, "user", "a."), (501, 3, "user", "a."), (502, None, "user", "a."), (502, 2, "user", "a."),
             (503, 1, "system", "s."), (503, 2, "user", "é\U0001F600."), (503, 3, "assistant", "")]
    compare(spark, rows)


def test_conversation_over_many_segments(spark, monkeypatch):
    monkeypatch.setattr(CR, "SEGMENT", 7)
    rnd = random.Random(1)
    rows = [(c, t, ["user", "assistant", "system"][rnd.choice([0, 0, 1, 1, t % 2, t % 2, 2])], rnd.choice([f"t{t}.", f"t{t}.", "cut", "Same."]))
            for c, n in ((1, 300), (2, 40), (3, 7), (4, 8)) for t in range(n)]
    compare(spark, rows)


def test_one_row_repeated_many_times(spark):
    rows = [(8, 5, "user", "Copy me.")] * 3000 + [(8, 6, "assistant", "Fine.")]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = CR.digest(given, CR.repair(given)).collect()[0]
    assert (r["duplicate"], r["audit"]) == (2999, "K" + "D" * 2999 + "K")


def test_empty_table_and_query(spark):
    given = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert CR.digest(given, CR.repair(CR.damaged(given))).collect() == []
    sf = "/root/testdata/sf0.001"
    rows = H.rows_of(sf, "conversations", "conv_id, turn, role, text")
    got = H.by_id(catalog.QUERIES["op12_checkpointed_repair"](spark, sf), "conv_id")
    by = {}
    for r in plain_damage(rows):
        by.setdefault(r[0], []).append(r)
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        expect = plain_report(sorted(by.get(conv, []), key=lambda x: x[1]))
        assert {k: r[0][k] for k in expect} == expect
