"""Conversation repair against all repairs tried out."""

import hashlib
import itertools
import re
from functools import lru_cache

import numpy as np
import pytest

from seqlattice.llm import turns

PATTERN = re.compile(r"(s?(ua)+)?\Z")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def all_repairs(rows):
    """``cost, audit, lines`` of the best repair, from every string of edits with at most two inserts before each row."""
    marks, best = faults(rows), None
    for leads in itertools.product(("", "u", "a", "ua", "au"), repeat=len(rows) + 1):
        for edits in itertools.product("KRrD", repeat=len(rows)):
            cost, audit, lines = 0, "", []
            for k, lead in enumerate(leads):
                cost += 2 * len(lead)
                audit += "I" * len(lead)
                lines += [({"u": "user", "a": "assistant"}[x], "") for x in lead]
                if k == len(rows):
                    break
                (role, text), edit, mark = rows[k], edits[k], marks[k]
                audit += edit.upper()
                if edit == "D":
                    cost += 3
                    continue
                if mark in ("blank", "duplicate"):
                    cost = 10**9
                cost += (mark == "truncated") + 2 * (edit != "K")
                lines.append((role if edit == "K" else "user" if edit == "R" else "assistant", text))
            if cost < 10**9 and all(r for r, _ in lines) and PATTERN.match("".join(r[0] for r, _ in lines)):
                best = min(best, (cost, audit, lines)) if best else (cost, audit, lines)
    return best


@lru_cache(maxsize=None)
def _moves(state, initial, forced, cut):
    """Plain edges of the graph: letter, cost, next state, role of the turn that results (None: the row goes)."""
    turn = {"": ("u", "user"), "s": ("u", "user"), "u": ("a", "assistant"), "a": ("u", "user")}[state]
    out = [("D", 3, state, None)]
    if not forced:
        out.append(("R", 2 + cut, *turn))
        if (initial == "s" and state == "") or (initial == "u" and state != "u") or (initial == "a" and state == "u"):
            out.append(("K", cut, initial, "as it is"))
    return out


def by_strings(rows):
    """The same by comparing whole strings, for longer conversations."""
    marks = faults(rows)
    after = {"": (0, ""), "a": (0, ""), "u": (2, "I"), "s": (4, "II")}
    for (role, _), mark in reversed(list(zip(rows, marks))):
        plain = {}
        for state in ("", "s", "u", "a"):
            ways = []
            for letter, cost, to, _ in _moves(state, role[:1], mark in ("blank", "duplicate"), mark == "truncated"):
                ways.append((cost + after[to][0], letter + after[to][1]))
            plain[state] = min(ways)
        nxt = {"": "u", "s": "u", "u": "a", "a": "u"}
        after = {s: min(plain[s], (2 + plain[nxt[s]][0], "I" + plain[nxt[s]][1]), (4 + plain[nxt[nxt[s]]][0], "II" + plain[nxt[nxt[s]]][1])) for s in plain}
    return after[""]


def codes(rows):
    return "".join(turns.code(r[:1], m in ("blank", "duplicate"), m == "truncated") for (r, _), m in zip(rows, faults(rows))) + turns.END


def test_solver_finds_the_best_of_all_repairs():
    pool = [("system", "s."), ("user", "u."), ("user", "open"), ("assistant", "a."), ("assistant", " "), ("tool", "t."), ("", "none.")]
    for n in (0, 1, 2):
        for rows in itertools.product(pool, repeat=n):
            cost, audit, lines = all_repairs(rows)
            got, _, letters = turns.solve(codes(rows), (0,) * 4, turns.START)
            assert (got, "".join(letters)) == (cost, audit) == by_strings(rows)
            leads, names = turns.walk(codes(rows), letters, turns.START)
            built = []
            for k, (lead, name) in enumerate(zip(leads, names)):
                built += [({"u": "user", "a": "assistant"}[x], "") for x in lead]
                if name:
                    built.append((rows[k][0] if name == "k" else {"u": "user", "a": "assistant"}[name], rows[k][1]))
            assert built == lines


def test_solver_on_three_rows_and_long_conversations():
    rng = np.random.default_rng(1)
    pool = [("system", "s."), ("user", "u."), ("user", "open"), ("assistant", "a."), ("assistant", "b."), ("assistant", ""), ("tool", "t")]
    for _ in range(12):
        rows = [pool[k] for k in rng.integers(0, len(pool), 3)]
        assert by_strings(rows) == all_repairs(rows)[:2]
    for n in (5, 17, 90):
        for _ in range(30):
            rows = [(r, f"{t}{k}.") if t and k % 3 else (r, t) for k, (r, t) in enumerate(pool[j] for j in rng.integers(0, len(pool), n))]
            got, _, letters = turns.solve(codes(rows), (0,) * 4, turns.START)
            assert (got, "".join(letters)) == by_strings(rows)


def conversations(seed, n):
    rng = np.random.default_rng(seed)
    roles = ["system", "user", "assistant", "assistant", "user", "tool", "", None]
    body = ["Fine.", "open end", "", " \n", None, "Ends! \t", "say, what?", "x"]
    rows = []
    for conv in [None, *range(n)]:
        for _ in range(int(rng.integers(0, 7))):
            turn = int(rng.integers(0, 6))
            rows.append((conv, None if turn == 5 else turn, roles[int(rng.integers(0, 8))], body[int(rng.integers(0, 8))]))
    for k in range(41):
        rows.append((1000, k, ["user", "assistant"][int(rng.integers(0, 2))], body[int(rng.integers(0, 8))] if k % 4 else f"text {k}."))
    rows += [(1001, 3, "user", "The same.")] * 25
    return rows


def expected(rows):
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(" " if conv is None else str(conv), []).append((turn is not None, turn or 0, " " if role is None else role, hashlib.sha256((" " if text is None else text).encode()).hexdigest(), " " if text is None else text))
    out = {}
    for conv, found in groups.items():
        found = [(t, r, x) if known else (None, r, x) for known, t, r, _, x in sorted(found)]
        plain = [(r, x) for _, r, x in found]
        marks = faults(plain)
        known = [t for t, _, _ in found if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:]))
        cost, audit = by_strings(plain)
        out[conv] = (gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, audit)
    return out


@pytest.mark.parametrize("block,fan", [(256, 256), (4, 2), (3, 5), (1, 3)])
def test_tables_with_conversations_in_one_or_many_blocks(spark, monkeypatch, block, fan):
    monkeypatch.setattr(turns, "BLOCK", block)
    monkeypatch.setattr(turns, "FAN", fan)
    rows = conversations(2, 25)
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, conv int, `items.pos` string").repartition(5)
    fixed = turns.repair(table)
    got = {r["conv"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"]) for r in fixed.counts.join(fixed.audits, "conv").collect()}
    assert got == expected(rows)
    lines = {}
    for r in fixed.turns.orderBy("conv", "pos", "sub").collect():
        lines.setdefault(r["conv"], []).append((r["role"], r["text"]))
    for conv, found in lines.items():
        assert PATTERN.match("".join(r[0] for r, _ in found)), conv
    hashes = {r["conv"]: r["repaired_sha256"] for r in turns.text_hashes(fixed.turns).collect()}
    assert hashes == {c: hashlib.sha256("\n".join(f"{r}:{t}" for r, t in v).encode()).hexdigest() for c, v in lines.items()}
    assert lines["1000"][0][0] == "user" and len(lines["1001"]) == 2


def test_damage(spark):
    rows = [(k // 5, k % 5, "assistant", "One. Two!") for k in range(400)] + [(None, 1, None, None), (1, None, "user", "Hm.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    import zlib

    want = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            one = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            want += [one] * (2 if kind == 3 else 1)
    assert sorted(map(str, map(tuple, turns.damaged(table).collect()))) == sorted(map(str, want))


def test_no_rows(spark):
    fixed = turns.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert fixed.counts.count() == fixed.audits.count() == fixed.turns.count() == turns.text_hashes(fixed.turns).count() == 0


def test_rows_without_any_turn(spark):
    fixed = turns.repair(spark.createDataFrame([(1, None, "user", "a."), (1, None, "assistant", "b.")], "conv_id long, turn long, role string, text string"))
    assert fixed.counts.select("gaps").first()[0] == 0
    # Without turns the rows go by role, the assistant's first.
    assert tuple(fixed.audits.select("illegal", "cost", "audit").first()) == (0, *by_strings([("assistant", "b."), ("user", "a.")]))
