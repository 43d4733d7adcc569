"""Conversation repair against enumeration of all edits, and long conversations in segments against one in whole."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from biotope.llm import conversation_repair
from biotope.llm.conversation_repair import damage, in_order, lightest_repairs, repair, repair_summary, repaired_turns, solve_rows, with_faults

GRAMMAR = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, audit string, seq long"
INSERTS = ["", "u", "a", "ua", "au"]
FULL = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit, lines) by trying every edit of every row; rows are (role, text, fault)."""
    best = None
    for gaps in itertools.product(INSERTS, repeat=len(rows) + 1):
        for edits in itertools.product("KuaD", repeat=len(rows)):
            cost, audit, roles, lines = 0, "", "", []

            def insert(gap):
                nonlocal cost, audit, roles
                for c in gap:
                    cost, audit, roles = cost + 3, audit + "I", roles + c
                    lines.append(FULL[c] + ":")

            good = True
            for gap, edit, (role, text, fault) in zip(gaps, edits, rows, strict=False):
                insert(gap)
                if edit == "D":
                    cost, audit = cost + 4, audit + "D"
                    continue
                if fault in "bd":
                    good = False
                    break
                cost += (3 if fault == "t" else 0) + (0 if edit == "K" else 3)
                audit += "K" if edit == "K" else "R"
                roles += (role[:1] or "?") if edit == "K" else edit
                lines.append((role if edit == "K" else FULL[edit]) + ":" + text)
            if not good:
                continue
            insert(gaps[-1])
            if GRAMMAR.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, lines
    return best


def damaged_rows(rows):
    out = []
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        fate = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        out += [(conv, turn, role, text)] * (2 if fate == 3 else 1)
    return out


def brute(conversations, rows):
    """Result rows by conversation; rows with ties in turn must not differ."""
    out = []
    for conv in {r[0] for r in conversations}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, marked = set(), []
        for _, _, role, text in mine:
            body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            marked.append((role, text, "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "-"))
            seen.add((role, text))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts = [sum(m[2] == f for m in marked) for f in "bdt"]
        initials = [r[2][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, lines = cheapest(marked)
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)


@pytest.mark.parametrize("segment", [512, 2])
def test_against_all_edits(spark, monkeypatch, segment):
    """Random short conversations with every fault, in whole and cut into segments of at most two rows."""
    monkeypatch.setattr(conversation_repair, "SEGMENT", segment)
    draw = random.Random(5)
    rows = []
    for conv in range(60):
        for turn in range(draw.randint(1, 3)):
            role = draw.choice(["system", "user", "user", "assistant", "assistant", "tool", ""])
            rows.append((conv, draw.choice([turn, turn * 3]), role, draw.choice(["Yes.", "No!", "a b", " \t", "", "Why?  ", "x.\n"]) + (f" {turn}." if draw.random() < 0.5 else "")))
    assert rows_of(repair(frame(spark, rows))) == brute(rows, rows)


def test_damage_and_odd_rows(spark):
    """Nulls in every column, repeated rows, conversations of which nothing is left, blank and very long texts."""
    rows = [(c, t, r, x) for c in range(40) for t, (r, x) in enumerate([("user", "Hi. You!"), ("assistant", "Oh?")])]
    rows += [(None, 1, "user", "a."), (None, None, "assistant", "b."), (41, None, None, "c."), (42, 0, "user", None), (43, 0, "user", "d." * 200_000)]
    rows += [(44, 2, "user", "e."), (44, 2, "user", "e."), (45, -5, "assistant", "fé ."), (45, 9, "Assistant", " ")]
    conversations = frame(spark, rows)
    assert rows_of(damage(conversations).select("conv_id", "turn", "role", "text")) == sorted(damaged_rows(rows), key=repr)
    found = rows_of(repair_summary(conversations, damage(conversations)))
    assert found == brute(rows, damaged_rows(rows))
    assert any(r[7] == "" and r[6] == 0 and r[8] == hashlib.sha256(b"").hexdigest() for r in found)


def test_empty(spark):
    none = frame(spark, [])
    assert rows_of(repair_summary(none, damage(none))) == []
    far = [(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b.")]
    assert rows_of(repair(frame(spark, far)))[0][1] is None


def test_long_conversation(spark, monkeypatch):
    """One conversation with most rows, cut into many segments over several rounds, equals the agenda over all its rows."""
    draw = random.Random(2)
    rows = [(1, k, draw.choice(["user", "assistant", "assistant", "system"]), draw.choice([f"{k}.", f"{k}", "same.", " "])) for k in range(400)]
    rows += [(c, k, r, "t.") for c in range(2, 30) for k, r in enumerate(["user", "assistant"])]
    whole = in_order(frame(spark, rows).select("conv_id", "turn", "role", "text"))
    faulty = with_faults(whole)
    pattern = "".join(r.initial + r.fault for r in sorted((r for r in faulty.collect() if r.conv_id == 1), key=lambda r: r.seq))
    costs, audits = solve_rows(pattern)
    want = min((costs[g], audits[g]) for g in (0, 3) if costs[g] is not None)
    monkeypatch.setattr(conversation_repair, "SEGMENT", 7)
    monkeypatch.setattr(conversation_repair, "FAN", 3)
    repairs = lightest_repairs(faulty)
    got = {r.conv_id: (r.cost, r.audit) for r in repairs.collect()}
    assert got[1] == want and got[2] == (0, "KK")
    turns = sorted((r for r in repaired_turns(whole, repairs).collect() if r.conv_id == 1), key=lambda r: r.line)
    assert GRAMMAR.fullmatch("".join(r.role[0] for r in turns))
    assert "".join(r.edit for r in turns) == want[1].replace("D", "")
    assert [t.line for t in turns] == list(range(len(turns)))
