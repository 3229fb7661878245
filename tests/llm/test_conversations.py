"""Conversation repair against a search over all edits, one insertion or more anywhere."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from helixbin.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, place long, block string, kind int, audit string, out string"
BLANK = " \t\n\v\f\r"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "b", 2, "a", "o") for r in rows], SCHEMA).repartition(parts)


def cheapest(turns):
    """(cost, audit, lines) of the cheapest edits: shortest path over (turns read, state), insertions being steps of their own."""
    follows = {("n", "s"): "s", ("n", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    heap, done = [(0, "", 0, "n", ())], {}
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if done.setdefault((i, state), (cost, audit)) != (cost, audit):
            continue
        if i == len(turns) and state in "na":
            return cost, audit, lines
        steps = [(5, "I", i, to, f"{name}:") for to, name in (("u", "user"), ("a", "assistant"))]
        if i < len(turns):
            role, text, fault = turns[i]
            steps.append((2, "D", i + 1, None, None))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                steps.append((more, "K", i + 1, role[:1], f"{role}:{text}"))
                steps += [(1 + more, "R", i + 1, to, f"{name}:{text}") for to, name in (("u", "user"), ("a", "assistant"))]
        for c, letter, j, to, line in steps:
            if to is None:
                heapq.heappush(heap, (cost + c, audit + letter, j, state, lines))
            elif (state, to) in follows:
                heapq.heappush(heap, (cost + c, audit + letter, j, follows[state, to], (*lines, line)))
    raise AssertionError


def brute(rows):
    said = lambda x: " " if x is None else str(x)
    out = {}
    for conv in {r[0] for r in rows}:
        damaged = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text, kind = said(role), said(text), zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            damaged += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, turns, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in damaged:
            rest = text.strip(BLANK)
            fault = "blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else None
            seen.add((role, text))
            turns.append((role, text, fault))
            if fault:
                count[fault] += 1
        numbers = [t for t, *_ in damaged if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, lines = cheapest(turns)
        out[conv] = (conv, gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = list(map(tuple, df.select(*names).collect()))
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r for r in rows}


@pytest.mark.parametrize("block", [2, 256])
def test_against_all_edits(spark, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    rng = random.Random(9)
    rows = []
    texts = ["Yes.", "No!", "cut off", " ", "", None, "é ü. \n", "Two.\nlines", "　", "word" * 3000 + "."]
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(9)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "", "tool", "User", "uncle", None, "system"])
            text = rng.choice(texts) if rng.random() < 0.5 else f"Turn {turn} of {conv}" + rng.choice([".", "", "! "])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), role, text))
    assert got(conversations.judged(table(spark, rows))) == brute(rows)


def test_one_conversation_holds_most_rows(spark):
    rng = random.Random(5)
    hot = [(1, t // 3, rng.choice(["user", "assistant", "system"]), rng.choice(["Same.", f"Turn {t}.", f"cut {t}"])) for t in range(900)]
    rows = hot + [(2 + t // 2, t % 2, ("user", "assistant")[t % 2], f"Fine {t}.") for t in range(300)]
    assert got(conversations.judged(table(spark, rows))) == brute(rows)


def test_repaired_turns(spark):
    rows = [(7, t, r, x) for t, (r, x) in enumerate([("system", "Be brief."), ("assistant", "Hello."), ("user", "Why?"), ("assistant", "So."), ("user", "Why?"), ("assistant", "Bye.")])]
    turns = sorted(conversations.repaired(table(spark, rows)).collect(), key=lambda r: (r.block, r.place))
    want = brute(rows)[7]
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in turns).encode()).hexdigest() == want[-1]
    assert "".join(r.edit for r in turns) == want[-2].replace("D", "")


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(3, 4, "user", "Yes.")]])
def test_few_rows(spark, rows):
    assert got(conversations.judged(table(spark, rows, 1))) == brute(rows)


def test_every_turn_dropped(spark):
    conv, turn = next((c, t) for c in range(50) for t in range(50) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    rows = [(conv, turn, "user", "Yes.")]
    assert got(conversations.judged(table(spark, rows, 1))) == brute(rows) == {conv: (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
