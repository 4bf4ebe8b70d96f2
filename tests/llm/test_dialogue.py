"""Conversation repair against brute force over all edit scripts."""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import dialogue as D

SPACE = " \t\n\x0b\f\r"


def cheapest(rows):
    """Least (cost, letters) over all scripts, by search over prefixes: rows are (role, text, must go, unfinished)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, i, roles, lines = heapq.heappop(heap)
        state = roles if len(roles) < 2 else roles[0] * (roles[0] == "s") + "ua" * (len(roles) > 2) + roles[-2:]
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, letters, "\n".join(lines)
        # The state of the pattern follows from the last initial and whether anything stands before.
        if (i, roles[-1:], bool(roles)) in done:
            continue
        done.add((i, roles[-1:], bool(roles)))
        del state
        ways = [("I", 5, r, "", i) for r in ("user", "assistant")]
        if i < len(rows):
            role, text, doomed, unfinished = rows[i]
            ways.append(("D", 2, None, None, i + 1))
            if not doomed:
                ways.append(("K", 5 * unfinished, role, text, i + 1))
                ways += [("R", 1 + 5 * unfinished, r, text, i + 1) for r in ("user", "assistant")]
        for letter, more, role, text, j in ways:
            new = roles if role is None else roles + (role[:1] or "?")
            if not re.fullmatch("s?(ua)*u?", new):
                continue
            heapq.heappush(heap, (cost + more, letters + letter, j, new, lines if role is None else (*lines, f"{role}:{text}")))


def brute(rows):
    """The report of one conversation: rows are (turn, role, text)."""
    rows = sorted(((t is not None, t or 0, r, x), t) for t, r, x in ((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows))
    turns = {t for _, t in rows if t is not None}
    seen, marked, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for (_, _, role, text), _ in rows:
        strip = text.strip(SPACE)
        fault = "blank" if not strip else "duplicate" if (role, text) in seen else "truncated" if strip[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
    cost, letters, lines = cheapest(marked)
    return {"gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **counts, "illegal": illegal, "cost": cost, "audit": letters, "repaired_sha256": hashlib.sha256(lines.encode()).hexdigest()}


def least_script(codes):
    """Edits of one conversation through blocks of three rows."""
    parts = [codes[i : i + 3] for i in range(0, len(codes), 3)]
    matrices, costs, entering = [D.block_matrix(p) for p in parts], [0, D.FAR, D.FAR, D.FAR], []
    for m in matrices:
        entering.append(costs)
        costs = [min(costs[a] + int(m[a][b]) for a in D.STATES) for b in D.STATES]
    leaving, costs = [], D.ENDING
    for m in reversed(matrices):
        leaving.append(costs)
        costs = [min(int(m[a][b]) + costs[b] for b in D.STATES) for a in D.STATES]
    leaving.reverse()
    state, letters, total = D.START, "", 0
    for i, p in enumerate(parts):
        path = D.traverse(p, entering[i], leaving[i], i == len(parts) - 1)[state]
        letters, total, state = letters + path.letters, total + path.cost, path.state
    return total, letters


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(D.LETTERS), min_size=1, max_size=9))
def test_least_script(codes):
    roles = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    rows = [(roles[k], "t", f == D.DOOMED, f == D.OPEN) for k, f in (D.CODES[ord(c) - ord("a")] for c in codes)]
    cost, letters, _ = cheapest(rows)
    assert least_script("".join(codes)) == (cost, letters)
    whole = D.traverse("".join(codes), [0, D.FAR, D.FAR, D.FAR], D.ENDING, True)[D.START]
    assert (whole.cost, whole.letters) == (cost, letters)


def damaged(rows):
    out, ids = defaultdict(list), set()
    for conv, turn, role, text in rows:
        ids.add(conv)
        role, text = " " if role is None else role, " " if text is None else text
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if way == 0:
            continue
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        role = "user" if way == 4 else role
        out[conv] += [(turn, role, text)] * (2 if way == 3 else 1)
    return out, ids


def expect(rows):
    of, ids = damaged(rows)
    nothing = {**dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0), "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return {k: brute(of[k]) if of[k] else nothing for k in ids}


def test_query(spark, sf_dir, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in D.op12_conversation_repair(spark, sf_dir).collect()}
    assert got == expect(rows) and sum(v["cost"] > 0 for v in got.values()) > len(got) // 4
    odd = [(1, 0, "user", None), (1, 1, "assistant", ""), (None, 2, "user", "x."), (None, None, None, "y?"), (2, None, "user", "y."), (2, None, "assistant", "z"), (3, 5, "", "q!"), (3, 9, "tool", "w.\n "), (3, -2, "sys", "s."), (4, 1, "user", "a.")]
    odd += [(5, t, "user", f"line {t}.") for t in range(40)] + [(6, 7, "assistant", "same!")] * 9 + [(7, t, "system" if t % 3 else "assistant", "é" * t) for t in range(30)]
    spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in D.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == expect(odd)


@pytest.mark.parametrize("block", [1, 4, 64])
def test_long_conversations_in_blocks(spark, block):
    import random

    rng = random.Random(block)
    rows = [(k, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "no", "", f"text {t}!", f"open {t}"])) for k, n in ((1, 150), (2, 3), (3, 70)) for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    made = D.repair(df, block=block)
    got = {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in D.report(df, made, "conv_id").collect()}
    of = defaultdict(list)
    for k, *row in rows:
        of[k].append(tuple(row))
    assert got == {k: brute(v) for k, v in of.items()}
    kept = defaultdict(str)
    for r in sorted(made.rows.collect(), key=lambda r: (r.conv, r.block, r.place)):
        kept[r.conv] += r.role[0]
    assert all(re.fullmatch("(s?(ua)+)?", v) for v in kept.values())
