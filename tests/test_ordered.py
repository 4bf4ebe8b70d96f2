"""Serialised updates: folds in blocks against a plain fold, and hot keys."""

from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.operators import ordered
from leafmill.operators.store import compare_and_swap


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=25), st.integers(0, 6), st.integers(1, 5))
def test_blocks(named, start, block):
    state, done = start, []
    for i in range(0, len(named), block):
        part = named[i : i + block]
        made, after = ordered.swaps(state, part)
        assert ordered.after_each(part).get(state, state) == after
        done, state = done + made, after
    assert (done, state) == ordered.swaps(start, named)


def test_of_two_updates_of_one_revision_one_is_stale(spark):
    current = spark.createDataFrame([("a", 4), (None, 1)], "k string, revision long")
    updates = spark.createDataFrame([("a", 1, 4), ("a", 2, 4), ("a", 3, 5), ("b", 1, 4), ("a", 4, None), (None, 1, 1)], "k string, seq int, revision long")
    got = {(r.k, r.seq): (r.outcome, r.revision) for r in compare_and_swap(current, updates, ["k"], ["seq"]).collect()}
    assert got == {("a", 1): ("swapped", 5), ("a", 2): ("stale", 5), ("a", 3): ("swapped", 6), ("a", 4): ("stale", 6), ("b", 1): ("not_found", None), (None, 1): ("not_found", None)}
    assert compare_and_swap(current, updates.where("false"), ["k"], ["seq"]).count() == 0


def test_hot_key(spark):
    rng = random.Random(5)
    rows = [(0 if i % 3 == 0 else i, i, rng.randrange(i // 40 + 1)) for i in range(6000)]
    current = spark.createDataFrame([(k, 0) for k in {r[0] for r in rows}], "k long, revision long")
    updates = spark.createDataFrame(rows, "k long, seq long, revision long").repartition(6)
    out = compare_and_swap(current, updates, ["k"], ["seq"], block=16)
    want = {}
    for key in {r[0] for r in rows}:
        state = 0
        for _, seq, named in sorted(r for r in rows if r[0] == key):
            done = named == state
            state += done
            want[seq] = ("swapped" if done else "stale", state)
    assert {r.seq: (r.outcome, r.revision) for r in out.collect()} == want and max(s for _, s in want.values()) > 10
