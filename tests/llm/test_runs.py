"""Periodic runs against brute force, and the query's digests."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import runs as R


def brute(words, least=24, times=3):
    """All runs by their definition: for each period, maximal stretches of words that equal the word a period later."""
    n, found = len(words), {}
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i >= p:  # a square at least; the least period of a stretch is met first
                found.setdefault((i, j + p - i), p)
            i = j
    return sorted((s, length, p) for (s, length), p in found.items() if length >= max(least, times * p))


def least_periods(words, runs):
    for s, length, p in runs:
        part = words[s : s + length]
        assert p == next(q for q in range(1, length + 1) if part[q:] == part[:-q])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=1) | st.just("c"), max_size=70), st.integers(3, 4))
def test_runs_of_small_alphabets(letters, times):
    words = [c.encode() for c in letters]
    (got,) = R.texts_runs([words], 1, times)
    assert list(map(tuple, got)) == brute(words, 1, times)
    least_periods(words, got)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=6), st.integers(1, 9)), max_size=8), st.integers(0, 3))
def test_runs_of_repeated_stretches(parts, others):
    """Several texts at once have the runs of each alone."""
    text = [c.encode() for s, k in parts for c in s * k]
    texts = [text, text[::-1], *[text[i:] for i in range(others)], [], [b"x"] * 40]
    assert [[tuple(r) for r in found] for found in R.texts_runs(texts, 4, 3)] == [brute(t, 4, 3) for t in texts]


def test_long():
    rng = np.random.default_rng(3)
    words = [b"%d" % x for x in rng.integers(0, 50, 300_000)]
    words[1000:201_000] = (words[1000:1777] * 300)[:200_000]
    words[250_000:290_000] = [b"same"] * 40_000
    (got,) = R.texts_runs([words])
    starts = {r.period: r for r in got}
    assert starts[777].start <= 1000 and starts[777].start + starts[777].length >= 201_000 and starts[1].length >= 40_000 and len(got) == 2


def test_kept_words():
    assert R.kept_words(10, [R.Run(2, 6, 2), R.Run(7, 3, 1)]).tolist() == [True] * 4 + [False] * 6
    assert R.kept_words(3, []).all()


def expect(key, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(key).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    (found,) = R.texts_runs([words])
    if n < 800:
        assert [tuple(r) for r in found] == brute(words)
    best = max(found, key=lambda r: (r.length * 10**9 // r.period, -r.start, -r.period), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + length for s, length, p in found)]
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (len(found), *(best or (None,) * 3), best and 1000 * best.length // best.period, sha(lines.encode()), sha(b" ".join(kept)))


def test_query(spark, sf_dir, tmp_path):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:8] for r in R.op13_periodic_runs(spark, sf_dir).collect()}
    assert got == {k: expect(k, t) for k, t in docs} and sum(v[0] > 0 for v in got.values()) >= len(docs) // 20
    rows = [(1, None), (2, ""), (3, "a " * 30), (4, "x y " * 12 + "z"), (5, "  " * 24), (60, "p q r s t u v w " * 3 + "\x1c" * 3)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:8] for r in R.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert got == {k: expect(k, t) for k, t in rows} and [got[k][:4] for k in (3, 4, 60)] == [(1, 0, 30, 1), (1, 0, 24, 2), (1, 0, 24, 8)]
