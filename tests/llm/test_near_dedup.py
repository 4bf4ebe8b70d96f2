"""Near-duplicate groups against brute force, with crowds of copies and shared passages."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import near_dedup as N
from leafmill.llm import shingles as S


def brute(rows, words, percent):
    sets, parent, held = {}, {}, defaultdict(list)
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in held[s])
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            held[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def found(df, **kw):
    rows = N.near_duplicates(df, **kw).collect()
    assert all(r.kept == (r.component_id == r.doc_id) for r in rows if r.doc_id is not None)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_documents(spark, sf_dir, words, percent):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert found(df, words=words, percent=percent) == brute([(r.doc_id, r.text) for r in df.collect()], words, percent)


def crowd():
    """Copies with ever more edits, chains of edits, exact copies, and texts that share a passage only."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    base, passage, rows = [word() for _ in range(120)], [word() for _ in range(60)], []
    for _ in range(150):
        t = list(base)
        for _ in range(rng.randint(0, 14)):
            t[rng.randrange(len(t))] = word()
        rows.append(" ".join(t))
    chain = [word() for _ in range(150)]
    for _ in range(25):
        chain = list(chain)
        for _ in range(3):
            chain[rng.randrange(150)] = word()
        rows.append(" ".join(chain))
    rows += [" ".join(base)] * 30
    rows += [" ".join([*[word() for _ in range(rng.randint(20, 80))], *passage]) for _ in range(100)]
    rng.shuffle(rows)
    return list(enumerate(rows, 100))


def test_crowd(spark):
    rows = crowd()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df, words=3, percent=85) == brute(rows, 3, 85)


def family(n, shared=90, own=10):
    """Documents with one passage and a few words of their own: just not similar enough."""
    passage = " ".join(f"w{i}" for i in range(shared))
    return [(i, passage + " " + " ".join(f"d{i}x{j}" for j in range(own))) for i in range(n)]


def test_family_forms_no_pairs(spark):
    """Lists that hold every document give no pair, for none of them is indexed there."""
    df = spark.createDataFrame(family(3000), "doc_id long, text string").repartition(8)
    sets = N.whole_lists(df.select(F.col("doc_id").alias("id")), df.select(F.col("doc_id").alias("id"), "text"), 3, 85)
    assert sets.where("not indexed").count() > 3000 and sets.where("indexed").isEmpty()
    assert found(df, words=3, percent=85) == {i: (98, i) for i in range(3000)}


def test_indexing_prefix(spark):
    """Sets of different sizes near the threshold, from both sides."""
    rng = random.Random(11)
    rows, base = [], [f"w{i}" for i in range(100)]
    for i in range(240):
        t = base[: rng.randint(84, 100)] + [f"o{rng.randrange(12)}" for _ in range(rng.randint(0, 14))]
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for percent in (80, 85, 95):
        assert found(df, words=1, percent=percent, exact=True) == brute(rows, 1, percent)


def test_exact(spark):
    """All classes by whole sets, without estimates; also with sketches too small to find much."""
    rows = crowd()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df, words=3, percent=85, exact=True, k=12) == brute(rows, 3, 85)


def test_hot_keys(spark, monkeypatch):
    """Results don't depend on which keys count as hot, or on how lists are cut."""
    from leafmill.llm import common

    monkeypatch.setattr(common, "HOT", 20)
    monkeypatch.setattr(common, "LIGHT", 5)
    monkeypatch.setattr(N, "PER_COPY", 7)
    rows = crowd()
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words=3, percent=85) == brute(rows, 3, 85)


def test_look_up(spark, monkeypatch):
    from leafmill.llm import common

    monkeypatch.setattr(common, "LIGHT", 50)
    rows = common.settle(spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(5000)] + [(k, -k) for k in range(20, 3000)] + [(None, i) for i in range(400)], "k int, i int"), "rows")
    facts = spark.createDataFrame([(k, f"f{k}") for k in range(0, 3000, 2)], "k int, f string")
    for how in ("inner", "left"):
        assert sorted(map(str, common.look_up(rows, facts, "k", how).collect())) == sorted(map(str, rows.join(facts, "k", how).collect()))


def test_scratch(spark):
    """Only what is kept stays; inner scratch hands it to the outer one."""
    import os

    from leafmill.llm import common

    there = lambda df: os.path.isdir(df.settled_at)
    with common.scratch(spark) as keep:
        with common.scratch(spark) as inner:
            a, b = common.settle(spark.range(3), "a"), inner(common.settle(spark.range(4), "b"))
        c = keep(common.settle(b, "c"))
        assert not there(a) and there(b)
    assert not there(b) and there(c) and c.count() == 4
    common.drop_settled(c)
    assert not there(c)
    folder = os.path.dirname(c.settled_at)
    before = set(os.listdir(folder))
    got = N.near_duplicates(spark.createDataFrame(crowd()[:50], "doc_id long, text string"))
    left = set(os.listdir(folder)) - before
    assert got.count() == 50 and [x.split("-")[0] for x in left] == ["components"]


def test_shared_ids(spark):
    """An id on several texts: only rows with like texts are merged, and links of each text count."""
    import corpus_pipeline

    rng = random.Random(9)
    a, b, c, d = (" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(80)) for _ in range(4))
    rows = [(1, a), (2, a + " end"), (2, b), (3, b + " end"), (4, c), (4, d), (4, d), (5, d + " end"), (6, None), (6, c + " end")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, at int").repartition(3)
    got = Counter((r.doc_id, r.component_id, r.kept) for r in N.near_duplicate_rows(df).collect())
    assert got == Counter([(1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False), (4, 4, True), (4, 4, True), (4, 4, True), (5, 4, False), (6, 6, True), (6, 4, False)])
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "").collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(1, a), (2, b), (4, c), (4, d), (6, None)])


def test_shared_part():
    from math import ceil, comb

    for percent, k in [(40, 32), (50, 32), (60, 32), (80, 32), (85, 32), (80, 10), (60, 48)]:
        least, p = ceil(k * N.shared_part(percent, k)), percent / 100
        assert 0 < least and sum(comb(k, i) * p**i * (1 - p) ** (k - i) for i in range(least)) <= N.MISS
    assert N.shared_part(80, 32) == N.shared_part(85, 32) == 0.4
    with pytest.raises(ValueError):
        N.shared_part(80, 4)


def test_low_similarity(spark):
    """Pairs of single words just above 50 %, of which many share fewer than 13 of 32 hashes."""
    rng = random.Random(3)
    rows = []
    for i in range(200):
        common, left, right = ([f"w{i}{c}{j}" for j in range(n)] for c, n in (("c", 101), ("l", 50), ("r", 50)))
        for j, own in enumerate((left, right)):
            words = common + own
            rng.shuffle(words)
            rows.append((2 * i + j, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(df, words=1, percent=50) == brute(rows, 1, 50)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(200, i) for i in range(201, 240)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in N.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (4, "A\tB ", "x"), (None, "a b", "x"), (None, None, "x"), (5, "q " * 40_000, "x"), (5, "q " * 40_000, "x"), (6, "a b c", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df, words=3, percent=85).collect())
    assert got == [(False, 1, 0, 1, True), (False, 2, 0, 2, True), (False, 3, 1, 3, True), (False, 4, 1, 3, False), (False, 5, 1, 5, True), (False, 5, 1, 5, True), (False, 6, 1, 6, True), (True, 0, 0, None, True), (True, 0, 1, None, True)]
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_long_blocks():
    rng = random.Random(1)
    long = " ".join("".join(rng.choices("abcé", k=rng.randint(1, 9))) for _ in range(300_000))
    whole, *_ = S.shingle_sets([long], 3)
    S.BLOCK_BYTES, before = 1 << 14, S.BLOCK_BYTES
    try:
        cut, *_ = S.shingle_sets([long], 3)
    finally:
        S.BLOCK_BYTES = before
    assert np.array_equal(whole, cut)
    words = long.split()
    assert len(whole) == len(set(zip(words, words[1:], words[2:])))
