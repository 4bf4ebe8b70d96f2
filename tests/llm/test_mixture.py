"""Mixture-controlled packing: identifiers against the library, exact covers, proportions, schedules."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm.mixture import Mixture, WordTokenizer, fill, op11_mixture_packing, pack_mixture, windows_of

public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


def test_identifiers():
    import tokenizers

    own, ours = tokenizers.Tokenizer.from_file(PATH), WordTokenizer(PATH)
    texts = ["", " ", "It's a DOG's life, they'll  say", "naïve Éclairs Ÿ ÀÖ 12½ ²x", "x<|startoftext|>y <|endoftext|>", "İstanbul ẞ ΑΣ Σ ὈΔΥΣΣΕΎΣ", "日本語 テスト", "é ́e", "a\x1cb\x85c d", "\x00\x7f…“”‘’", "don’t 'S 'LL", "ſ ŉ µ ª º \xad", "Ȁ Ɓ Ⱥ ǅ", "#*$%&|<>`" * 30, "w" * 5000]
    for text in texts:
        assert np.frombuffer(ours.ids(text), ours.dtype).tolist() == own.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_identifiers_of_any_text(text):
    import tokenizers

    own, ours = test_identifiers_of_any_text.__dict__.setdefault("pair", (tokenizers.Tokenizer.from_file(PATH), WordTokenizer(PATH)))
    assert np.frombuffer(ours.ids(text), ours.dtype).tolist() == own.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 5000), st.integers(1, 50)), min_size=1, max_size=8), st.integers(1, 300), st.booleans())
def test_mixture(parts, size, own_weights):
    totals = [n for n, _ in parts]
    mix = Mixture(totals, [w for _, w in parts] if own_weights else totals)
    before = [0] * len(totals)
    for n in range(0, mix.total + size, size):
        now = mix.at(n)
        assert sum(now) == min(n, mix.total) and all(a <= b <= t for a, b, t in zip(before, now, totals))
        for q, (a, b) in enumerate(zip(before, now)):
            if b > a:
                assert mix.block_of(q, a, size) == mix.block_of(q, b - 1, size) == n // size - 1 if n <= mix.total else True
        before = now
    assert before == totals


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=8), st.integers(8, 100), st.integers(1, 40))
def test_fill(quotas, capacity, visit):
    total = sum(quotas)
    sizes = windows_of(total, capacity, 0, total // capacity + 1)
    assert sum(sizes) == total and all(s == capacity or s & (s - 1) == 0 for s in sizes)
    given_ = Counter()
    for size, served in zip(sizes, fill(sizes, np.array(quotas), np.zeros(len(quotas)), visit)):
        assert sum(n for _, n in served) == size and len({q for q, _ in served}) == len(served)
        for q, n in served:
            given_[q] += n
    assert [given_[q] for q in range(len(quotas))] == quotas


def check(rows, docs, capacity, end_id=1):
    import tokenizers

    own, of, at = tokenizers.Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
        at[r.sequence_id].append(r)
    for key, text in docs:
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, end_id], "<u4")
        begin = 0
        for r in sorted(of.pop(key), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (begin, len(ids)) and r.ids_crc32 == zlib.crc32(ids[begin : begin + r.length].tobytes())
            begin += r.length
        assert begin == len(ids)
    assert not of
    sizes = []
    for pieces in at.values():
        begin = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == begin and r.length > 0
            begin += r.length
        sizes.append(begin)
    assert all(s == capacity or s < capacity and s & (s - 1) == 0 for s in sizes)
    return at


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    at = check(op11_mixture_packing(spark, sf_dir).collect(), docs, 2048)
    total = Counter()
    for pieces in at.values():
        for r in pieces:
            total[r.queue] += r.length
    share = {q: n / sum(total.values()) for q, n in total.items()}
    for pieces in at.values():
        size, held = sum(r.length for r in pieces), Counter()
        for r in pieces:
            held[r.queue] += r.length
        if size == 2048:
            assert all(abs(held[q] - share[q] * size) <= 160 for q in share)


def test_small_blocks_weights_and_edges(spark):
    rows = [(i, "word " * (i * 7 % 50), "abc"[i % 3] if i % 10 else None) for i in range(200)] + [(1000, None, "a"), (1001, "", None), (1002, "long text " * 3000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for weights in (None, {"a": 5, "b": 1, "c": 2}):
        for most in (1, 2, 10):
            check(pack_mixture(df, capacity=64, block=4, weights=weights, most_queues=most, visit=8).collect(), [r[:2] for r in rows], 64)
    # A source with a third of the weight fills a third of each early sequence, until one runs out.
    got = pack_mixture(df, capacity=512, block=2, weights={"a": 1, "b": 1, "c": 1}, visit=8)
    first = Counter()
    for r in got.where("sequence_id < 2").collect():
        first[r.queue] += r.length
    assert len(first) == 4 and max(first.values()) - min(first.values()) <= 40
    assert pack_mixture(df.where("false")).count() == 0
