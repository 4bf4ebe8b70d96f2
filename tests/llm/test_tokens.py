"""BPE transducer and piece counts against the public libraries; packing against its rules."""

from __future__ import annotations

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as public
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import bpe_transducer as B
from leafmill.llm import packing as P
from leafmill.llm import token_counts as C

RANKS = public.path("byte_bpe_50k.tiktoken")
STRANGE = "".join(["ab cd\n\t éß日本😀▁<|endoftext|>'s 12,.!ÀǅK\x00\x85  "])


@pytest.fixture(scope="module")
def ranks():
    return B.load_ranks(RANKS)


@pytest.fixture(scope="module")
def library(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer(ranks, library):
    import regex

    rng, tokens, t = random.Random(4), list(ranks), B.Transducer(ranks, max_states=500)  # flushes often
    for k in range(4000):
        data = b"".join(rng.choices(tokens, k=rng.randint(1, 5))) if k % 2 else bytes(rng.choices(b"abtehrins .'", k=rng.randint(1, 20)))
        text = data.decode("utf-8", "ignore")
        for piece in regex.findall(public.PATTERN, text):
            assert list(t.encode(piece.encode())) == library.encode_ordinary(piece)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(STRANGE) | st.characters(codec="utf-8"), max_size=40))
def test_any_text(text):
    import regex

    pieces = B.worker_pieces(RANKS)
    ids = [i for p in regex.findall(public.PATTERN, text) for i in pieces[p]]
    d = B.Decoder(pieces.transducer.tokens)
    for chunk in (1, 3, 4096):
        parts = list(d.decode(ids, chunk))
        assert b"".join(parts) == text.encode() and "".join(p.decode() for p in parts) == text  # each part is whole characters


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=6))
def test_utf8(data):
    state = B.ACCEPT
    for byte in data:
        state = B.utf8_step(state, byte)
    try:
        data.decode()
        whole = True
    except UnicodeDecodeError:
        whole = False
    assert (state == B.ACCEPT) == whole


def test_broken_streams(ranks):
    d, euro = B.Decoder({i: bytes([i]) for i in range(256)}), "€".encode()
    assert list(d.stream([euro[:1], euro[1:2], euro[2:] + b"x"])) == [b"", b"", euro + b"x"]
    for ids in (euro[:2], b"\xff", b"\x80", euro[:2] + b"a"):
        with pytest.raises(ValueError):
            list(d.decode(ids))


def test_long_pieces_take_linear_time(ranks, library):
    import time

    t = B.Transducer(ranks)
    for part in ("a", "ab", "日本語", "ACGT", "="):
        assert list(t.encode((part * 20_000).encode())) == library.encode_ordinary(part * 20_000)
        began = time.time()
        t.encode((part * 500_000).encode())
        assert time.time() - began < 15
    rng = random.Random(2)
    text = "".join(rng.choices("abcdefghijklmnop", k=30_000))
    assert list(t.encode(text.encode())) == library.encode_ordinary(text)


def test_vocabularies_of_any_size():
    far = {bytes([i]): i for i in range(256)} | {b"ab": 1 << 20, b"abc": 1 << 21, b"bc": (1 << 20) + 1, b"ca": 1 << 22}
    import tiktoken

    order = {b: i for i, b in enumerate(sorted(far, key=far.get))}
    library, t = tiktoken.Encoding("far", pat_str=r"[a-z]+", mergeable_ranks=order, special_tokens={}), B.Transducer(far)
    ids = sorted(far.values())
    rng = random.Random(8)
    for _ in range(500):
        text = "".join(rng.choices("abc", k=rng.randint(1, 15)))
        assert list(t.encode(text.encode())) == [ids[i] for i in library.encode_ordinary(text)]


def test_round_trip(spark, library):
    import hashlib

    texts = ["", None, "hello  world\n", "日本" * 3, "x" * 30_000, "é" * 9_001, STRANGE]
    got = B.round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"], "text", RANKS, public.PATTERN).collect()
    for r, t in zip(got, texts):
        ids = library.encode_ordinary(t or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    coded = B.encode_texts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), ["doc_id"], "text", RANKS, public.PATTERN).first()
    assert coded.ids == library.encode_ordinary("a b")


def test_counts():
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    own, sp, rng = C.PieceCounter(path), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(7)
    parts = [*STRANGE, "the", " of", "  ", "<s>", "</s>", "<unk>", "<0x0A>", "▁▁"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        assert own.count(text) == len(sp.encode(text)), repr(text)
    assert own.count("ab" * 20_000) == len(sp.encode("ab" * 20_000)) and own.count(None) == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 20), max_size=25))
def test_plan(counts):
    used, bins = defaultdict(int), defaultdict(list)
    for r in P.plan(counts, 50):
        assert r.first == used[r.length]
        used[r.length] += r.bins * r.copies
        for i in range(r.bins * r.copies):
            bins[r.sequence + i // r.copies].append((r.offset + i % r.copies * r.length, r.length))
    assert used == counts
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 50


def test_plan_does_not_grow():
    """A plan has as many runs for any multiple of the pieces, and wastes no more."""
    rng, hard = random.Random(6), [{1022: 1, 1: 2}, {850: 1, 70: 1, 71: 1, 100: 1}]
    for counts in [*hard, *({rng.randint(1, 1024): rng.randint(1, 9) for _ in range(300)} for _ in range(20))]:
        plans = [P.plan({w: n * many for w, n in counts.items()}, 1024) for many in (1000, 1_000_000)]
        bins = [max(r.sequence + r.bins for r in p) for p in plans]
        assert len(plans[1]) <= 1.1 * len(plans[0]) + 5 and bins[1] <= 1000 * bins[0]
    assert [len(P.plan({w: n * 40_000 for w, n in c.items()}, 1024)) for c in hard] == [3, 5]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 20), min_size=1, max_size=25))
def test_places(counts):
    runs = P.plan(counts, 50)
    want = {(r.length, r.first + i): (r.sequence + i // r.copies, r.offset + i % r.copies * r.length) for r in runs for i in range(r.bins * r.copies)}
    length, rank = np.array(sorted(want)).T
    assert list(zip(*(x.tolist() for x in P.Places(runs).of(length, rank)))) == [want[k] for k in sorted(want)]


def test_only_plain_files_have_ranks():
    import json

    with open(public.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        data = json.load(file)
    assert P.plain_ranks(data) == B.load_ranks(RANKS)
    assert P.plain_ranks({**data, "normalizer": {"type": "NFC"}}) is P.plain_ranks({**data, "pre_tokenizer": {"type": "Whitespace"}}) is None
    turned = {**data["model"], "merges": data["model"]["merges"][::-1]}
    assert P.plain_ranks({**data, "model": turned}) is None


def optimum(items, capacity):
    """Fewest bins, by trying all placements."""
    best = len(items)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for r in sorted({x for x in rooms if x >= items[i]}):
            rest = list(rooms)
            rest[rest.index(r)] -= items[i]
            place(i + 1, rest)
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best


def test_reduction_keeps_the_optimum():
    rng = random.Random(11)
    for _ in range(150):
        items = sorted((rng.randint(2, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        sizes = P.Sizes({w: items.count(w) for w in items})
        fixed = P.reduce(sizes, 20)
        left = sorted((w for w, n in sizes.count.items() for _ in range(n)), reverse=True)
        assert sum(n for _, n in fixed) + optimum(left, 20) == optimum(items, 20)


def test_packing(spark, sf_dir):
    import tokenizers

    rows = P.op4_best_fit_packing(spark, sf_dir).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    own, ids, seqs, pieces = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json")), {}, defaultdict(list), defaultdict(list)
    for i, t in texts.items():
        ids[i] = [*own.encode(t, add_special_tokens=False).ids, 2]
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and len(part) == r.length
        seqs[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length))
    for i, own_pieces in pieces.items():
        own_pieces.sort()
        n = len(ids[i])
        assert len(own_pieces) == -(-n // 1024) and [p for p, *_ in own_pieces] == list(range(len(own_pieces)))
        assert all(length == 1024 for _, _, length in own_pieces[1:]) and sum(x[2] for x in own_pieces) == n
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert pieces.keys() == texts.keys()
    assert len(seqs) <= math.ceil(sum(map(len, ids.values())) / 1024) * 1.05 + 1


def test_tokenizer_paths():
    import tokenizers

    own, t, rng = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json")), P.Tokenizer(public.path("byte_bpe_50k.json"), public.PATTERN), random.Random(3)
    parts = [*STRANGE, "<|endoftext|>", "the", *map(chr, range(0x80, 0x250))]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 15)))
        assert t.ids(text).tolist() == own.encode(text, add_special_tokens=False).ids, repr(text)
