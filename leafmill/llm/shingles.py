"""Shingle sets of whole texts as sorted arrays of 64-bit hashes, made for many texts at once.

A word's hash is a polynomial in its bytes, mixed; a shingle's hash folds the
hashes of its words.  Hashes are spread evenly, so the smallest of a set are a
bottom-k sketch by the same one hash function.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Bytes hashed at once; longer texts are cut between words.
BLOCK_BYTES = 1 << 20
BASE, MIX_A, MIX_B, GOLD = (np.uint64(x) for x in (0x9E3779B97F4A7C55, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
SPACE = re.compile(rb"[\t-\r ]")
GAP = np.zeros(256, bool)
GAP[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 256), BASE, np.uint64)
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX_A
    h = (h ^ (h >> np.uint64(27))) * MIX_B
    return h ^ (h >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words (runs of bytes other than ASCII space) in ``data``."""
    b = np.frombuffer(data, np.uint8)
    inside = np.concatenate(([False], ~GAP[b], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.repeat(starts, lengths)
    letters = b[inside[1:-1]].astype(np.uint64) + np.uint64(1)
    place = np.flatnonzero(inside[1:-1]) - first
    terms = letters * powers(int(lengths.max()) + 1)[place]
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return starts, mix(np.add.reduceat(terms, begin) + lengths.astype(np.uint64) * GOLD)


def word_blocks(data: bytes) -> Iterator[bytes]:
    """``data`` in blocks, cut between words only."""
    at = 0
    while at < len(data):
        gap = SPACE.search(data, at + BLOCK_BYTES)
        end = gap.start() if gap else len(data)
        yield data[at:end]
        at = end


def _fold(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    m = min(n, len(words))
    h = np.full(len(words) - m + 1, m, np.uint64)
    for i in range(m):
        h = mix(h * GOLD + words[i : len(words) - m + 1 + i])
    return h


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes (as int64) of its ``n``-word shingles, A-Z lower-cased.

    A text of fewer words has its whole sequence as one shingle; null and empty
    texts have none.
    """
    out: list[np.ndarray] = []
    group: list[bytes] = []

    def flush() -> None:
        offsets = np.cumsum([0, *[len(d) + 1 for d in group]])
        starts, hashes = word_hashes(b" ".join(group))
        bounds = np.searchsorted(starts, offsets)
        for a, z in zip(bounds[:-1], bounds[1:]):
            out.append(np.unique(_fold(hashes[a:z], n).view(np.int64)))
        group.clear()

    size = 0
    for text in texts:
        data = (text or "").encode().lower()
        if len(data) > BLOCK_BYTES:
            flush()
            size = 0
            words = np.concatenate([word_hashes(b)[1] for b in word_blocks(data)])
            out.append(np.unique(_fold(words, n).view(np.int64)))
            continue
        group.append(data)
        size += len(data)
        if size > BLOCK_BYTES:
            flush()
            size = 0
    flush()
    return out
