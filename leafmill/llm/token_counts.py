"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made.

Symbols are a linked list of characters; a heap holds the mergeable neighbours by
rank.  The lowest rank is popped, its symbols are joined, new neighbours enter
the heap.  The count is the initial symbols minus the merges.

No piece of the vocabulary goes on past a space mark after another character, so
each run of space marks with the characters behind it merges by itself, and what
has been counted once in a worker is kept (up to a fixed number of entries).
A character that is in no piece stands as its UTF-8 bytes and is never merged.

Cases: null and empty texts have no tokens; texts of any length are counted
whole; special strings inside a text are ordinary text; rows may repeat.
"""

from __future__ import annotations

import heapq
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import map_text, table

SPACE = "▁"
MAX_UNITS, MAX_UNIT_CHARS = 400_000, 48
#: Piece types of the model file whose strings may be made by merges: normal, user-defined, unused.
MERGEABLE = {1, 4, 5}


def _fields(data: bytes):
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


class PieceCounter(dict):
    """Counts tokens by a byte-pair model file; as a dictionary it keeps the counts of units by their string."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.ranks: dict[str, float] = {}
        spec = {"prefix": True, "collapse": True, "charsmap": b""}
        with open(path, "rb") as file:
            for number, value in _fields(file.read()):
                if number == 1:
                    piece = dict(_fields(value))
                    if piece.get(3, 1) in MERGEABLE:
                        self.ranks[piece[1].decode()] = -struct.unpack("<f", piece[2])[0]
                elif number == 3:
                    names = {2: "charsmap", 3: "prefix", 4: "collapse"}
                    spec |= {names[k]: v for k, v in _fields(value) if k in names}
        if spec["charsmap"] or spec["collapse"] or not spec["prefix"]:
            raise ValueError("this counter takes models that add a prefix and don't normalise")
        if any(SPACE in p.lstrip(SPACE) for p in self.ranks):
            raise ValueError("this model has pieces that go on past a space")
        self.lines = not any("\n" in p for p in self.ranks)

    def symbols(self, char: str) -> int:
        return 1 if char in self.ranks else len(char.encode())

    def merge(self, unit: str) -> int:
        """Tokens of a string: its initial symbols minus the merges."""
        ranks = self.ranks
        n, count = len(unit), sum(map(self.symbols, unit))
        text: list[str | None] = list(unit)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, len(p)) for i in range(n - 1) if (r := ranks.get(p := unit[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, a, size = heapq.heappop(heap)
            if (x := text[a]) is None or (b := right[a]) < 0 or len(x) + len(y := text[b]) != size:
                continue  # one of the two has been merged since
            text[a], text[b] = x + y, None
            count -= 1
            right[a] = c = right[b]
            if c >= 0:
                left[c] = a
                if (r := ranks.get(p := text[a] + text[c])) is not None:
                    heapq.heappush(heap, (r, a, len(p)))
            if (c := left[a]) >= 0 and (r := ranks.get(p := text[c] + text[a])) is not None:
                heapq.heappush(heap, (r, c, len(p)))
        return count

    def __missing__(self, unit: str) -> int:
        n = self.merge(unit)
        if len(unit) <= MAX_UNIT_CHARS:
            if len(self) >= MAX_UNITS:
                self.clear()
            self[unit] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        lines = (SPACE + text.replace(" ", SPACE)).split("\n") if self.lines else [SPACE + text.replace(" ", SPACE)]
        total = len(lines) - 1  # a line end is one byte, in no piece
        for line in lines:
            head, *units = line.split(SPACE)
            if head:
                total += self[head]
            if units and (units[-1] == "" or "" in units):
                run = 0
                for unit in units:
                    run += 1
                    if unit:
                        total += self[SPACE * run + unit]
                        run = 0
                if run:
                    total += self[SPACE * run]
            else:
                total += sum(map(self.__getitem__, [SPACE + u for u in units]))
        return total


COUNTS = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])


def count_tokens(df: DataFrame, keep: list[str], text_col: str, path: str) -> DataFrame:
    """UTF-8 bytes and tokens of each text."""

    def start():
        counter = PieceCounter(path)
        return lambda texts: ([len((t or "").encode()) for t in texts], list(map(counter.count, texts)))

    return map_text(df, start, text_col, keep, COUNTS)


def op10_token_counts(spark: SparkSession, sf_dir: str, limit: int = 4096) -> DataFrame:
    """Tokens of every text of ``documents`` by the public piece model."""
    import public_tokenizers as public

    df = count_tokens(table(spark, sf_dir, "documents"), ["doc_id"], "text", public.path("piece_bpe_32k.model"))
    return df.withColumn("over_limit", df.n_tokens > limit)
