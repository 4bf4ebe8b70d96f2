"""Best-fit packing of token sequences with Martello and Toth's dominance reduction.

Lengths are at most the capacity, so all that the packing needs to know is how
many pieces there are of each length: one row for each length, whatever the
corpus holds.  On this histogram the reduction fixes sets of up to three pieces
that dominate every other choice for their largest piece (a perfect pair, say),
shrinks the instance, and best fit decreasing packs the rest, each step for all
pieces of a length at once.  The plan says for runs of pieces of one length, by
rank, which sequences and offsets they get, and has as many runs for a thousand
times the pieces; pieces find their ranks without a global sort, from their order
within their task and the counts of the tasks, and their run by binary search.

Cases: null and empty texts are one piece, the end token; a document longer than
the capacity is cut so that only its first piece may be shorter; ties are broken
by rank; repeated rows are packed as documents of their own; an empty table has
no sequences.
"""

from __future__ import annotations

import heapq
import json
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SLICE_ROWS, settle, table


class Run(NamedTuple):
    """Pieces ``first``, ``first + 1``, ... of one length: ``copies`` side by side in each of ``bins`` sequences."""

    length: int
    first: int
    bins: int
    copies: int
    sequence: int
    offset: int


class Sizes:
    """Lengths of the pieces still to be packed, with their numbers."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.count = {w: n for w, n in counts.items() if n > 0}
        self.order = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.order.remove(size)

    def largest(self, limit: int) -> int | None:
        i = bisect_right(self.order, limit)
        return self.order[i - 1] if i else None

    def smallest_fitting(self, room: int, most: int) -> int:
        """How many of the smallest pieces fit together, counted up to ``most``."""
        k = 0
        for w in self.order:
            n = min(self.count[w], most - k, room // w)
            k, room = k + n, room - n * w
            if k == most or n < self.count[w]:
                break
        return k

    def best_pair(self, room: int) -> tuple[int, int] | None:
        """The two pieces (larger first) with the largest sum that fits."""
        best, i, j = None, 0, len(self.order) - 1
        while i <= j:
            a, b = self.order[j], self.order[i]
            if a + b > room:
                j -= 1
                continue
            if (i != j or self.count[a] > 1) and (best is None or a + b > sum(best)):
                best = (a, b)
            i += 1
        return best


def reduce(sizes: Sizes, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets, taking them out of ``sizes``; returns the sets with their numbers.

    For the largest piece w of each length, with room r = capacity - w: if no
    other piece fits, w stands alone; if the largest piece that fits fills r, or
    no two others fit, or no pair that fits beats it, w and that piece are fixed;
    if a pair beats it that holds that piece and no three others fit, and the
    next two larger than its second don't fit, w and the pair are fixed.  A set
    that dominates goes on doing so until one of its lengths runs out, for pieces
    taken out only leave fewer rivals; so it is fixed as often as there are pieces
    for it, and the number of sets follows from the number of lengths.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    changed = True
    while changed:
        changed = False
        for w in sorted(sizes.order, reverse=True):
            while w in sizes.count:
                n, room = sizes.count[w], capacity - w
                sizes.take(w, 1)  # the piece itself doesn't count as another
                star = sizes.largest(room)
                k = sizes.smallest_fitting(room, 3) if star else 0
                pair = sizes.best_pair(room) if k == 2 else None
                sizes.count[w] = n
                if w not in sizes.order:
                    sizes.order.insert(bisect_right(sizes.order, w), w)
                if k == 0:
                    found = (w,)
                elif star == room or k == 1 or pair and star >= sum(pair):
                    found = (w, star)
                elif pair and pair[0] == star and w + 2 * next((x for x in sizes.order if x > pair[1]), capacity) > capacity:
                    found = (w, *pair)
                else:
                    break
                times = Counter(found)
                many = min(sizes.count[x] // c for x, c in times.items())
                for x, c in times.items():
                    sizes.take(x, many * c)
                fixed.append((found, many))
                changed = True
    return fixed


def best_fit(sizes: Sizes, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit decreasing over whole lengths: groups of like bins as (lengths with copies, number of bins)."""
    by_room: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    for w in sorted(sizes.order, reverse=True):
        left = sizes.count[w]
        # Rooms are tried from the tightest; what a bin has left over is tighter still, so each bin is filled before the next.
        rooms = sorted(r for r in by_room if r >= w)
        heapq.heapify(rooms)
        while left and rooms:
            room = heapq.heappop(rooms)
            groups = by_room.pop(room)
            while left and groups:
                holds, bins = groups.pop()
                each = room // w
                full = min(bins, left // each)
                if full:
                    by_room.setdefault(room - each * w, []).append(([*holds, (w, each)], full))
                    bins, left = bins - full, left - full * each
                if bins and 0 < left < each:
                    by_room.setdefault(room - left * w, []).append(([*holds, (w, left)], 1))
                    bins, left = bins - 1, 0
                if bins:
                    groups.append((holds, bins))
            if groups:
                by_room.setdefault(room, []).extend(groups)
        each = capacity // w
        if left // each:
            by_room.setdefault(capacity - each * w, []).append(([(w, each)], left // each))
        if left % each:
            by_room.setdefault(capacity - left % each * w, []).append(([(w, left % each)], 1))
    return [group for groups in by_room.values() for group in groups]


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """Where the pieces of each length go, for a histogram of lengths."""
    sizes = Sizes(counts)
    bins = [([(x, 1) for x in found], many) for found, many in reduce(sizes, capacity)]
    runs, used, sequence = [], dict.fromkeys(counts, 0), 0
    for holds, many in bins + best_fit(sizes, capacity):
        offset = 0
        for w, copies in holds:
            runs.append(Run(w, used[w], many, copies, sequence, offset))
            used[w] += many * copies
            offset += w * copies
        sequence += many
    return runs


# -- tokens -----------------------------------------------------------------


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


#: The pre-tokenizer whose pieces the pattern gives; a fixed value of the file format.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def plain_ranks(data: dict) -> dict[bytes, int] | None:
    """The ranks of a tokenizer file that merges bytes in the order of identifiers and does nothing else; null for any other file."""
    model, at = data["model"], byte_of()
    if data.get("normalizer") or data.get("pre_tokenizer") != BYTE_LEVEL or model.get("type") != "BPE":
        return None
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    special = {t["content"] for t in data.get("added_tokens", [])}
    ranks = {bytes(at[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    made = [model["vocab"][t] for t in merged]
    return ranks if made == sorted(made) and len(merged) + 256 == len(ranks) else None


class Tokenizer:
    """Identifiers as the tokenizer file's own library gives them, without added special tokens.

    Texts whose letters all library versions class alike go through a faster
    library with the same vocabulary, ranks and pattern, if the file is of the
    plain kind (:func:`plain_ranks`); others, and texts with the string of a
    special token, through the file's own.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import re

        import tiktoken
        import tokenizers

        self.own = tokenizers.Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        ranks = plain_ranks(data)
        self.fast = ranks and tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        special = [t["content"] for t in data.get("added_tokens", [])]
        self.other = re.compile("|".join(["[^\\x00-\\u024f\\u2010-\\u2027]", *map(re.escape, special)]))

    def ids(self, text: str) -> np.ndarray:
        if not self.fast or self.other.search(text):
            return np.array(self.own.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")


PIECES = T.StructType([
    T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("task", T.IntegerType()), T.StructField("slot", T.LongType()),
])


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Start and length of the pieces of a document of ``n`` tokens; all but the first are full."""
    first = (n - 1) % capacity + 1 if n else 0
    yield 0, first
    for start in range(first, n, capacity):
        yield start, capacity


def pieces(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of each document; ``slot`` numbers a task's pieces of one length."""
    out = T.StructType([*df.select(id_col).schema.fields, *PIECES.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, types, task, slots = Tokenizer(path, pattern), to_arrow_schema(out), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part, rows = batch.slice(at, SLICE_ROWS), []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.append(tokenizer.ids(text or ""), np.uint32(end_id)).astype("<u4")
                    for i, (start, length) in enumerate(cut(len(ids), capacity)):
                        rows.append((key, i, start, length, zlib.crc32(ids[start : start + length].tobytes()), task, slots[length]))
                        slots[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * len(types), types)], schema=types)

    return df.select(df[id_col], df[text_col]).mapInArrow(run, out)


PLACE = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


class Places:
    """A plan as sorted arrays: the run of a piece is the last of its length that begins at its rank or before."""

    def __init__(self, runs: list[Run]) -> None:
        runs = sorted(runs)  # by length, then by first rank
        table = np.array(runs, np.int64).reshape(-1, len(Run._fields))
        self.length, self.first, _, self.copies, self.sequence, self.offset = map(np.ascontiguousarray, table.T)
        self.begin = {w: i for i, w in reversed(list(enumerate(self.length.tolist())))}
        self.end = {w: i + 1 for i, w in enumerate(self.length.tolist())}

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequences and offsets of pieces."""
        run = np.empty(len(rank), np.int64)
        for w in np.unique(length):
            here = length == w
            begin = self.begin[w]
            run[here] = begin - 1 + np.searchsorted(self.first[begin : self.end[w]], rank[here], "right")
        at = rank - self.first[run]
        return self.sequence[run] + at // self.copies[run], self.offset[run] + at % self.copies[run] * length


def pack(found: DataFrame, capacity: int) -> DataFrame:
    """Sequence and offset for each row of :func:`pieces`, which must be a written table (its slots must not change)."""
    counts = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row for each length at most
    runs = plan(counts, capacity)  # goes to the tasks; its size follows from the capacity alone
    tasks = found.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    kept = [c for c in found.columns if c not in ("task", "slot")]
    ranked = found.join(tasks, ["task", "length"]).select(*kept, (F.col("before") + F.col("slot")).alias("__rank"))
    out, at = T.StructType([*found.select(*kept).schema.fields, *PLACE.fields]), kept.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, types = Places(runs), to_arrow_schema(out)
        for batch in batches:
            length, rank = batch.column(at).to_numpy(), batch.column(len(kept)).to_numpy()
            columns = [batch.column(i).cast(types.field(i).type) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, places.of(length, rank))], schema=types)

    return ranked.mapInArrow(place, out)


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Pack the tokens of all documents into as few sequences as it can."""
    import public_tokenizers as public

    found = pieces(df, id_col, text_col, path or public.path("byte_bpe_50k.json"), pattern or public.PATTERN, capacity, end_id)
    return pack(settle(found, "pieces"), capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 1024 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
