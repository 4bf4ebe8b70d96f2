"""Mixture-controlled packing: deficit round-robin over the queues of sources fills each sequence to target proportions.

The documents of a source stand in a queue, end to end, and a sequence (window) takes
the next tokens of each queue.  How far each queue has come at the boundary of a block
of windows follows from the targets alone (:class:`Mixture`): every task finds it by
bisection, with the deficits that are carried into the block, so blocks don't wait for
each other.  Within a block, windows are filled one after another: each adds its quantum to the
deficits, queues are served round robin while their deficit is worth a visit, what is
left of a window goes to those with the largest deficits, and deficits are carried
to the next window.

Tokens are made once and written with their document's place in its task's part of the
queue; documents are then cut at block boundaries and each block's share, bounded by the
size of a block, is brought together.  What is left after the last full window fills
sequences whose sizes are powers of two, so nothing is padded.

Cases: a null or empty text is the end token alone; a null source is a source of its own;
beyond ``most_queues`` sources, the smallest share one queue; a source that runs
out leaves its part to the others; repeated rows are documents of their own; an
empty table has no sequences.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SLICE_ROWS, settle, table
from .packing import byte_of

#: Windows of a block; with 2048 tokens each, a block has 2 million tokens, or 4 MB of short identifiers.
BLOCK = 1_024
#: A queue is visited when its deficit has so many tokens, so that small sources give whole stretches now and then instead of a few tokens each time.
VISIT = 64


# -- the schedule -----------------------------------------------------------


class Mixture:
    """How far each queue has come after so many tokens in all, for queues of ``totals`` tokens with integer ``weights``.

    At time t a queue has given ``floor(weight * t + 1/2)`` tokens, all of them at most; time is
    counted in steps, several for each token of the fastest queue.  Where several queues give a token in one step, those that come first
    are served first, so that any number of tokens can be reached, and never fewer than for a smaller number.
    """

    def __init__(self, totals: Sequence[int], weights: Sequence[int]) -> None:
        self.totals, self.weights, self.total = list(totals), list(weights), sum(totals)
        self.steps = 1 << max(self.weights, default=1).bit_length() + 4  # in a unit of time, in which each queue gives its weight
        # By the last step every queue is done.
        self.last = max((-(-n * self.steps // w) for n, w in zip(self.totals, self.weights)), default=0)
        self.known: dict[int, list[int]] = {}

    def given(self, step: int) -> list[int]:
        half = self.steps // 2
        return [min(n, (w * step + half) // self.steps) for n, w in zip(self.totals, self.weights)]

    def at(self, tokens: int) -> list[int]:
        """Tokens that each queue has given after ``tokens`` in all."""
        if (found := self.known.get(tokens)) is not None:
            return found
        low, high = 0, self.last  # given(low) <= tokens < given(high), or all is given
        if tokens >= self.total:
            out = list(self.totals)
        else:
            while high - low > 1:
                middle = (low + high) // 2
                if sum(self.given(middle)) <= tokens:
                    low = middle
                else:
                    high = middle
            out, after = self.given(low), self.given(low + 1)
            left = tokens - sum(out)
            for i, most in enumerate(after):
                more = min(left, most - out[i])
                out[i], left = out[i] + more, left - more
        if len(self.known) >= 4096:
            self.known.clear()
        self.known[tokens] = out
        return out

    def block_of(self, queue: int, position: int, block: int) -> int:
        """The block of ``block`` tokens in which a queue gives its token at ``position``."""
        low, high = 0, -(-self.total // block)  # at(low * block)[queue] <= position < at(high * block)[queue]
        # Queues drain in proportion unless weights differ from their totals, so a guess is often right.
        guess = position * high // self.totals[queue]
        for g in (guess, guess + 1):
            if low < g < high:
                if self.at(g * block)[queue] <= position:
                    low = g
                else:
                    high = g
        while high - low > 1:
            middle = (low + high) // 2
            if self.at(middle * block)[queue] <= position:
                low = middle
            else:
                high = middle
        return low


def windows_of(total: int, capacity: int, first: int, count: int) -> list[int]:
    """Sizes of the windows of one block: full ones, and powers of two for what is left after the last full one."""
    full, rest = divmod(total, capacity)
    sizes = [capacity] * max(0, min(count, full - first))
    if first <= full < first + count:
        sizes += [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
    return sizes


def fill(sizes: Sequence[int], quotas: np.ndarray, deficits: np.ndarray, visit: int = VISIT) -> Iterator[list[tuple[int, int]]]:
    """For each window, the queues in the order in which they are served, with the tokens each gives.

    ``quotas`` add up to the windows' sizes; each queue gives exactly its quota in all.
    """
    left, room = quotas.astype(np.int64).copy(), int(sum(sizes))
    quantum = quotas / max(1, room)
    deficits, turn, n = deficits.astype(float).copy(), 0, len(quotas)
    for size in sizes:
        deficits += quantum * size
        take = np.minimum(np.floor(deficits + 1e-9).astype(np.int64), left)
        take[take < np.minimum(visit, left)] = 0
        np.maximum(take, 0, out=take)
        order = np.roll(np.arange(n), -turn)
        # Served round robin from the queue after the last window's first, until the window is full.
        before = np.cumsum(take[order]) - take[order]
        take[order] = np.clip(size - before, 0, take[order])
        short = size - int(take.sum())
        # Deficits below a visit's worth fill the window, the largest first; then the longest queues run into debt.
        for most, order_of in ((np.maximum(0, np.floor(deficits - take)).astype(np.int64), -(deficits - take)), (left, take - left)):
            for q in np.argsort(order_of, kind="stable") if short else ():
                more = min(short, int(min(most[q], left[q] - take[q])))
                take[q], short = take[q] + more, short - more
        left -= take
        deficits -= take
        yield [(int(q), int(take[q])) for q in order if take[q]]
        turn = (turn + 1) % n


# -- tokens -----------------------------------------------------------------


#: Pieces of the tokenizer file, as its pattern gives them, for texts of plain characters: letters, one number, or signs.
LETTERS, NUMBERS, SPACE = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ", r"0-9\xb2\xb3\xb9\xbc-\xbe", r" \t\n\r\f\v\xa0"
PIECE = f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{LETTERS}{NUMBERS}{SPACE}]+"
#: Any but the characters that every library version treats alike in normal form, lower case and class.
OTHER = r"[^\t\n\r\f\v\x20-\x7e\xa0-įı-ſ‐-‧]"
#: The normaliser and splitter that the pattern stands for; fixed values of the file format.
NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Words, and pieces, whose identifiers a worker remembers at most; when there are more it begins anew.
REMEMBERED = 800_000


@lru_cache(maxsize=2)
def tokenizer_of(path: str) -> WordTokenizer:
    """One tokenizer for all tasks of a worker, with what it remembers."""
    return WordTokenizer(path)


class WordTokenizer:
    """Identifiers as the tokenizer file's own library gives them, without added special tokens.

    Where the file is a byte-pair model over lower-case words, white space ends a piece and pieces don't depend on what stands around them:
    words are remembered, and pieces of new words are merged once by the library's model and remembered.
    A word with an uncommon character or a special token's string goes through the whole library by
    itself; any other file takes the library for whole texts.
    """

    def __init__(self, path: str) -> None:
        import tokenizers

        self.own = tokenizers.Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        self.size = max(self.own.get_vocab_size(), 1)
        self.dtype = "<u2" if self.size <= 1 << 16 else "<u4"
        first = (data.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        self.pack = lambda *ids: struct.pack(f"<{len(ids)}{'H' if self.dtype == '<u2' else 'I'}", *ids)
        self.words = data.get("normalizer") == NORMAL and first.get("pattern") == {"Regex": SPLIT} and not data["model"].get("dropout") and not data.get("post_processor")
        special = [re.escape(t["content"]) for t in data.get("added_tokens", [])]
        self.other = re.compile("|".join([OTHER, *special]))
        self.find = re.compile(PIECE).findall
        self.to_chars = {b: c for c, b in byte_of().items()}
        self.seen: dict[str, bytes] = {}  # by piece
        self.met: dict[bytes, bytes] = {}  # by word, as it stands between ASCII white space

    def piece(self, piece: str) -> bytes:
        got = self.seen.get(piece)
        if got is None:
            tokens = self.own.model.tokenize(piece.encode().decode("latin1").translate(self.to_chars))
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            got = self.seen[piece] = self.pack(*[t.id for t in tokens])
        return got

    def word(self, word: bytes) -> bytes:
        text = word.decode()
        got = self.whole(text) if self.other.search(text) else b"".join(map(self.piece, self.find(text.lower())))
        if len(self.met) >= REMEMBERED:
            self.met.clear()
        self.met[word] = got
        return got

    def whole(self, text: str) -> bytes:
        return np.array(self.own.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def ids(self, text: str) -> bytes:
        """The identifiers, as little-endian numbers of :attr:`dtype`."""
        if not self.words:
            return self.whole(text)
        known = self.met
        return b"".join([known.get(w) or self.word(w) for w in text.encode().split()])


def tokens(df: DataFrame, id_col: str, text_col: str, source_col: str, path: str, end_id: int) -> DataFrame:
    """Identifiers of each document, with its place (``slot``) in the part of its source's queue that its task holds."""
    key = df.select(id_col).schema[0]
    out = T.StructType([
        T.StructField("key", key.dataType), T.StructField("source", df.schema[source_col].dataType), T.StructField("task", T.IntegerType()),
        T.StructField("slot", T.LongType()), T.StructField("n", T.LongType()), T.StructField("width", T.IntegerType()), T.StructField("ids", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, types, task, slots = tokenizer_of(path), to_arrow_schema(out), TaskContext.get().partitionId(), {}
        dtype = tokenizer.dtype if end_id < 1 << 16 else "<u4"
        end, width = np.array([end_id], dtype).tobytes(), np.dtype(dtype).itemsize
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                sources, begins, sizes, ids = part.column(1).to_pylist(), [], [], []
                for source, text in zip(sources, part.column(2).to_pylist()):
                    made = tokenizer.ids(text or "")
                    if dtype != tokenizer.dtype:
                        made = np.frombuffer(made, tokenizer.dtype).astype(dtype).tobytes()
                    ids.append(made + end)
                    sizes.append(len(ids[-1]) // width)
                    begins.append(slots.get(source, 0))
                    slots[source] = begins[-1] + sizes[-1]
                n = part.num_rows
                columns = [part.column(0), part.column(1), [task] * n, begins, sizes, [width] * n, ids]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, types)], schema=types)

    return df.select(df[id_col], df[source_col], df[text_col]).mapInArrow(run, out)


# -- packing ----------------------------------------------------------------


def pack_mixture(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = 2048, end_id: int = 1, path: str | None = None,
    weights: dict | None = None, most_queues: int = 1_000, block: int = BLOCK, visit: int = VISIT,
) -> DataFrame:
    """Pack the tokens of all documents so that every sequence holds the sources in the target proportions.

    ``weights`` names a positive integer for sources (others get 1), by which they are mixed until
    one runs out; without them the targets are the sources' own numbers of tokens, and all run out together.
    Returns a row for each piece with its ``queue``.
    """
    import public_tokenizers as public

    found = settle(tokens(df, id_col, text_col, source_col, path or public.path("word_bpe_49k.json"), end_id), "tokens")
    parts = found.groupBy("task", "source").agg(F.sum("n").alias("n"))
    sources = parts.groupBy("source").agg(F.sum("n").alias("n"))
    # One row for each of the largest sources, and one for all others.
    top = sources.orderBy(F.desc("n"), "source").limit(most_queues - 1).collect()
    everything = sources.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    totals, rest = [r.n for r in top], everything - sum(r.n for r in top)
    mixture = Mixture(totals + [rest] * (rest > 0), [(weights.get(r.source, 1) if weights else r.n) for r in top] + [weights.get("*", 1) if weights else rest] * (rest > 0))
    queues = df.sparkSession.createDataFrame([(r.source, i) for i, r in enumerate(top)], T.StructType([T.StructField("named", df.schema[source_col].dataType), T.StructField("queue", T.IntegerType())]))
    numbered = parts.join(F.broadcast(queues), F.col("source").eqNullSafe(F.col("named")), "left").select("task", "source", "n", F.coalesce("queue", F.lit(len(top))).alias("queue"))
    before = Window.partitionBy("queue").orderBy("task", "source").rowsBetween(Window.unboundedPreceding, -1)
    offsets = numbered.select(F.col("task").alias("of_task"), F.col("source").alias("of_source"), "queue", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # Written, so that its size is known before it is joined: below Spark's threshold it goes to the documents, and they needn't move.
    offsets = settle(offsets, "offsets")
    placed = found.join(offsets, (F.col("task") == F.col("of_task")) & F.col("source").eqNullSafe(F.col("of_source")))
    placed = placed.select("key", "source", "n", "width", "ids", "queue", (F.col("before") + F.col("slot")).alias("position"))
    return filled(shares(placed, mixture, block * capacity), mixture, capacity, block, visit, id_col)


def shares(placed: DataFrame, mixture: Mixture, size: int) -> DataFrame:
    """Documents cut at block boundaries: ``block``, and the part of the document (``start``, ``ids``) that stands in it."""
    fields = placed.schema
    out = T.StructType([T.StructField("block", T.LongType()), *[fields[c] for c in ("queue", "position", "key", "source")], T.StructField("start", T.LongType()), fields["n"], fields["width"], fields["ids"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, mix = to_arrow_schema(out), Mixture(mixture.totals, mixture.weights)
        last: dict[int, tuple[int, int, int]] = {}  # for each queue, the block met last and its bounds
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                rows, part = [], batch.slice(at, SLICE_ROWS).to_pylist()
                for r in part:
                    queue, position, start, width = r["queue"], r["position"], 0, r["width"]
                    while start < r["n"]:
                        number, begin, end = last.get(queue, (0, 0, 0))
                        if not begin <= position + start < end:
                            number = mix.block_of(queue, position + start, size)
                            begin, end = mix.at(number * size)[queue], mix.at((number + 1) * size)[queue]
                            last[queue] = number, begin, end
                        stop = min(r["n"], end - position)
                        rows.append((number, queue, position + start, r["key"], r["source"], start, r["n"], width, r["ids"][start * width : stop * width]))
                        start = stop
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * len(types), types)], schema=types)

    return placed.mapInArrow(run, out)


def filled(cut: DataFrame, mixture: Mixture, capacity: int, block: int, visit: int, id_col: str) -> DataFrame:
    """The pieces of each block: its windows are filled in order, and each queue's documents laid along what it gives."""
    of, kept = cut.schema, {"key": id_col}
    out = T.StructType([
        T.StructField(kept["key"], of["key"].dataType), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")], T.StructField("queue", T.IntegerType()),
    ])

    def run(group: pa.Table) -> pa.Table:
        number = group.column("block")[0].as_py()
        mix, first = Mixture(mixture.totals, mixture.weights), number * block
        begin, end = np.array(mix.at(first * capacity)), np.array(mix.at((first + block) * capacity))
        ideal = np.minimum(mix.totals, np.array(mix.weights, float) * lasting(mix, first * capacity))
        group = group.sort_by([("queue", "ascending"), ("position", "ascending")])
        queue, position = group.column("queue").to_numpy(), group.column("position").to_numpy()
        start, total = group.column("start").to_numpy(), group.column("n").to_numpy()
        width, ids = group.column("width")[0].as_py(), group.column("ids").to_pylist()
        dtype = "<u2" if width == 2 else "<u4"
        # Next document of each queue, and how much of it is used.
        at, used, taken = np.searchsorted(queue, np.arange(len(begin))).tolist(), [0] * len(begin), []
        sizes = windows_of(mix.total, capacity, first, block)
        for w, served in enumerate(fill(sizes, end - begin, ideal - begin, visit)):
            offset = 0
            for q, want in served:
                while want:
                    i, u = at[q], used[q]
                    have = len(ids[i]) // width - u
                    take = min(want, have)
                    piece = ids[i][u * width : (u + take) * width]
                    crc = zlib.crc32(np.frombuffer(piece, dtype).astype("<u4").tobytes())
                    taken.append((i, int(start[i]) + u, take, crc, first + w, offset, q))
                    offset, want = offset + take, want - take
                    at[q], used[q] = (i + 1, 0) if take == have else (i, u + take)
        index = [t[0] for t in taken]
        columns = [group.column("key").take(pa.array(index, pa.int64())), *[[t[k] for t in taken] for k in (1, 2, 3)], total[index] if taken else [], *[[t[k] for t in taken] for k in (4, 5, 6)]]
        types = to_arrow_schema(out)
        return pa.table([c.cast(f.type) if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(columns, types)], schema=types)

    return cut.groupBy("block").applyInArrow(run, out)


def lasting(mixture: Mixture, tokens: int) -> float:
    """The time at which so many tokens are given, queues that run out leaving their part to the others."""
    ends = sorted(((n / w, n, w) for n, w in zip(mixture.totals, mixture.weights)))
    active, done, t = float(sum(mixture.weights)), 0.0, 0.0
    for end, _, w in ends:
        if done + active * (end - t) >= tokens:
            break
        done, t, active = done + active * (end - t), end, active - w
    return t + (tokens - done) / active if active > 0.5 else t


def op11_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 2048 tokens, each with the corpus' proportions of the sources."""
    return pack_mixture(table(spark, sf_dir, "documents"))
