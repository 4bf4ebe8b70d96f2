"""Periodic runs in texts, by the runs theorem.

A run is a maximal stretch of words with a period that it holds at least twice.  By the
theorem every run has Lyndon roots (all but one at its very start) that are the longest Lyndon words at their starts under one of the
two orders of the alphabet, and those end where the inverse suffix array next has a smaller value (a
larger one for the other order).  So for each word there are two candidates for a root;
those that stand twice in a row are extended to both sides by their longest common
extensions, which a sparse table over the LCP array gives in constant time.

Texts are independent of each other: each is worked on within its task, small ones
many at a time with words numbered apart, so that nothing is common to two texts; a long one takes
memory in proportion to n log n of its own words.

Cases: null, empty and blank texts have no words and no runs; a text that is one word over and over is
one run; runs may overlap; repeated rows give the same rows; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import table

#: Words that are worked on at once, and the texts that hold them at most.
BATCH_WORDS, BATCH_ROWS = 1 << 16, 2_048


class Run(NamedTuple):
    start: int
    length: int
    period: int


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ranks of all suffixes (shorter ones first among equals), and for each power of two the ranks of prefixes of that length.

    Prefix doubling; only suffixes that still share a rank are sorted again.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(n, np.int64)
    held = symbols[order]
    begins = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
    sizes = np.diff(np.r_[begins, n])
    rank[order] = np.repeat(begins, sizes)
    levels, step = [rank.astype(np.int32)], 1
    open_ = order[np.repeat(sizes > 1, sizes)]  # those that share their rank, in the order of ranks
    while len(open_):
        after = open_ + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        first = rank[open_]
        by = np.argsort(first * (n + 1) + second, kind="stable")
        open_, first, second = open_[by], first[by], second[by]
        new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        group = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
        # The place within the old group, as of the begin of the new one.
        place = np.arange(len(open_)) - np.repeat(group, np.diff(np.r_[group, len(open_)]))
        begins = np.flatnonzero(new)
        sizes = np.diff(np.r_[begins, len(open_)])
        rank[open_] = first + np.repeat(place[begins], sizes)
        open_ = open_[np.repeat(sizes > 1, sizes)]
        step *= 2
        levels.append(rank.astype(np.int32))
    return rank.astype(np.int32), levels[:-1] or levels


def common_prefixes(rank: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The LCP array: at each place of the suffix array, words in common with the suffix before it."""
    n = len(rank)
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    lcp = np.zeros(n, np.int32)
    at = np.arange(1, n)
    a, b = suffixes[:-1].copy(), suffixes[1:].copy()
    for k in reversed(range(len(levels))):
        inside = (a < n) & (b < n)
        same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        if same.any():
            lcp[at[same]] += 1 << k
            a[same] += 1 << k
            b[same] += 1 << k
    return lcp


class Minima:
    """Sparse table: the least value of any stretch from two overlapping powers of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [values]
        width = 1
        while 2 * width <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Least values from ``first`` to ``last``, both included."""
        size = last - first + 1
        level = np.frexp(size.astype(float))[1] - 1
        out = np.empty(len(first), self.rows[0].dtype)
        for k in np.unique(level):
            here = level == k
            out[here] = np.minimum(self.rows[k][first[here]], self.rows[k][last[here] - (1 << int(k)) + 1])
        return out

    def next_smaller(self, most: int) -> np.ndarray:
        """For each place, how far on the next smaller value is, or any number above ``most`` where it is farther."""
        values = self.rows[0]
        n = len(values)
        at = np.arange(1, n + 1)
        for k in reversed(range(min(len(self.rows), int(most).bit_length()))):
            row = self.rows[k]
            inside = at < len(row)
            skip = inside & (row[np.minimum(at, len(row) - 1)] > values)
            at += skip.astype(at.dtype) << k
        return at - np.arange(n)


def find_runs(symbols: np.ndarray, longest: int | None = None, times: int = 3) -> np.ndarray:
    """Start, length and period of each run that holds its period at least ``times`` (three or more) times, by start.

    Periods are at most a ``times``-th of ``longest``, the length of the longest text in ``symbols``.
    """
    if times < 3:
        raise ValueError("a root must stand twice in a row behind the run's start, so times must be 3 or more")
    n = len(symbols)
    none = np.empty((0, 3), np.int64)
    most = (n if longest is None else longest) // times
    if most < 1:
        return none
    rank, levels = suffix_order(symbols)
    starts, periods = [], []
    for ranks in (rank, (n - 1 - rank).astype(np.int32)):
        period = Minima(ranks).next_smaller(most)
        at = np.flatnonzero((period <= most) & (np.arange(n) + 2 * period <= n))
        p = period[at]
        # Most candidates end here: the first and the last word of a root stand again a period later.
        again = (symbols[at] == symbols[at + p]) & (symbols[at + p - 1] == symbols[at + 2 * p - 1])
        starts.append(at[again])
        periods.append(p[again])
    start, period = np.concatenate(starts), np.concatenate(periods)
    if not len(start):
        return none
    lcp = Minima(common_prefixes(rank, levels))
    del levels

    def extension(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words in common from ``a`` and from ``b`` on."""
        x, y = rank[a], rank[b]
        return lcp.least(np.minimum(x, y) + 1, np.maximum(x, y))

    ahead = extension(start, start + period)
    start, period, ahead = start[ahead >= period], period[ahead >= period], ahead[ahead >= period]
    # Roots of one run have its end and period in common; its first root is extended to the left.
    end = start + period + ahead
    order = np.lexsort((start, period, end))
    start, period, end = start[order], period[order], end[order]
    first = np.r_[True, (end[1:] != end[:-1]) | (period[1:] != period[:-1])][: len(start)]
    start, period, end = start[first], period[first], end[first]
    # The farthest words to the left from which the common extension reaches the root.
    low, high = np.zeros(len(start), np.int64), start.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        reaches = (middle == 0) | (extension(start - middle, start - middle + period) >= middle)
        low, high = np.where(reaches, middle, low), np.where(reaches, high, middle - 1)
    start = start - low
    out = np.stack([start, end - start, period], axis=1)[end - start >= times * period] if len(start) else none
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def kept_words(n: int, runs: Sequence[Run]) -> np.ndarray:
    """Whether each word is outside of all runs, or within the first period of each that holds it."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:-1]) == 0


def words_of(text: str | None) -> list[bytes]:
    """Stretches without ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def texts_runs(texts: Sequence[list[bytes]], least: int = 24, times: int = 3) -> list[list[Run]]:
    """Runs of each text, given as words; all are worked on at once."""
    sizes = [len(t) for t in texts]
    symbols, base = np.empty(sum(sizes), np.int64), 0
    begins = np.cumsum([0, *sizes])
    for words, begin in zip(texts, begins):
        seen: dict[bytes, int] = {}
        symbols[begin : begin + len(words)] = [seen.setdefault(w, len(seen)) for w in words]
        symbols[begin : begin + len(words)] += base
        base += len(seen)
    out: list[list[Run]] = [[] for _ in texts]
    found = find_runs(symbols, max(sizes, default=0), times)
    found = found[found[:, 1] >= least]
    for text, (start, length, period) in zip(np.searchsorted(begins, found[:, 0], "right") - 1, found.tolist()):
        out[text].append(Run(start - int(begins[text]), length, period))
    return out


RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in Run._fields])
FIELDS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())])


def periodic_runs(df: DataFrame, keep: Sequence[str], text_col: str, least: int = 24, times: int = 3, edit: Callable[[tuple, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """The columns ``keep`` with ``n_words``, the ``runs`` of at least ``least`` words and ``times`` periods, and the text ``collapsed``: all runs cut to their first period.

    ``edit`` may change a text's words beforehand, given the row's ``keep`` values.
    """
    kept = df.select(*keep).schema
    out = T.StructType([*kept.fields, *FIELDS.fields])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(out)
        rows: list[tuple] = []
        texts: list[list[bytes]] = []

        def done() -> pa.RecordBatch:
            found = texts_runs(texts, least, times)
            made = []
            for words, runs in zip(texts, found):
                if runs:
                    words = [w for w, k in zip(words, kept_words(len(words), runs).tolist()) if k]
                made.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            columns = [*(zip(*rows) if n else []), [len(t) for t in texts], [[r._asdict() for r in runs] for runs in found], made]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types)], schema=types)

        held = 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = tuple(batch.column(k)[i].as_py() for k in range(n))
                words = words_of(batch.column(n)[i].as_py())
                words = edit(row, words) if edit else words
                if rows and (held + len(words) > BATCH_WORDS or len(rows) >= BATCH_ROWS):
                    yield done()
                    rows, texts, held = [], [], 0
                rows.append(row)
                texts.append(words)
                held += len(words)
        if rows:
            yield done()

    return df.select(*[df[c] for c in keep], df[text_col].alias("__text")).mapInArrow(run, out)


def longest(runs: Column) -> Column:
    """The run with the greatest exact length for its period; of equals the first, then that of the shorter period."""
    # Runs stand by start and period, so a later one must be greater.
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, r: F.when(better(best, r), r).otherwise(best))


def damage(row: tuple, words: list[bytes]) -> list[bytes]:
    """The query's change to every tenth document: from some word on, a stretch of words over and over."""
    h = zlib.crc32(str(row[0]).encode()) if row[0] is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all ``documents``, of which every tenth is made to repeat itself; a row without an id isn't changed."""
    found = periodic_runs(table(spark, sf_dir, "documents"), ["doc_id"], "text", edit=damage)
    best = longest(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "n_words", best.alias("best"), lines.alias("lines"), "collapsed").select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.encode("lines", "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"), "n_words",
    )
