"""Quality rules: counted rules, and a calibrated logistic regression on hashed word and character n-grams.

Features of a text are the relative frequencies of its hashed word 1- and
2-grams and 4-grams of characters (code points), of the whole text.  Weights are
learned from labelled quality rows on the driver, from a sample of at most about
``TRAIN_ROWS`` rows with at most ``TRAIN_ENTRIES`` features; a part of the sample
that the weights haven't seen calibrates the probability (Platt scaling).  Scoring
sums weights in Arrow batches, no matrix is built.

Cases: null and empty texts have no words and fail the rules; texts of any length
are read whole, and blocks of fixed size lose no n-gram between them; without
usable labels the rules alone decide; identifiers labelled both ways are left out
of the sample, and of several texts with one identifier the least by digest is
taken; equal texts have equal results; rows may repeat.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import filter_text, map_text, sampled_texts, scratch, settle, settled_labels, table
from .shingles import GOLD, mix, word_blocks, word_hashes

#: Bounds of the labelled rows that the regression is fitted on, and of their features in all.
TRAIN_ROWS, TRAIN_ENTRIES = 2_000, 12_000_000
BITS = 16
#: Offsets of the three kinds of n-gram in the table of weights.
WORDS, PAIRS, CHARACTERS = 0, 1 << BITS, 2 << BITS
SIZE = 3 << BITS
#: Characters looked at together.
CHARACTERS_AT_ONCE = 1 << 18
#: Calibrated probability of good quality from which a text is kept, and the limits of the rules.
KEEP, LEAST_WORDS, MOST_REPEATED = 0.3, 50, 50
SYMBOLS = b"#*$%&|<>"


def rule_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, and words in 3-word windows that occur again."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode()
    words = data.split()  # at ASCII space only
    chars = len(text) - len(data) + sum(map(len, words))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:]))
        counts = Counter(windows)
        if len(counts) < len(windows):
            last = -1  # the last word that is counted
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeated += i + 2 - max(last, i - 1)
                    last = i + 2
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def fails_rules(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED * n_words


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Indices of a text's n-grams in the table of weights, one kind at a time."""
    if not text:
        return
    shift, last = np.uint64(64 - BITS), np.zeros(0, np.uint64)
    for block in word_blocks(text.encode()):
        _, h = word_hashes(block)
        if len(h):
            yield (h >> shift).astype(np.int64) + WORDS
            h = np.concatenate([last, h])
            if len(h) > 1:
                yield (mix(h[:-1] * GOLD + h[1:]) >> shift).astype(np.int64) + PAIRS
            last = h[-1:]
    for at in range(0, len(text) - 3, CHARACTERS_AT_ONCE):
        c = np.frombuffer(text[at : at + CHARACTERS_AT_ONCE + 3].encode("utf-32-le", "surrogatepass"), np.uint32)
        four = ((c[:-3] * np.uint32(0x01000193) + c[1:-2]) * np.uint32(0x01000193) + c[2:-1]) * np.uint32(0x01000193) + c[3:]
        four ^= four >> np.uint32(15)
        yield ((four * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64) + CHARACTERS


def kind(index: np.ndarray) -> int:
    return int(index[0]) >> BITS


class Model(NamedTuple):
    weights: np.ndarray  # float32, SIZE
    bias: float
    scale: float  # of Platt's calibration
    shift: float
    fitted: bool

    def logit(self, text: str | None) -> float:
        sums, counts = np.zeros(3), np.zeros(3)
        for index in grams(text):
            k = kind(index)
            sums[k] += self.weights[index].sum(dtype=np.float64)
            counts[k] += len(index)
        return self.bias + float((sums / np.maximum(counts, 1)).sum())

    def probability(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * self.logit(text) + self.shift, -30, 30))))

    def keeps(self, text: str | None) -> bool:
        return not self.fitted or self.probability(text) >= KEEP


SAMPLE = T.StructType([T.StructField("index", T.ArrayType(T.IntegerType())), T.StructField("value", T.ArrayType(T.FloatType()))])


def sparse(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's features: indices and relative frequencies."""
    count: dict[int, np.ndarray] = {}
    for index in grams(text):
        k = kind(index)
        count[k] = count.get(k, 0) + np.bincount(index - (k << BITS), minlength=1 << BITS)
    index = [np.flatnonzero(c) for c in count.values()]
    values = [c[i] / c.sum() for c, i in zip(count.values(), index)]
    if not index:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    return np.concatenate([i + (k << BITS) for k, i in zip(count, index)]).astype(np.int32), np.concatenate(values).astype(np.float32)


class Sample(NamedTuple):
    """Rows of a sparse matrix: each row's entries lie between two of ``bounds``."""

    index: np.ndarray  # int32
    value: np.ndarray  # float32
    bounds: np.ndarray
    label: np.ndarray
    held: np.ndarray

    def rows(self, w: np.ndarray, bias: float, a: int, z: int) -> np.ndarray:
        """Log odds of the rows from ``a`` to ``z``."""
        part = slice(self.bounds[a], self.bounds[z])
        terms = self.value[part] * w[self.index[part]]
        return np.bincount(self.owner(a, z), terms, z - a) + bias

    def owner(self, a: int, z: int) -> np.ndarray:
        return np.repeat(np.arange(z - a), np.diff(self.bounds[a : z + 1]))


def fit(sample: Sample, epochs: int = 150, rate: float = 2.0, decay: float = 1e-6, at_once: int = 256) -> Model:
    """Logistic regression by full AdaGrad steps on the rows that aren't held, calibrated on those that are.

    Gradients are summed over blocks of ``at_once`` rows, so nothing but the sample itself grows with it.
    """
    y, fits = sample.label.astype(float), ~sample.held
    if min(len(set(y[fits])), len(set(y[sample.held]))) < 2:
        return Model(np.zeros(SIZE, np.float32), 0.0, 1.0, 0.0, False)
    # Both classes weigh the same; rows held back weigh nothing.
    each = np.where(fits, np.where(y == 1, 0.5 / (y[fits] == 1).sum(), 0.5 / (y[fits] == 0).sum()), 0.0)
    w, bias, seen, seen_bias = np.zeros(SIZE, np.float32), 0.0, np.full(SIZE, 1e-8, np.float32), 1e-8
    blocks = [(a, min(len(y), a + at_once)) for a in range(0, len(y), at_once)]
    for _ in range(epochs):
        gradient, slope = decay * w.astype(np.float64), 0.0
        for a, z in blocks:
            error = (1 / (1 + np.exp(-np.clip(sample.rows(w, bias, a, z), -30, 30))) - y[a:z]) * each[a:z]
            part = slice(sample.bounds[a], sample.bounds[z])
            gradient += np.bincount(sample.index[part], sample.value[part] * error[sample.owner(a, z)], SIZE)
            slope += error.sum()
        seen += (gradient**2).astype(np.float32)
        w -= (rate * gradient / np.sqrt(seen)).astype(np.float32)
        seen_bias += slope**2
        bias -= 0.1 * slope / np.sqrt(seen_bias)
    z = np.concatenate([sample.rows(w, bias, a, z) for a, z in blocks])[sample.held]
    return Model(w, float(bias), *platt(z, y[sample.held]), True)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of log odds ``z`` towards labels, by Newton's method with Platt's smoothed targets."""
    good, bad = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x, beta = np.column_stack([z, np.ones(len(z))]), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * np.maximum(p * (1 - p), 1e-9)[:, None]) + 1e-6 * np.eye(2), x.T @ (target - p))
        beta += np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, entries: int = TRAIN_ENTRIES) -> Model:
    """Fit on about ``rows`` labelled documents, chosen by hash of their id, a third of them for the calibration."""
    usable = settled_labels(labels, "quality")
    part = min(1.0, rows / max(1, usable.count()))
    usable = usable.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < int(part * 1_000_003) + 1)
    found = sampled_texts(docs, usable)

    def start():
        return lambda texts: list(zip(*map(sparse, texts))) or [[], []]

    made = map_text(found.withColumn("held", F.pmod(F.xxhash64(F.lit("held"), "id"), F.lit(3)) == 0), start, "text", ["id", "quality", "held"], SAMPLE)
    with scratch(docs.sparkSession):
        made = settle(made, "quality-sample")
        # One row of two numbers for each of the bounded sample's rows.
        so_far = F.sum(F.size("index")).over(Window.orderBy(F.xxhash64(F.lit("order"), "id"), "id"))
        few = made.select("id", so_far.alias("so_far")).where(F.col("so_far") <= entries).select("id")
        sample = collect(made.join(F.broadcast(few), "id"))
    return fit(sample)


def collect(made: DataFrame) -> Sample:
    """The bounded sample on the driver, in the order of ids, so that equal tables give equal models."""
    got = made.orderBy("id").toArrow()
    lists = {c: got.column(c).chunks for c in ("index", "value")}
    whole = {c: np.concatenate([x.flatten().to_numpy() for x in chunks] or [np.zeros(0, np.float32)]) for c, chunks in lists.items()}
    sizes = [pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in lists["index"]]
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes or [[]]))]).astype(np.int64)
    sample = Sample(whole["index"].astype(np.int32), whole["value"], bounds, got.column("quality").to_numpy(), got.column("held").to_numpy().astype(bool))
    del got, lists
    pa.default_memory_pool().release_unused()
    return sample


RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()), T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()), T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
    T.StructField("quality_score", T.DoubleType()), T.StructField("kept", T.BooleanType()),
])


def judge(df: DataFrame, keep: list[str], text_col: str, model: Model) -> DataFrame:
    """Rule counts, calibrated score and verdict of each text."""

    def start():
        def one(text):
            counts = rule_counts(text)
            failed, p = fails_rules(counts[0], counts[4]), model.probability(text)
            return *counts, failed, p, not failed and (not model.fitted or p >= KEEP)

        return lambda texts: list(zip(*map(one, texts))) or [[]] * 8

    return map_text(df, start, text_col, keep, RESULT)


def drop_poor(df: DataFrame, text_col: str, model: Model) -> DataFrame:
    """The rows that rules and model keep, with all their columns."""

    def start():
        def good(text):
            counts = rule_counts(text)
            return not fails_rules(counts[0], counts[4]) and model.keeps(text)

        return lambda texts: list(map(good, texts))

    return filter_text(df, start, text_col)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and classifier over every text of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, ["doc_id"], "text", train(docs, table(spark, sf_dir, "labels")))
