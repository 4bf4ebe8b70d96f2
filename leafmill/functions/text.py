"""Text functions: normal form, edits of characters and words, rates, usable text."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Name of the normalisation that evaluations use: NFC, words split at Unicode space.
NORMALISATION = "unicode-nfc-whitespace-v1"
SMALLEST = 2.220446049250313e-16


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode normal form C; Spark has no built-in for it."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def words(text: Column) -> Column:
    """Words between Unicode space."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def char_edits(reference: Column, candidate: Column) -> Column:
    """Levenshtein distance over code points."""
    return F.levenshtein(reference, candidate).cast("long")


def word_distance(a: list[str], b: list[str]) -> int:
    """Levenshtein distance of two lists, a whole row of the table at a time."""
    number: dict[str, int] = {}
    x, y = (np.array([number.setdefault(w, len(number)) for w in side], np.int64) for side in (a, b))
    if len(x) < len(y):
        x, y = y, x
    place = np.arange(len(y) + 1)
    row = place
    for i, word in enumerate(x, 1):
        made = np.minimum(row[1:] + 1, row[:-1] + (y != word))
        # What comes from the left costs one a step: least of all before, less their places.
        row = np.minimum.accumulate(np.concatenate(([i], made)) - place) + place
    return int(row[-1])


@F.pandas_udf(T.LongType())
def word_edits_batch(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    return pd.Series([word_distance(list(a), list(b)) for a, b in zip(reference, candidate)], dtype="int64")


def word_edits(reference: Column, candidate: Column) -> Column:
    """Levenshtein distance over words, in Arrow batches."""
    return word_edits_batch(words(reference), words(candidate))


def rate(edits: Column, units: Column) -> Column:
    """Edits per reference unit: 0 if both are 0, null if only the units are."""
    return F.when(units > 0, edits / units).when(edits == 0, F.lit(0.0))


def unusable(text: Column, limit: int = 65_536) -> Column:
    """Whether a line spoils its page: too long in bytes, or with replacement or control characters other than space."""
    return (F.octet_length(text) > limit) | text.rlike(r"(?U)[�\p{Cc}&&[^\s]]")


def usable(text: Column) -> Column:
    return ~unusable(text)
