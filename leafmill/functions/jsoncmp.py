"""JSON values: canonical text, equivalence within a tolerance, keyed digests."""

from __future__ import annotations

import hashlib
import hmac as _hmac
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOLERANCE = 0.01


def canonical(value: Column) -> Column:
    """JSON text with sorted keys and no spaces, or null."""
    return F.to_json(F.try_parse_json(value))


def same(a, b) -> bool:
    """Numbers within the tolerance; objects and arrays part by part; everything else exactly."""
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    if number(a) and number(b):
        return abs(a - b) <= TOLERANCE
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(v, b[k]) for k, v in a.items())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    return type(a) is type(b) and a == b


@F.pandas_udf(T.BooleanType())
def equivalent(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two JSON texts are equivalent; text that isn't JSON is equivalent to nothing."""

    def one(x, y):
        try:
            return same(json.loads(x), json.loads(y))
        except (TypeError, ValueError):
            return False

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=bool)


def keyed_digest(key: bytes):
    """A function that gives the hexadecimal HMAC-SHA256 of text under ``key``; for checking, not for access control."""

    @F.pandas_udf(T.StringType())
    def sign(text: pd.Series) -> pd.Series:
        return text.map(lambda t: _hmac.new(key, t.encode(), hashlib.sha256).hexdigest(), na_action="ignore")

    return sign
