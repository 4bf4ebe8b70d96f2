"""Polygon overlap by brute force, ranks of large groups, calibration."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from leafmill.functions import geometry
from leafmill.operators import evaluate


def convex(rng, n):
    """A convex polygon in the unit square: points of a circle, in order."""
    x, y, r = rng.uniform(0.3, 0.7), rng.uniform(0.3, 0.7), rng.uniform(0.1, 0.3)
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    points = [(x + r * math.cos(a), y + r * math.sin(a)) for a in angles]
    return points if rng.random() < 0.5 else points[::-1]


def inside(points, x, y):
    turns = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in zip(points, points[1:] + points[:1])]
    return min(turns) >= 0 or max(turns) <= 0


def test_overlap_by_counting(spark):
    rng, n = random.Random(3), 120
    pairs = [(convex(rng, rng.randint(3, 8)), convex(rng, rng.randint(3, 8))) for _ in range(25)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], f"i int, a {geometry.POLYGON}, b {geometry.POLYGON}")
    got = df.select("i", geometry.area(geometry.overlap(F.col("a"), F.col("b"))).alias("both"), geometry.polygon_iou(F.col("a"), F.col("b")).alias("iou")).orderBy("i").collect()
    for (a, b), r in zip(pairs, got):
        cells = [((i + 0.5) / n, (j + 0.5) / n) for i in range(n) for j in range(n)]
        in_a, in_b = [inside(a, *c) for c in cells], [inside(b, *c) for c in cells]
        both, either = sum(map(min, in_a, in_b)), sum(map(max, in_a, in_b))
        assert abs(r.both - both / n / n) < 6e-3 and abs(r.iou - both / either) < 0.05
    assert sum(r.both > 0 for r in got) > 10 and sum(r.both == 0 for r in got) > 0


def test_overlap_of_touching_and_invalid(spark):
    square = lambda x, y: [(x, y), (x + 0.25, y), (x + 0.25, y + 0.25), (x, y + 0.25)]
    o = 0.0
    rows = [(square(o, o), square(o, o), 1.0), (square(o, o), square(0.25, o), o), (square(o, o), square(0.5, 0.5), o), (square(o, o)[::-1], square(0.125, o), 1 / 3), ([(o, o), (1.0, 1.0)], square(o, o), None), (None, square(o, o), None)]
    df = spark.createDataFrame(rows, f"a {geometry.POLYGON}, b {geometry.POLYGON}, want double")
    assert all(r.iou == r.want or abs(r.iou - r.want) < 1e-12 for r in df.select("want", geometry.polygon_iou(F.col("a"), F.col("b")).alias("iou")).collect())


def test_nearest_ranks(spark):
    rng = random.Random(4)
    rows = [(k, None if rng.random() < 0.05 else rng.choice([rng.randrange(50), rng.randrange(10**9)])) for k, n in ((1, 5000), (2, 1), (3, 2), (4, 100), (None, 333)) for _ in range(n)] + [(5, 7)] * 900 + [(6, None)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(4)
    for accuracy in (10_000, 50):
        got = {r.k: (r.n, r.p0, r.p50, r.p95, r.p100) for r in evaluate.nearest_ranks(df, ["k"], "v", [0, 50, 95, 100], accuracy).collect()}
        want = {}
        for k in {k for k, _ in rows}:
            s = sorted(v for i, v in rows if i == k and v is not None)
            if s:
                want[k] = (len(s), *[s[max(0, math.ceil(len(s) * p / 100) - 1)] for p in (0, 50, 95, 100)])
        assert got == want
    assert evaluate.nearest_ranks(df.where("false"), ["k"], "v", [50]).count() == 0


def test_calibration(spark):
    rows = [("a", 0.95, True)] * 9 + [("a", 0.95, False)] + [("a", 0.05, False)] * 10 + [("b", 1.0, True), ("b", None, True), ("b", 0.5, None), ("b", 1.5, True)]
    got = {r.k: r for r in evaluate.calibration_error(spark.createDataFrame(rows, "k string, c double, right boolean"), "c", "right", "k").collect()}
    assert abs(got["a"].expected_error - 0.05) < 1e-12 and (got["a"].n, got["b"].n, got["b"].greatest_error) == (20, 1, 0.0)
