"""Geometry: polygons, boxes, rotations and chains of page transforms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SMALLEST


def twice_area(points: Column) -> Column:
    """Twice the signed area of a polygon (shoelace sum, first point to last and back)."""
    after = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    terms = F.zip_with(points, after, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)


def polygon_valid(points: Column) -> Column:
    """Three points or more, all finite and in the unit square, with an area."""
    inside = F.forall(points, lambda p: p["x"].between(0, 1) & p["y"].between(0, 1) & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    return F.coalesce((F.size(points) >= 3) & inside & (F.abs(twice_area(points)) > SMALLEST), F.lit(False))


def page_valid(width: Column, height: Column) -> Column:
    return (width > 0) & (height > 0) & (width.cast("long") * height <= 100_000_000)


def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes (left, top, right, bottom) by their union."""
    w = F.greatest(F.lit(0.0), F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"]))
    h = F.greatest(F.lit(0.0), F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"]))
    area = lambda r: (r["right"] - r["left"]) * (r["bottom"] - r["top"])
    return w * h / (area(a) + area(b) - w * h)


POLYGON = "array<struct<x:double,y:double>>"


def turned_on(points: Column) -> Column:
    """The polygon's points, beginning with the second."""
    return F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def beside(points: Column, a: Column, b: Column, sign: Column) -> Column:
    """The part of a convex polygon on the inner side of the line from ``a`` to ``b``."""
    inner = lambda p: sign * ((b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]))
    none = F.array().cast(POLYGON)

    def cut(p: Column, q: Column) -> Column:
        s, t = p["s"], q["s"]
        between = lambda c: p["p"][c] + s / (s - t) * (q["p"][c] - p["p"][c])
        crossing = F.array(F.struct(between("x").alias("x"), between("y").alias("y")))
        return F.concat(F.when(s >= 0, F.array(p["p"])).otherwise(none), F.when(((s > 0) & (t < 0)) | ((s < 0) & (t > 0)), crossing).otherwise(none))

    placed = F.transform(points, lambda p: F.struct(p.alias("p"), inner(p).alias("s")))
    return F.flatten(once(placed, lambda held: F.zip_with(held, turned_on(held), cut)))


def overlap(a: Column, b: Column) -> Column:
    """What two convex polygons have in common, as a polygon: ``a`` cut along each side of ``b``; without points where they are apart."""
    sides = once(b, lambda p: F.zip_with(p, turned_on(p), lambda x, y: F.struct(x.alias("a"), y.alias("b"), F.signum(twice_area(p)).alias("sign"))))
    return F.aggregate(sides, a.cast(POLYGON), lambda held, side: beside(held, side["a"], side["b"], side["sign"]))


def area(points: Column) -> Column:
    return once(points, lambda p: F.when(F.size(p) >= 3, F.abs(twice_area(p)) / 2).otherwise(0.0))


def polygon_iou(a: Column, b: Column) -> Column:
    """Overlap of two convex polygons by their union; null where either isn't valid."""
    return common_iou(area(overlap(a, b)), a, b)


def common_iou(common: Column, a: Column, b: Column) -> Column:
    """As :func:`polygon_iou`, where the area in ``common`` is known."""
    whole = once(common, lambda both: both / (area(a) + area(b) - both))
    return F.when(polygon_valid(a) & polygon_valid(b), whole)


def points_to_pixels(points: Column, rotation: Column, other: Column) -> Column:
    """Pixels at 300 dpi of a page side in points; a quarter turn swaps it with the other side."""
    side = F.when(F.pmod(rotation, F.lit(180)) == 90, other).otherwise(points)
    return F.ceil(side * 300 / 72).cast("int")


def undo(step: Column, x: Column, y: Column) -> Column:
    """The point before one transform ``step`` (kind, left, top, width, height, degrees) of a point after it."""
    a = F.radians(step["degrees"])
    dx, dy = x - 0.5, y - 0.5
    at = lambda u, v: F.struct(u.alias("x"), v.alias("y"))
    return (
        F.when(step["kind"] == "crop", at(step["left"] + x * step["width"], step["top"] + y * step["height"]))
        .when(step["kind"] == "deskew", at(0.5 + F.cos(a) * dx + F.sin(a) * dy, 0.5 - F.sin(a) * dx + F.cos(a) * dy))
        .when(step["kind"] == "flip_horizontal", at(1.0 - x, y)).when(step["kind"] == "flip_vertical", at(x, 1.0 - y))
        .when(step["kind"] == "clockwise_90", at(y, 1.0 - x)).when(step["kind"] == "clockwise_180", at(1.0 - x, 1.0 - y)).when(step["kind"] == "clockwise_270", at(1.0 - y, x))
    )


def to_original(steps: Column, x: Column, y: Column) -> Column:
    """A point of the transformed page on the original: all steps undone, last first; null outside the unit square."""
    end = F.aggregate(F.reverse(steps), F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")), lambda p, s: undo(s, p["x"], p["y"]))
    return F.when(end["x"].between(0, 1) & end["y"].between(0, 1), end)
