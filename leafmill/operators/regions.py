"""Detected regions: validity, greedy suppression, page observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import iou, to_original


def region_valid(r: Column) -> Column:
    """Finite, inside the unit square, left before right and top before bottom."""
    parts = [r[c] for c in ("left", "top", "right", "bottom", "confidence")]
    inside = F.lit(True)
    for p in parts:
        inside = inside & p.between(0, 1) & ~F.isnan(p)
    return F.coalesce(inside & (r["left"] < r["right"]) & (r["top"] < r["bottom"]), F.lit(False))


def suppress(regions: Column, threshold: float) -> Column:
    """Greedy suppression of an array of regions: by confidence (ties by top, then left), keep what overlaps nothing kept by ``threshold`` or more; then reading order."""
    ranked = F.transform(regions, lambda r: F.struct((-r["confidence"]).alias("rank"), r["top"].alias("top"), r["left"].alias("left"), r["bottom"].alias("bottom"), r["right"].alias("right"), r["confidence"].alias("confidence")))
    keyed = F.array_sort(ranked)
    kept = F.aggregate(keyed, F.slice(keyed, 1, 0), lambda k, r: F.when(F.exists(k, lambda o: iou(o, r) >= threshold), k).otherwise(F.concat(k, F.array(r))))
    shaped = F.transform(kept, lambda r: F.struct(r["top"].alias("top"), r["left"].alias("left"), r["bottom"].alias("bottom"), r["right"].alias("right"), r["confidence"].alias("confidence")))
    return F.array_sort(shaped)


def page_observations(pages: DataFrame) -> DataFrame:
    """Observations of pages (``page``, arrays ``regions`` and ``texts`` of like length, ``steps``): numbered in reading order, polygons on the original page."""
    both = F.array_sort(F.zip_with("regions", "texts", lambda r, t: F.struct(r["top"].alias("top"), r["left"].alias("left"), r["bottom"].alias("bottom"), r["right"].alias("right"), r["confidence"].alias("confidence"), t.alias("text"))))
    rows = pages.select("page", "steps", F.posexplode(both).alias("i", "r"))
    corner = lambda x, y: to_original(F.col("steps"), F.col(f"r.{x}"), F.col(f"r.{y}"))
    polygon = F.array(corner("left", "top"), corner("right", "top"), corner("right", "bottom"), corner("left", "bottom"))
    return rows.select("page", F.format_string("obs_p%d_r%d", "page", "i").alias("observation_id"), F.col("i").cast("int").alias("reading_order"), "r.text", "r.confidence", polygon.alias("polygon"))
