"""Page images made ready to be read: turned by their orientation tag, deskewed and, if small, enlarged; each step is recorded so that points can be put back.

``transforms`` is an array of steps as :func:`leafmill.functions.geometry.to_original` undoes them, in the unit square.
Enlarging is no step: parts of the page stay what they are.  Images that can't be read, or should
be taken again, keep their pixels and have no steps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import images

STEP = "struct<kind:string,left:double,top:double,width:double,height:double,degrees:double>"
IMAGE = T.StructType([T.StructField("luma", T.BinaryType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])
# Steps of the orientation tag's values 1 to 8, in their order; fixed values.
ORIENTATIONS = [[], ["flip_horizontal"], ["clockwise_180"], ["flip_vertical"], ["clockwise_90", "flip_horizontal"], ["clockwise_90"], ["clockwise_270", "flip_horizontal"], ["clockwise_270"]]
TURNS = {
    "flip_horizontal": lambda x: x[:, ::-1], "flip_vertical": lambda x: x[::-1], "clockwise_90": lambda x: np.rot90(x, -1), "clockwise_180": lambda x: np.rot90(x, 2), "clockwise_270": lambda x: np.rot90(x, 1),
}
#: Source rows and columns of a tile; a tile is enlarged by itself, with as many pixels around it as the window has taps.
TILE, TAPS, FACTOR = 128, 3, 3


def step(kind: str, degrees: Column | None = None) -> Column:
    none = F.lit(None).cast("double")
    return F.struct(F.lit(kind).alias("kind"), *[none.alias(c) for c in ("left", "top", "width", "height")], (none if degrees is None else degrees).cast("double").alias("degrees"))


def orientation_steps(orientation: Column) -> Column:
    """Steps for an orientation tag; none for a missing or unknown one."""
    steps = F.array().cast(f"array<{STEP}>")
    for value, kinds in enumerate(ORIENTATIONS, 1):
        if kinds:
            steps = F.when(orientation == value, F.array(*map(step, kinds))).otherwise(steps)
    return steps


@F.pandas_udf(IMAGE)
def oriented(luma: pd.Series, width: pd.Series, height: pd.Series, orientation: pd.Series) -> pd.DataFrame:
    rows = []
    for p, w, h, o in zip(luma, width, height, orientation):
        image = images.pixels(p, w, h)
        if image is not None and not pd.isna(o) and 1 <= o <= len(ORIENTATIONS):
            for kind in ORIENTATIONS[int(o) - 1]:
                image = TURNS[kind](image)
        rows.append((p, w, h) if image is None else (image.tobytes(), image.shape[1], image.shape[0]))
    return pd.DataFrame(rows, columns=IMAGE.names, dtype=object)


def window(first: int, last: int, n: int, factor: int) -> tuple[int, np.ndarray]:
    """Weights of ``first * factor`` to ``last * factor`` of an axis of ``n`` pixels enlarged, over the pixels from the returned one on."""
    at = (np.arange(first * factor, last * factor) + 0.5) / factor - 0.5
    near = np.floor(at).astype(int)[:, None] + np.arange(-TAPS + 1, TAPS + 1)
    d = at[:, None] - near
    weight = np.where(np.abs(d) < TAPS, np.sinc(d) * np.sinc(d / TAPS), 0.0)
    weight[(near < 0) | (near >= n)] = 0.0
    near = near.clip(0, n - 1)
    low = int(near.min())
    out = np.zeros((len(at), int(near.max()) + 1 - low))
    np.add.at(out, (np.arange(len(at))[:, None], near - low), weight)
    return low, out / out.sum(1, keepdims=True)


def enlarged(image: np.ndarray, factor: int = FACTOR, tile: int = TILE) -> np.ndarray:
    """The image enlarged by a Lanczos window, tile by tile: along one axis, then along the other."""
    height, width = image.shape
    out = np.empty((height * factor, width * factor), np.uint8)
    for y in range(0, height, tile):
        top, down = window(y, min(height, y + tile), height, factor)
        for x in range(0, width, tile):
            left, across = window(x, min(width, x + tile), width, factor)
            part = image[top : top + down.shape[1], left : left + across.shape[1]].astype(float)
            out[y * factor : (y + tile) * factor, x * factor : (x + tile) * factor] = np.clip(np.rint(down @ part @ across.T), 0, 255)
    return out


@F.pandas_udf(T.BinaryType())
def enlarge(luma: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    found = [images.pixels(p, w, h) for p, w, h in zip(luma, width, height)]
    return pd.Series([None if x is None else enlarged(x).tobytes() for x in found], dtype=object)


def prepare(df: DataFrame, orientation: str = "orientation", **thresholds: float) -> DataFrame:
    """Images worth reading turned upright, with ``outcome`` (ready or request_better_source) and ``transforms``; quality columns stay.

    Quality is judged before any step, so that what should be taken again costs no more work.
    """
    q = images.quality(df, **thresholds).withColumn("outcome", F.when(F.col("disposition") == "continue", "ready").otherwise("request_better_source"))
    steps = F.when(F.col("outcome") == "ready", orientation_steps(F.col(orientation))).otherwise(F.array().cast(f"array<{STEP}>"))
    q = q.withColumn("transforms", steps)
    # One pass: a union of those turned and the rest would judge every image twice.  Those without a step come back as they are.
    tag = F.when(F.size("transforms") > 0, F.col(orientation))
    turned = q.withColumn("__image", oriented("luma", "width", "height", tag))
    return turned.withColumns({c: F.when(F.size("transforms") > 0, F.col(f"__image.{c}")).otherwise(F.col(c)) for c in IMAGE.names}).drop("__image")


def straightened(prepared: DataFrame, **bounds: float) -> DataFrame:
    """Ready images deskewed where it matters, with the step added to ``transforms``."""
    ready = images.deskew(prepared.where("outcome = 'ready'"), **bounds)
    added = F.concat("transforms", F.array(step("deskew", F.col("skew.degrees"))))
    ready = ready.withColumn("transforms", F.when(F.col("decision") == "applied", added).otherwise(F.col("transforms")))
    return ready.unionByName(prepared.where("outcome <> 'ready'"), allowMissingColumns=True)


def upscaled(df: DataFrame, orientation: str = "orientation", frames: str | None = None) -> DataFrame:
    """Small images of one frame and no orientation three times as large; ``upscaled`` says which."""
    single = F.lit(True) if frames is None else F.coalesce(F.col(frames) <= 1, F.lit(True))
    whole = F.octet_length("luma") == F.col("width") * F.col("height")
    small = F.coalesce(images.upscales(F.col("width"), F.col("height")) & single & (F.coalesce(orientation, F.lit(1)) == 1) & whole, F.lit(False))
    marked = df.withColumn("upscaled", small)
    large = marked.withColumn("luma", F.coalesce(enlarge("luma", F.when(F.col("upscaled"), F.col("width")), "height"), "luma"))
    return large.withColumns({c: F.when(F.col("upscaled"), (F.col(c) * FACTOR).cast("int")).otherwise(F.col(c)) for c in ("width", "height")})
