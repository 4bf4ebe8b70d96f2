"""Image operators on luma pixels (binary, width, height): quality, glare, skew, deskew, upscaling, PNG metadata."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Thresholds; fixed values.
BLANK, OVER, UNDER = 0.02, 0.95, 0.05
SATURATED, GLARE_PART, GLARE_CEILING = 250, 0.01, 217
ANGLES, STEP, WIDEST, MOST_SAMPLES, LEAST_INK = 97, 0.25, 12.0, 50_000, 32

MEASURES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("contrast", "mean_luminance", "sharpness")] + [T.StructField("glare", T.BooleanType())])
SKEW = T.StructType([T.StructField("degrees", T.DoubleType()), T.StructField("confidence", T.DoubleType()), T.StructField("sampled", T.IntegerType())])


def pixels(luma: bytes | None, width: int | None, height: int | None) -> np.ndarray | None:
    """The image, or None for what isn't one: nothing there, no size, or another number of pixels than the size says."""
    if luma is None or pd.isna(width) or pd.isna(height) or width < 1 or height < 1 or len(luma) != int(width) * int(height):
        return None
    return np.frombuffer(luma, np.uint8).reshape(int(height), int(width))


def each(work, columns: list[str], *images: pd.Series) -> pd.DataFrame:
    """``work`` of each image as a row; nulls for what isn't an image."""
    found = [pixels(p, w, h) for p, w, h in zip(*images)]
    rows = [work(x) if x is not None else (None,) * len(columns) for x in found]
    return pd.DataFrame(rows, columns=columns, dtype=object)


def measures(image: np.ndarray) -> tuple[float, float, float, bool]:
    """Contrast, mean luminance, sharpness (mean step to the right and down) and glare."""
    x = image.astype(np.int32)
    steps = np.concatenate([np.abs(np.diff(x, axis=1)).ravel(), np.abs(np.diff(x, axis=0)).ravel()])
    histogram = np.bincount(image.ravel(), minlength=256)
    quartile = int(np.argmax(np.cumsum(histogram) * 4 >= image.size * 3))
    glare = histogram[SATURATED:].sum() / image.size >= GLARE_PART and quartile <= GLARE_CEILING
    return float((x.max() - x.min()) / 255), float(x.sum() / image.size / 255), float(steps.mean() / 255) if steps.size else 0.0, bool(glare)


@F.pandas_udf(MEASURES)
def measure(luma: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    return each(measures, MEASURES.names, luma, width, height)


def quality(images: DataFrame, least_width: int = 64, least_height: int = 64, least_sharpness: float = 0.01) -> DataFrame:
    """Measures, warnings in their fixed order, score, disposition and the verdict for the photographer; what isn't an image has null measures and is unreadable."""
    m = images.withColumn("m", measure("luma", "width", "height")).select("*", "m.*").drop("m")
    blank = F.col("contrast") < BLANK
    small = (F.col("width") < least_width) | (F.col("height") < least_height)
    blurry, over, under = F.col("sharpness") < least_sharpness, F.col("mean_luminance") > OVER, F.col("mean_luminance") < UNDER
    warnings = F.array_compact(F.array(
        F.when(blank, F.lit("blank")), F.when(~blank & blurry, F.lit("blurry")), F.when(~blank & F.col("glare"), F.lit("glare")),
        F.when(small, F.lit("low_resolution")), F.when(~blank & over, F.lit("overexposed")), F.when(~blank & under, F.lit("underexposed")),
    ))
    resolution = F.least(F.col("width") / least_width, F.col("height") / least_height, F.lit(1.0))
    exposure = F.greatest(1.0 - F.abs(F.col("mean_luminance") - 0.5) * 2.0, F.lit(0.0))
    m = m.withColumns({"warnings": warnings, "quality_score": F.when(blank, 0.0).otherwise(F.col("contrast") * resolution * exposure)})
    out = {"disposition": F.when(F.size("warnings") == 0, "continue").otherwise("request_better_source"), "verdict": verdict(F.col("warnings"))}
    unreadable = F.col("contrast").isNull()
    return m.withColumns({"warnings": F.when(unreadable, F.array(F.lit("unreadable"))).otherwise(F.col("warnings"))} | {k: F.when(~unreadable, v).otherwise({"disposition": "request_better_source", "verdict": "unusable"}[k]) for k, v in out.items()})


def verdict(warnings: Column) -> Column:
    """The worst thing first."""
    order = [("blank", "unusable"), ("low_resolution", "move_closer"), ("blurry", "hold_steady"), ("glare", "avoid_glare"), ("underexposed", "add_light"), ("overexposed", "reduce_light")]
    return F.coalesce(*[F.when(F.array_contains(warnings, w), F.lit(v)) for w, v in order], F.lit("usable"))


def skew(image: np.ndarray) -> tuple[float, float, int]:
    """Angle whose projection profile has most energy, its confidence, and the pixels sampled; nothing for too little ink or the widest angles."""
    height, width = image.shape
    stride = max(1, int(np.ceil(np.sqrt(image.size / MOST_SAMPLES))))
    sample = image[::stride, ::stride]
    y, x = (a.ravel()[:MOST_SAMPLES] * stride for a in np.indices(sample.shape))
    value = sample.ravel()[:MOST_SAMPLES]
    low, high = int(value.min()), int(value.max())
    ink = value <= low + (high - low) // 2
    if ink.sum() < LEAST_INK or low == high:
        return 0.0, 0.0, len(value)
    x, y, diagonal = x[ink] - width / 2, y[ink] - height / 2, np.hypot(width, height)
    best, angle, level = 0.0, 0.0, 0.0
    for i in range(ANGLES):
        degrees = -WIDEST + i * STEP
        r = np.radians(degrees)
        place = np.floor(np.sin(r) * x + np.cos(r) * y + diagonal / 2 + 0.5).clip(0, int(np.ceil(diagonal)) + 2).astype(np.int64)
        score = float((np.bincount(place).astype(np.float64) ** 2).sum() / len(x))
        level = score if degrees == 0 else level
        if (score, -abs(degrees), -degrees) > (best, -abs(angle), -angle):
            best, angle = score, degrees
    return angle, 0.0 if abs(angle) == WIDEST or best <= 0 else min(1.0, max(0.0, (best - level) / best)), len(value)


@F.pandas_udf(SKEW)
def estimate_skew(luma: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    return each(skew, SKEW.names, luma, width, height)


def rotated(image: np.ndarray, degrees: float) -> np.ndarray:
    """The image turned by ``degrees`` about its middle, between pixels by their shares, white outside."""
    height, width = image.shape
    r, (v, u) = np.radians(degrees), np.indices(image.shape).astype(float)
    dx, dy = u - (width - 1) / 2, v - (height - 1) / 2
    x, y = np.cos(r) * dx + np.sin(r) * dy + (width - 1) / 2, -np.sin(r) * dx + np.cos(r) * dy + (height - 1) / 2
    padded = np.pad(image.astype(float), 1, constant_values=255.0)
    x, y = np.clip(x + 1, 0, width + 0.999), np.clip(y + 1, 0, height + 0.999)
    i, j = x.astype(int), y.astype(int)
    fx, fy = x - i, y - j
    top = padded[j, i] * (1 - fx) + padded[j, i + 1] * fx
    low = padded[j + 1, i] * (1 - fx) + padded[j + 1, i + 1] * fx
    return np.floor(top * (1 - fy) + low * fy + 0.5).astype(np.uint8)


@F.pandas_udf(T.BinaryType())
def rotate(luma: pd.Series, width: pd.Series, height: pd.Series, degrees: pd.Series) -> pd.Series:
    """Pixels turned; null for what isn't an image or has no angle."""
    found = [(pixels(p, w, h), d) for p, w, h, d in zip(luma, width, height, degrees)]
    return pd.Series([None if x is None or pd.isna(d) else rotated(x, d).tobytes() for x, d in found], dtype=object)


def deskew(images: DataFrame, least_degrees: float = 0.5, least_confidence: float = 0.1) -> DataFrame:
    """Images turned upright where the angle matters and is sure enough, with the decision."""
    e = images.withColumn("skew", estimate_skew("luma", "width", "height"))
    decision = F.when(F.col("skew.degrees").isNull(), "unreadable").when(F.abs("skew.degrees") < least_degrees, "below_material_angle").when(F.col("skew.confidence") < least_confidence, "below_confidence").otherwise("applied")
    e = e.withColumn("decision", decision).withColumn("turn", F.when(F.col("decision") == "applied", F.col("skew.degrees")).otherwise(0.0))
    # One pass: a union of those turned and the rest would estimate every image twice.
    turned = rotate("luma", "width", "height", F.when(F.col("decision") == "applied", F.col("turn")))
    return e.withColumn("luma", F.coalesce(turned, "luma")).drop("turn")


def lanczos(image: np.ndarray, factor: int = 3, taps: int = 3) -> np.ndarray:
    """The image enlarged by a Lanczos window."""

    def weights(n: int) -> np.ndarray:
        at = (np.arange(n * factor) + 0.5) / factor - 0.5
        near = np.floor(at).astype(int)[:, None] + np.arange(-taps + 1, taps + 1)
        d = at[:, None] - near
        w = np.where(np.abs(d) < taps, np.sinc(d) * np.sinc(d / taps), 0.0)
        out = np.zeros((n * factor, n))
        np.add.at(out, (np.arange(n * factor)[:, None], near.clip(0, n - 1)), w)
        return out / out.sum(1, keepdims=True)

    height, width = image.shape
    return np.clip(np.rint(weights(height) @ image.astype(float) @ weights(width).T), 0, 255).astype(np.uint8)


def upscales(width: Column, height: Column) -> Column:
    """Whether a page image is enlarged before it is read."""
    return (F.least(width, height) >= 64) & (F.greatest(width, height) <= 640)


def png_metadata(data: bytes) -> int:
    """Encoded and decoded bytes of a PNG's text and profile chunks."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, total = 8, 0
    while at + 12 <= len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if kind in (b"tEXt", b"zTXt", b"iTXt", b"iCCP", b"eXIf"):
            total += size
            if kind in (b"zTXt", b"iCCP"):
                packed = body[body.index(b"\0") + 2 :]
                total += len(zlib.decompressobj().decompress(packed, 1 << 21))
        at += 12 + size
    return total


HEADER = T.StructType([T.StructField("format", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("metadata_bytes", T.LongType()), T.StructField("error", T.StringType())])


def header(data: bytes) -> tuple[str, int, int]:
    """Format and size of a PNG, JPEG or WebP image, by its head."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
        return "png", *struct.unpack(">II", data[16:24])
    if data[:3] == b"\xff\xd8\xff":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return "jpeg", width, height
            at += 2 + size
        raise ValueError("no frame in the JPEG head")
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        if data[12:16] == b"VP8X":
            return "webp", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return "webp", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        if data[12:16] == b"VP8 ":
            width, height = struct.unpack("<HH", data[26:30])
            return "webp", width & 0x3FFF, height & 0x3FFF
    raise ValueError("not a PNG, JPEG or WebP image")


@F.pandas_udf(HEADER)
def read_header(content: pd.Series) -> pd.DataFrame:
    rows = []
    for data in content:
        try:
            kind, width, height = header(bytes(data))
            rows.append((kind, width, height, png_metadata(bytes(data)) if kind == "png" else 0, None))
        except (ValueError, IndexError, struct.error, TypeError, zlib.error) as e:
            rows.append((None, None, None, None, str(e)))
    return pd.DataFrame(rows, columns=HEADER.names).astype({"width": "Int32", "height": "Int32", "metadata_bytes": "Int64"})


def inspect(files: DataFrame, content: str, declared: str, most_pixels: int = 100_000_000, most_metadata: int = 1 << 20) -> DataFrame:
    """Size and verdict of image files held against their declared MIME type: ok, unreadable, mismatch, too_large or metadata."""
    i = files.withColumn("image", read_header(content))
    mime = F.concat(F.lit("image/"), F.col("image.format"))
    pixels = F.col("image.width").cast("long") * F.col("image.height")
    outcome = F.when(F.col("image.error").isNotNull(), "unreadable").when(mime != F.col(declared), "mismatch").when((pixels > most_pixels) | (pixels == 0), "too_large").when(F.col("image.metadata_bytes") > most_metadata, "metadata").otherwise("ok")
    return i.withColumn("outcome", outcome)
