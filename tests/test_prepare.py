"""Images made ready: orientation, steps put back, enlarging by tiles."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.functions import geometry
from leafmill.operators import images, prepare


def marked(width=40, height=24, at=(7, 5)):
    """An image with one dark block, by whose middle its steps are known."""
    rng = np.random.default_rng(1)
    image = rng.integers(150, 210, (height, width)).astype(np.uint8)
    image[at[1] : at[1] + 2, at[0] : at[0] + 2] = 0
    return image


def middle(image):
    y, x = np.nonzero(image < 60)
    return (x.mean() + 0.5) / image.shape[1], (y.mean() + 0.5) / image.shape[0]


@pytest.fixture(scope="module")
def frame(spark):
    image = marked()
    rows = [(o, image.tobytes(), 40, 24, o) for o in range(10)] + [(10, image.tobytes(), 40, 24, None), (11, None, 40, 24, 6), (12, b"short", 40, 24, 6), (13, bytes(960), 40, 24, 6)]
    return spark.createDataFrame(rows, "id int, luma binary, width int, height int, orientation int")


def test_points_go_back(frame):
    made = prepare.prepare(frame, least_width=1, least_height=1)
    got = {r.id: r for r in made.collect()}
    assert {k for k, r in got.items() if r.outcome == "ready"} == set(range(11)) and all(not got[k].transforms and got[k].verdict == "unusable" for k in (11, 12, 13))
    want = middle(marked())
    for o in range(11):
        image = np.frombuffer(got[o].luma, np.uint8).reshape(got[o].height, got[o].width)
        assert image.shape == ((40, 24) if o in (5, 6, 7, 8) else (24, 40))
        x, y = middle(image)
        back = made.where(F.col("id") == o).select(geometry.to_original(F.col("transforms"), F.lit(x), F.lit(y)).alias("p")).first().p
        assert abs(back.x - want[0]) < 1e-9 and abs(back.y - want[1]) < 1e-9, o
    names = {o: [s.kind for s in got[o].transforms] for o in range(11)}
    assert names == {0: [], 9: [], 10: [], **{o: k for o, k in enumerate(prepare.ORIENTATIONS, 1)}}


def test_deskew_goes_back_within_a_pixel(spark):
    page = np.full((300, 300), 235, np.uint8)
    for y in range(30, 270, 16):
        page[y : y + 4, 30:270] = 20
    tilted = images.rotated(page, -4.0)
    df = spark.createDataFrame([(1, tilted.tobytes(), 300, 300, 1)], "id int, luma binary, width int, height int, orientation int")
    made = prepare.straightened(prepare.prepare(df))
    r = made.first()
    assert r.decision == "applied" and [s.kind for s in r.transforms] == ["deskew"]
    # Where the middle of the upright page's first line begins, by its ends on the tilted one.
    a = np.radians(r.transforms[0].degrees)
    back = made.select(geometry.to_original(F.col("transforms"), F.lit(31.5 / 300), F.lit(32.0 / 300)).alias("p")).first().p
    x, y = back.x * 300, back.y * 300
    near = tilted[int(y) - 2 : int(y) + 3, int(x) - 1 : int(x) + 3]
    assert near.min() < 60 and abs(np.degrees(a)) == pytest.approx(4.0, abs=0.3)


def test_enlarged_by_tiles():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (70, 101)).astype(np.uint8)
    whole = prepare.enlarged(image, tile=1000)
    for tile in (1, 7, 64):
        assert np.array_equal(prepare.enlarged(image, tile=tile), whole)
    assert (prepare.enlarged(np.full((9, 9), 77, np.uint8)) == 77).all() and whole.shape == (210, 303)
    # By the window's definition at one place, away from the sides.
    y, x = 100, 151
    total = weight = 0.0
    for i in range(70):
        for j in range(101):
            d = [(y + 0.5) / 3 - 0.5 - i, (x + 0.5) / 3 - 0.5 - j]
            if max(map(abs, d)) < 3:
                w = np.prod([np.sinc(v) * np.sinc(v / 3) for v in d])
                total, weight = total + w * image[i, j], weight + w
    assert abs(whole[y, x] - np.clip(total / weight, 0, 255)) <= 0.5001


def test_upscaled(spark):
    image = marked(64, 64).tobytes()
    rows = [(1, image, 64, 64, 1, 1), (2, image, 64, 64, 6, 1), (3, image, 64, 64, None, 2), (4, image[:-1], 64, 64, 1, 1), (5, None, 64, 64, 1, 1), (6, marked(40, 24).tobytes(), 40, 24, 1, 1)]
    got = {r.id: r for r in prepare.upscaled(spark.createDataFrame(rows, "id int, luma binary, width int, height int, orientation int, frames int"), frames="frames").collect()}
    assert [k for k in sorted(got) if got[k].upscaled] == [1] and (got[1].width, len(got[1].luma)) == (192, 192 * 192) and got[5].luma is None


def test_rotate_takes_what_is_no_image(spark):
    rows = [(1, bytes(4), 2, 2, 5.0), (2, None, 2, 2, 5.0), (3, bytes(3), 2, 2, 5.0), (4, bytes(4), 2, 2, None), (5, bytes(4), None, 2, 5.0)]
    got = spark.createDataFrame(rows, "i int, luma binary, w int, h int, d double").select("i", images.rotate("luma", "w", "h", "d").alias("r")).collect()
    assert [r.i for r in got if r.r is not None] == [1]
