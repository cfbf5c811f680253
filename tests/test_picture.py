"""Kernels, layers and the composed picture."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from chronoscape.functions import labels
from chronoscape.functions.grid import Grid
from chronoscape.operators import picture, present, resample

GRID = Grid(0.0, 0.0, 10.0, 40, 30)
KERNELS = {"box": (lambda x: 1.0 if -0.5 < x <= 0.5 else 0.0, 0.5), "bilinear": (lambda x: max(0.0, 1 - abs(x)), 1), "lanczos": (lambda x: 1.0 if x == 0 else 3 * math.sin(math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x) ** 2 if abs(x) < 3 else 0.0, 3)}


def by_hand(kernel, n_out, n_in, start, step):
    shape, reach = KERNELS[kernel]
    stretch, out = max(1.0, step), []
    for k in range(n_out):
        c = start + (k + 0.5) * step
        near = {i: shape((i + 0.5 - c) / stretch) for i in range(max(0, math.floor(c - reach * stretch + 0.5)), min(n_in, math.floor(c + reach * stretch + 0.5)))}
        out.append({i: w / sum(near.values()) for i, w in near.items() if w})
    return out


@pytest.mark.parametrize("kernel", sorted(KERNELS))
@pytest.mark.parametrize("shape", [(20, 7, 0.0, 7 / 20), (5, 23, 1.5, 3.9), (6, 6, 0.0, 1.0)])
def test_taps_by_hand(spark, kernel, shape):
    got = {}
    for r in resample.taps(spark, kernel, *shape).collect():
        got.setdefault(r.out, {})[r.at] = r.weight
    for k, want in enumerate(by_hand(kernel, *shape)):
        assert got[k] == pytest.approx(want) and sum(got[k].values()) == pytest.approx(1)


def test_resize_by_hand(spark):
    rng = random.Random(1)
    cells = {(r, c): rng.uniform(0, 255) for r in range(9) for c in range(13) if rng.random() < 0.9}
    pixels = spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], "row int, col int, v double")
    rows, cols = ("lanczos", 4, 9, 0.0, 2.25), ("lanczos", 30, 13, 0.0, 13 / 30)
    got = {(r.out_row, r.out_col): r.v for r in resample.resize(pixels, ["v"], resample.taps(spark, *rows), resample.taps(spark, *cols)).collect()}
    want = {(i, j): sum(u * v * cells.get((r, c), 0) for r, u in a.items() for c, v in b.items()) for i, a in enumerate(by_hand(*rows)) for j, b in enumerate(by_hand(*cols))}
    assert got == pytest.approx(want)


def test_layers_are_blended_from_low_to_high(spark):
    layer = lambda z, colour, a, n: spark.createDataFrame([(0, k, z, *map(float, colour), a) for k in range(n)], "out_row int, out_col int, z int, r double, g double, b double, a double")
    got = picture.compose([layer(5, (0, 0, 255), 0.5, 1), layer(0, (100, 100, 100), 1.0, 3), layer(2, (200, 0, 0), 0.75, 2)]).orderBy("out_col").collect()
    assert [(r.r, r.g, r.b) for r in got] == [(87, 12, 140), (175, 25, 25), (100, 100, 100)]


@pytest.mark.parametrize("size", [(60, 80), (45, 60), (15, 20), (11, 17)])
def test_marks_neither_lose_spots_nor_leave_holes(spark, size):
    """A detected pixel that stands alone is seen at any size, and a block stays whole when it grows."""
    block = [(r, c, True) for r in range(10, 16) for c in range(20, 26)] + [(3, 3, False)]
    found = spark.createDataFrame(block, "row int, col int, increased boolean")
    down, up = picture.changes(found, GRID, *size)
    lone, cells = down.select("out_row", "out_col").collect(), {(r.out_row, r.out_col): r.a for r in up.collect()}
    assert lone and all(abs((r.out_row + 0.5) * 30 / size[0] - 3.5) <= 1.5 * max(1, 30 / size[0]) for r in lone)
    rows, cols = {r for r, _ in cells}, {c for _, c in cells}
    assert len(cells) == len(rows) * len(cols) and len(rows) == max(rows) - min(rows) + 1
    edge = [(r, c) for r, c in cells if r in (min(rows), max(rows)) or c in (min(cols), max(cols))]
    assert all(cells[k] == 1.0 for k in edge) and all(a == 0.75 for k, a in cells.items() if k not in edge)


def test_numbers_are_drawn_from_glyphs(spark):
    places = spark.createDataFrame([(10.4, 20.0, "12", labels.INCREASE)], "x double, y double, text string, colour string")
    badge, digits = picture.numbers(places, 1)
    pixels = {(r.out_row, r.out_col): (r.r, r.g, r.b) for r in picture.compose([badge, digits]).collect()}
    rows, cols = {r for r, _ in pixels}, {c for _, c in pixels}
    assert (min(rows), max(rows), min(cols), max(cols)) == (14, 24, 10, 24)
    dark = {k for k, v in pixels.items() if v == (17, 17, 17)}
    want = {(16 + r, 12 + 6 * i + c) for i, ch in enumerate("12") for r, line in enumerate(picture.GLYPHS[ch]) for c in range(5) if line >> (4 - c) & 1}
    assert dark == want and pixels[14, 11] == (0, 200, 255) and pixels[15, 11] == (255, 255, 255) and (14, 10) not in pixels


def test_composed_picture(spark):
    found = spark.createDataFrame([(r, c, c < 10) for r in range(5, 9) for c in range(8, 13)], "row int, col int, increased boolean")
    levels = spark.range(80).select(F.floor(F.col("id") / 10).cast("int").alias("block_row"), (F.col("id") % 10).cast("int").alias("block_col"), F.lit(120).alias("after"))
    h, w = 240, 320
    drawn = present.radar_background(levels, "after", GRID, h, w)
    places = spark.createDataFrame([(100.0, 60.0, "3", labels.DECREASE)], "x double, y double, text string, colour string")
    letters = {"O": (14, 17, 17, 17, 17, 17, 14), "K": (17, 18, 20, 24, 20, 18, 17)}
    rows, height = picture.picture(found, drawn, GRID, h, w, places, ("OK", letters))
    pixels = {(r.out_row, r.out_col): (r.r, r.g, r.b) for r in rows.collect()}
    assert len(pixels) == height * w and height > h and pixels[200, 20] == (120, 120, 120)
    assert pixels[56, 80 - 8] == (30, 180, 221) and pixels[56, 90] == (221, 74, 66) and pixels[40, 64] == (0, 120, 153)
    assert pixels[60, 103] == (255, 255, 255) and any(v == (17, 17, 17) for v in pixels.values())
    white = [k for k in pixels if k[0] >= h and pixels[k] == (255, 255, 255)]
    assert len(white) > 0.8 * (height - h) * w and (255, 59, 48) in {pixels[k] for k in pixels if k[0] >= h}
    marked = 120 * (1 - 200 / 255) + 255 * 200 / 255
    assert (int(marked),) * 3 in {v for k, v in pixels.items() if h - 40 < k[0] < h and k[1] > w - 60}
    image = picture.picture_png(rows, height, w)
    assert image[:8] == b"\x89PNG\r\n\x1a\n"
    raw = zlib.decompress(image[image.index(b"IDAT") + 4 : -16])
    assert tuple(raw[200 * (w * 4 + 1) + 1 + 20 * 4 :][:3]) == (120, 120, 120)


def test_page_with_layers(spark):
    spots = spark.createDataFrame([(1, 9.0, 2.5, 4, ["a → b"], 3.0, 4.0)], "spot_id long, area_m2 double, change_db double, times_changed int, when array<string>, row double, col double")
    page = present.html_map("A <b>", spots, GRID, 2.0, layers=[("Radar <before>", b"one", False), ("Changes", b"two", True)], lines=["Before: </script>"])
    assert "A &lt;b&gt;" in page and "data:image/png;base64,b25l" in page and "Radar \\u003cbefore>" in page and page.count("</script>") == 1
    assert page.index("b25l") < page.index("dHdv") and '"shown": false' in page and labels.DECREASE in page
