"""The composed picture: layers of (pixel, height, colour, opacity), blended from the lowest to the highest.

A layer is a table out_row, out_col, z, r, g, b, a with colours from 0 to 255 and opacity from 0 to 1. Pixels of all
layers meet in one aggregation; a pixel has as many rows as layers lie over it, which are a handful. Shapes and glyphs
are small tables of the pixels that they cover.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.grid import Grid, ring_holds
from .neighbourhood import edges
from .present import png
from .resample import taps

#: Heights of the layers.
BACKGROUND, DECREASED, INCREASED, BADGE, DIGITS, ARROW, MARK, PANEL, KEYS = range(9)
# Digits and the N of the arrow, five pixels wide and seven high, a row a number of five bits.
GLYPHS = {
    "0": (14, 17, 19, 21, 25, 17, 14), "1": (4, 12, 4, 4, 4, 4, 14), "2": (14, 17, 1, 2, 4, 8, 31), "3": (31, 2, 4, 2, 1, 17, 14), "4": (2, 6, 10, 18, 31, 2, 2),
    "5": (31, 16, 30, 1, 1, 17, 14), "6": (6, 8, 16, 30, 17, 17, 14), "7": (31, 1, 2, 4, 8, 8, 8), "8": (14, 17, 17, 14, 17, 17, 14), "9": (14, 17, 17, 15, 1, 2, 12), "N": (17, 17, 25, 21, 19, 17, 17),
}
GLYPH_WIDTH, GLYPH_HEIGHT = 5, 7


def compose(layers: list[DataFrame]) -> DataFrame:
    """out_row, out_col, r, g, b of the pixels that any layer covers, cut to whole numbers after the last layer; what is under all is black."""
    every = reduce(DataFrame.unionByName, layers)
    stack = F.array_sort(F.collect_list(F.struct("z", *[F.col(c).cast("double").alias(c) for c in "rgba"]))).alias("stack")
    met = every.groupBy("out_row", "out_col").agg(stack)
    over = lambda c: F.aggregate("stack", F.lit(0.0), lambda under, top: under * (1 - top["a"]) + top[c] * top["a"])
    return met.select("out_row", "out_col", *[F.floor(F.least(F.greatest(over(c), F.lit(0.0)), F.lit(255.0))).cast("int").alias(c) for c in "rgb"])


def _coloured(df: DataFrame, z: int, colour: tuple | list[Column], a: float | Column = 1.0) -> DataFrame:
    one = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return df.select(F.col("out_row").cast("int").alias("out_row"), F.col("out_col").cast("int").alias("out_col"), F.lit(z).alias("z"), *[one(v).cast("double").alias(c) for v, c in zip(colour, "rgb")], one(a).cast("double").alias("a"))


def background(drawn: DataFrame) -> DataFrame:
    """The layer of a background (see `present`), grey or coloured, rounded as pictures are."""
    whole = lambda c: F.floor(F.round(c, 6) + 0.5)
    colour = ["grey"] * 3 if "grey" in drawn.columns else list("rgb")
    return _coloured(drawn, BACKGROUND, [whole(c) for c in colour])


def changes(found: DataFrame, grid: Grid, out_height: int, out_width: int) -> list[DataFrame]:
    """A layer a direction: three quarters of the colour, and a rim of the darkened colour. A picture pixel is marked if
    the box filter's share of detected pixels in it is above zero, so small spots survive shrinking and grow without holes."""
    spark = found.sparkSession
    rows, cols = (taps(spark, "box", n, m, 0.0, m / n).select(F.col("out").alias(f"out_{c}"), F.col("at").alias(c)) for n, m, c in ((out_height, grid.height, "row"), (out_width, grid.width, "col")))
    out = []
    for z, increased, colour in ((DECREASED, False, labels.DECREASE), (INCREASED, True, labels.INCREASE)):
        own = found.where(F.col("increased") == increased).select("row", "col").join(rows, "row").join(cols, "col")
        mask = own.select(F.col("out_row").alias("row"), F.col("out_col").alias("col")).distinct()
        rim = edges(mask, out_height, out_width).withColumn("rim", F.lit(True))
        rgb = labels.rgb(F.lit(colour))
        got = mask.join(rim, ["row", "col"], "left").withColumnsRenamed({"row": "out_row", "col": "out_col"})
        out.append(_coloured(got, z, [F.when(F.col("rim"), rgb[i] * 0.6).otherwise(rgb[i]) for i in range(3)], F.when(F.col("rim"), 1.0).otherwise(0.75)))
    return out


def polygon(spark: SparkSession, points: list[tuple[float, float]], z: int, fill: tuple, rim: tuple | None = None) -> DataFrame:
    """Pixels whose centres lie within a polygon of (x, y); those at its edge in another colour, if one is given."""
    xs, ys = [int(p[0] // 1) for p in points], [int(p[1] // 1) for p in points]
    wide, high = max(xs) - min(xs) + 1, max(ys) - min(ys) + 1
    ring = F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in points])
    cell = spark.range(wide * high).select((F.floor(F.col("id") / wide) + min(ys)).cast("int").alias("row"), (F.col("id") % wide + min(xs)).cast("int").alias("col"))
    inside = cell.where(ring_holds(ring, F.col("col") + 0.5, F.col("row") + 0.5))
    if rim is None:
        return _coloured(inside.withColumnsRenamed({"row": "out_row", "col": "out_col"}), z, fill)
    edge = edges(inside, 2**30, 2**30).withColumn("rim", F.lit(True))
    marked = inside.join(edge, ["row", "col"], "left").withColumnsRenamed({"row": "out_row", "col": "out_col"})
    return _coloured(marked, z, [F.when(F.col("rim"), float(e)).otherwise(float(f)) for e, f in zip(rim, fill)])


def rectangle(spark: SparkSession, left: int, top: int, width: int, height: int, z: int, colour: tuple, a: float = 1.0) -> DataFrame:
    cell = spark.range(max(0, width) * max(0, height)).select((F.floor(F.col("id") / max(1, width)) + top).alias("out_row"), (F.col("id") % max(1, width) + left).alias("out_col"))
    return _coloured(cell, z, colour, a)


def north_arrow(spark: SparkSession, width: int) -> list[DataFrame]:
    """White with a black rim, at the upper right, and an N below it."""
    s = width / 60
    x, y = width - 2 * s, 1.6 * s
    arrow = polygon(spark, [(x, y - s), (x - 0.6 * s, y + 0.6 * s), (x, y + 0.2 * s), (x + 0.6 * s, y + 0.6 * s)], ARROW, (255, 255, 255), (0, 0, 0))
    size = int(s // GLYPH_HEIGHT)
    if not size:  # too small to be read
        return [arrow]
    at = spark.createDataFrame([(float(x - GLYPH_WIDTH * size / 2), float(y + 0.8 * s), "N")], "x double, y double, text string")
    return [arrow, text(at, size, ARROW, (255, 255, 255))]


def glyph_table(spark: SparkSession, glyphs: dict[str, tuple] | None = None) -> DataFrame:
    """glyph, g_row, g_col: the pixels of each character."""
    rows = [(ch, r, c) for ch, bits in (glyphs or GLYPHS).items() for r, line in enumerate(bits) for c in range(GLYPH_WIDTH) if line >> (GLYPH_WIDTH - 1 - c) & 1]
    return spark.createDataFrame(rows, "glyph string, g_row int, g_col int")


def text(lines: DataFrame, size: int, z: int, colour: tuple | list[Column], a: float = 1.0, glyphs: dict[str, tuple] | None = None) -> DataFrame:
    """lines (x, y, text and columns that the colour uses): characters from their upper left corner on, each glyph pixel
    size x size picture pixels; characters without a glyph leave a gap."""
    chars = lines.select("*", F.posexplode(F.split("text", "")).alias("_i", "glyph"))
    met = chars.join(F.broadcast(glyph_table(lines.sparkSession, glyphs)), "glyph")  # a few dozen pixels a character
    step = F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    drawn = met.withColumn("_u", step).withColumn("_v", step)
    row, col = F.floor(F.col("y")) + F.col("g_row") * size + F.col("_v"), F.floor(F.col("x")) + (F.col("_i") * (GLYPH_WIDTH + 1) + F.col("g_col")) * size + F.col("_u")
    return _coloured(drawn.withColumns({"out_row": row, "out_col": col}), z, colour, a)


def numbers(places: DataFrame, size: int) -> list[DataFrame]:
    """Badges for places (x: left side, y: middle, text, colour as #rrggbb): white with a rim of the colour, and digits."""
    wide, high = (F.length("text") * (GLYPH_WIDTH + 1) + 3) * size, (GLYPH_HEIGHT + 4) * size
    left, top = F.floor("x"), F.floor(F.col("y") - high / 2)
    whole = places.select("*", left.alias("left"), top.alias("top"), wide.alias("wide")).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(high - 1)))).withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)))
    rim = (F.col("_r") < size) | (F.col("_r") >= high - size) | (F.col("_c") < size) | (F.col("_c") >= F.col("wide") - size)
    corner = ((F.col("_r") < size) | (F.col("_r") >= high - size)) & ((F.col("_c") < size) | (F.col("_c") >= F.col("wide") - size))
    rgb = labels.rgb(F.col("colour"))
    drawn = whole.where(~corner).withColumns({"out_row": F.col("top") + F.col("_r"), "out_col": F.col("left") + F.col("_c")})
    # where badges touch, one pixel is one badge's
    drawn = drawn.groupBy("out_row", "out_col").agg(F.min(F.struct("left", "top", F.struct(*[F.when(rim, rgb[i]).otherwise(255).alias(c) for i, c in enumerate("rgb")]).alias("k")))["k"].alias("k"))
    digits = places.select((F.floor("x") + 2 * size).alias("x"), (F.floor(F.col("y") - high / 2) + 2 * size).alias("y"), "text")
    return [_coloured(drawn, BADGE, [F.col(f"k.{c}") for c in "rgb"]), text(digits, size, DIGITS, (17, 17, 17))]


def panel(spark: SparkSession, top: int, width: int, metres_per_px: float) -> tuple[list[DataFrame], int]:
    """The legend's ground under the picture with the two colours' squares and the scale bar, and its height. Texts are
    the caller's (see `present.legend`), by `text` with a table of letters."""
    unit = max(1, width // 140)
    height, left = 12 * unit, width * 3 // 5
    out = [rectangle(spark, 0, top, width, height, PANEL, (255, 255, 255))]
    for k, colour in enumerate((labels.DECREASE, labels.INCREASE)):
        rgb = [int(colour[i : i + 2], 16) for i in (1, 3, 5)]
        out.append(rectangle(spark, left, top + (1 + 3 * k) * unit, 2 * unit, 2 * unit, KEYS, rgb))
    bar = next((v for v in labels.NICE if v >= width * 0.15 * metres_per_px), labels.LONGEST)
    length = min(int(bar / metres_per_px), width - left)
    out.append(rectangle(spark, left, top + 8 * unit, length, unit, KEYS, (0, 0, 0)))
    return out, height


def picture(found: DataFrame, drawn: DataFrame, grid: Grid, out_height: int, out_width: int, places: DataFrame | None = None, mark: tuple[str, dict] | None = None) -> tuple[DataFrame, int]:
    """The composed picture and its height: a background (of `present`), changes, numbers (places as `numbers` takes them),
    the arrow, a mark at the lower right (a text and its letters' glyphs), and the legend's panel below."""
    import math

    spark = found.sparkSession
    layers = [background(drawn), *changes(found, grid, out_height, out_width), *north_arrow(spark, out_width)]
    size = max(1, out_width // 450)
    if places is not None:
        layers += numbers(places, size)
    if mark is not None:
        big = max(1, out_width // 24 // GLYPH_HEIGHT)
        at = spark.createDataFrame([(float(out_width - out_width // 60 - len(mark[0]) * (GLYPH_WIDTH + 1) * big), float(out_height - out_width // 60 - GLYPH_HEIGHT * big), mark[0])], "x double, y double, text string")
        layers.append(text(at, big, MARK, (255, 255, 255), 200 / 255, mark[1]))
    inside = [layer.where(F.col("out_row").between(0, out_height - 1) & F.col("out_col").between(0, out_width - 1)) for layer in layers]
    west, south, east, north = grid.bounds()
    below, height = panel(spark, out_height, out_width, grid.scale * math.cos(math.radians((south + north) / 2)) * grid.width / out_width)
    return compose([*inside, *below]), out_height + height


def picture_png(rows: DataFrame, height: int, width: int) -> bytes:
    """The picture, whose size `map_size` limits, as a PNG file; pixels stream to it."""
    raster = bytearray(b"\0\0\0\xff" * (height * width))
    for p in rows.toLocalIterator():
        at = (p.out_row * width + p.out_col) * 4
        raster[at : at + 3] = bytes((p.r, p.g, p.b))
    return png(width, height, bytes(raster))
