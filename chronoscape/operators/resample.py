"""Rasters moved onto other grids: by nearest neighbour, or with a kernel that weights the neighbours."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.projection import Raster, from_plane, to_plane


def places(cells: DataFrame, source: Raster, target: Raster) -> DataFrame:
    """row and col of cells of the target with s_row and s_col, the pixel of the source under their centres; cells that
    the source does not reach are left out."""
    x, y = target.centre(F.col("row"), F.col("col"))
    if source.epsg != target.epsg:
        x, y = to_plane(source.epsg, *from_plane(target.epsg, x, y))
    s_row, s_col = source.pixel(x, y)
    got = cells.select("row", "col", F.explode(F.array(F.struct(s_row.alias("s_row"), s_col.alias("s_col")))).alias("_s")).select("row", "col", "_s.*")
    return got.where(F.col("s_row").between(0, source.height - 1) & F.col("s_col").between(0, source.width - 1))


def cells_of(spark, target: Raster) -> DataFrame:
    n = F.col("id")
    return spark.range(target.width * target.height).select(F.floor(n / target.width).cast("int").alias("row"), (n % target.width).cast("int").alias("col"))


def warp_nearest(pixels: DataFrame, source: Raster, target: Raster, cells: DataFrame | None = None) -> DataFrame:
    """pixels (row, col of the source and other columns) on the target's grid, by nearest neighbour, so that no value
    is mixed. A source pixel may serve several cells, and a cell has as many rows as its source pixel (passes, bands).

    Each cell looks up its source pixel (an inverse mapping), so the join is one of equal keys; the places are worked out
    once a cell, not once a pass. cells: those of the target that are wanted (row, col), all by default."""
    at = places(cells if cells is not None else cells_of(pixels.sparkSession, target), source, target)
    others = [c for c in pixels.columns if c not in ("row", "col")]
    own = pixels.withColumnsRenamed({"row": "s_row", "col": "s_col"})
    return own.join(at, ["s_row", "s_col"]).select(*[c for c in pixels.columns if c in others], "row", "col")


def _box(x: Column) -> Column:
    return F.when((x > -0.5) & (x <= 0.5), 1.0).otherwise(0.0)


def _bilinear(x: Column) -> Column:
    return F.greatest(1 - F.abs(x), F.lit(0.0))


def _lanczos(x: Column) -> Column:
    y = x * math.pi
    return F.when(x == 0, 1.0).when(F.abs(x) < 3, F.sin(y) / y * (F.sin(y / 3) / (y / 3))).otherwise(0.0)


#: Kernels and how far they reach.
KERNELS = {"box": (_box, 0.5), "bilinear": (_bilinear, 1.0), "lanczos": (_lanczos, 3.0)}


def taps(spark: SparkSession, kernel: str, n_out: int, n_in: int, start: float, step: float) -> DataFrame:
    """out, at, weight: the source places that a place of the output draws on along one axis, with weights that add up to 1.

    Output place k lies over the source from start + k * step on. Where the output is coarser than the source, the
    kernel is stretched, so that no source pixel is passed over; what would reach beyond the source's ends is left out."""
    shape, reach = KERNELS[kernel]
    stretch = max(step, 1.0)
    centre = (F.col("id") + 0.5) * step + start
    first = F.greatest(F.floor(centre - reach * stretch + 0.5), F.lit(0))
    last = F.least(F.floor(centre + reach * stretch + 0.5), F.lit(n_in)) - 1
    each = spark.range(n_out).where(last >= first).select(F.col("id").cast("int").alias("out"), centre.alias("_c"), F.explode(F.sequence(first, last)).alias("_at"))
    each = each.select("out", F.col("_at").cast("int").alias("at"), shape((F.col("_at") - F.col("_c") + 0.5) / stretch).alias("weight"))
    total = each.groupBy("out").agg(F.sum("weight").alias("_all"))
    return each.join(total, "out").select("out", "at", (F.col("weight") / F.col("_all")).alias("weight")).where("weight <> 0")


def resize(pixels: DataFrame, values: Sequence[str], rows: DataFrame, cols: DataFrame) -> DataFrame:
    """out_row, out_col and the weighted sums of the values: pixels (row, col) through the taps of both axes.

    One axis after the other, so a pixel meets a row's taps and then a column's, not their product; sums combine before
    they are shuffled. Pixels that are not there count as zero; output pixels over nothing are not there."""
    weighted = lambda: [F.sum(F.col(v) * F.col("weight")).alias(v) for v in values]
    down = pixels.join(rows.select(F.col("out").alias("out_row"), F.col("at").alias("row"), "weight"), "row").groupBy("out_row", "col").agg(*weighted())
    return down.join(cols.select(F.col("out").alias("out_col"), F.col("at").alias("col"), "weight"), "col").groupBy("out_row", "out_col").agg(*weighted())
