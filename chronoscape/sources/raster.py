"""Scenes' images to observations on the grid: windows of tiled images, moved by nearest neighbour."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import Grid
from ..functions.projection import Raster
from ..operators.mosaic import valid
from ..operators.resample import cells_of, places, warp_nearest
from .geotiff import GeoTiffSource, read_header, read_images


def observations(spark: SparkSession, images: list[tuple[int, int, str, str]], grid: Grid, bands: tuple[str, ...] = ("vv", "vh"), cells: DataFrame | None = None, tiles: int = 4, source: type[GeoTiffSource] = GeoTiffSource) -> DataFrame:
    """pass_idx, scene_seq, row, col and bands on the grid, for images (pass_idx, scene_seq, band, path).

    Images that lie alike are moved together. Of each, only tiles within the window that the wanted cells (row, col;
    all by default) need are fetched. Pixels that lack a band, or that are not above zero in one, are left out."""
    alike: dict[Raster, list] = {}
    for pass_idx, scene, band, path in images:
        header = read_header(path, source.fetch)
        if header.raster is None or header.raster.epsg == 0:
            raise ValueError(f"the image does not say where it lies: {path.split('?')[0]}")
        alike.setdefault(header.raster, []).append((pass_idx, scene, band, path))
    target, parts = Raster.of_grid(grid), []
    wanted = cells if cells is not None else cells_of(spark, target)
    for raster, own in alike.items():
        box = places(wanted, raster, target).agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("s_row", "s_col")]).first()
        if box.min_s_row is None:
            continue
        pixels = read_images(spark, [x[3] for x in own], tiles, source)
        pixels = pixels.where(F.col("row").between(box.min_s_row, box.max_s_row) & F.col("col").between(box.min_s_col, box.max_s_col) & (F.col("band") == 0))
        names = F.broadcast(spark.createDataFrame(own, "pass_idx int, scene_seq long, name string, path string"))  # a row an image
        values = [F.max(F.when(F.col("name") == b, F.col("value"))).alias(b) for b in bands]
        whole = pixels.where(valid(F.col("value"))).join(names, "path").groupBy("pass_idx", "scene_seq", "row", "col").agg(*values).dropna()
        parts.append(warp_nearest(whole, raster, target, wanted).select("pass_idx", "scene_seq", "row", "col", *bands))
    empty = spark.createDataFrame([], "pass_idx int, scene_seq long, row int, col int, " + ", ".join(f"{b} double" for b in bands))
    return reduce(DataFrame.unionByName, parts, empty)
