"""From scenes' pixels to one value per pass and pixel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import Grid, polygons_meet, ring_meets
from ..storage import drop_table, materialize

#: Sides of the cells, in degrees, that boxes are dealt to; pairs of footprints and windows that may be broadcast.
CELLS = (1, 2, 4, 8, 16, 32, 64, 128, 256, 512)
FEW_PAIRS = 100_000


def valid(value: Column, nodata: Column | None = None) -> Column:
    """A usable intensity: finite, above zero, not the no-data value."""
    ok = value.isNotNull() & ~F.isnan(value) & (value > 0) & (value < F.lit(float("inf")))
    return ok if nodata is None else ok & (value != nodata)


def mosaic(raw: DataFrame, bands: tuple[str, ...] = ("vv", "vh"), nodata: float | None = None) -> DataFrame:
    """pass_idx, row, col and bands: of the scenes that have all bands at a pixel, the first in catalogue order."""
    missing = F.lit(nodata) if nodata is not None else None
    whole = raw
    for b in bands:
        whole = whole.where(valid(F.col(b), missing))
    best = F.min(F.struct("scene_seq", *bands)).alias("best")
    return whole.groupBy("pass_idx", "row", "col").agg(best).select("pass_idx", "row", "col", *[f"best.{b}" for b in bands])


def mosaic_in_rounds(tasks: DataFrame, read: Callable[[DataFrame], DataFrame], grid: Grid, tile: int = 1024, bands: tuple[str, ...] = ("vv", "vh"), nodata: float | None = None) -> DataFrame:
    """The rows of `mosaic`, reading no scene for a tile that earlier scenes have filled.

    tasks: pass_idx, scene_seq, tile_id (of `grid.tile_id`) of scenes that meet a tile; `read` gives the pixels
    (pass_idx, row, col, bands) of such tasks. Round n reads the n-th scene of each tile that still has holes; only
    pixels that no round before filled are added. There are as many rounds as scenes lie over one tile at most."""
    place = F.row_number().over(Window.partitionBy("pass_idx", "tile_id").orderBy("scene_seq"))
    queue = materialize(tasks.select("pass_idx", "scene_seq", "tile_id").distinct().withColumn("place", place), "mosaic-tasks")
    last = queue.agg(F.max("place")).first()[0] or 0
    missing = F.lit(nodata) if nodata is not None else None
    sizes = grid.tiles(queue.sparkSession, tile).select("tile_id", (F.col("width") * F.col("height")).alias("size"))
    done, holes = None, None
    for turn in range(1, last + 1):
        todo = queue.where(F.col("place") == turn)
        if holes is not None:
            todo = todo.join(holes, ["pass_idx", "tile_id"], "left_semi")
            if todo.isEmpty():
                break
        got = read(todo.select("pass_idx", "scene_seq", "tile_id"))
        for b in bands:
            got = got.where(valid(F.col(b), missing))
        got = got.select("pass_idx", "row", "col", *bands, grid.tile_id(F.col("row"), F.col("col"), tile).alias("tile_id"))
        if done is not None:
            got = got.join(done.join(holes, ["pass_idx", "tile_id"], "left_semi").select("pass_idx", "row", "col"), ["pass_idx", "row", "col"], "left_anti")
        own = materialize(got, "mosaic-round")
        done = own if done is None else done.unionByName(own)
        filled = done.groupBy("pass_idx", "tile_id").agg(F.count("*").alias("n"))
        before = holes
        holes = materialize(queue.select("pass_idx", "tile_id").distinct().join(filled, ["pass_idx", "tile_id"], "left").join(sizes, "tile_id").where(F.coalesce("n", F.lit(0)) < F.col("size")).select("pass_idx", "tile_id"), "mosaic-holes")
        if before is not None:
            drop_table(before)
    if done is None:
        return read(queue.select("pass_idx", "scene_seq", "tile_id")).select("pass_idx", "row", "col", *bands)
    return done.select("pass_idx", "row", "col", *bands)


def touching(scenes: DataFrame, windows: DataFrame) -> DataFrame:
    """Pairs of scenes and windows (west, south, east, north each) whose boxes meet; touching counts. Scenes with a column
    ring (array<array<double>>) or polygons (arrays of rings, holes after the outer one) meet a window only if these do.

    A scene's box is dealt to the at most four cells that it meets of a size not below its own, windows to their cells of
    every size, so the join is on cells; a pair found in several cells is reported once, from the cell that holds the
    south-west corner of what the boxes share. Edges are looked at once a footprint and window: scenes that share a
    footprint, as those of later passes do, take over its windows.
    """
    sides = ("west", "south", "east", "north")
    shape = [c for c in ("ring", "polygons") if c in scenes.columns]
    keep = [c for c in scenes.columns if c not in windows.columns]
    others = [c for c in windows.columns if c not in sides]
    if not shape:
        return _boxes_meet(scenes, windows).select(*[f"s.{c}" for c in keep], *[f"w.{c}" for c in others])
    scenes = materialize(scenes, "footprints")
    meet = F.lit(True)
    for column, test in (("ring", ring_meets), ("polygons", polygons_meet)):
        if column in shape:
            meet = meet & test(F.col(f"s.{column}"), *[F.col(f"w.{c}") for c in sides])
    pairs = _boxes_meet(scenes.select(*sides, *shape).distinct(), windows).where(meet)
    pairs = materialize(pairs.select(*[F.col(f"s.{c}").alias(f"_{c}") for c in (*sides, *shape)], *[f"w.{c}" for c in others]), "footprints-met")
    if pairs.count() <= FEW_PAIRS:
        pairs = F.broadcast(pairs)
    same = [F.col(f"s.{c}") == F.col(f"p._{c}") for c in (*sides, *shape)]
    return scenes.alias("s").join(pairs.alias("p"), same).select(*[f"s.{c}" for c in keep], *[f"p.{c}" for c in others])


def _cells(df: DataFrame) -> DataFrame:
    """A row for each cell (_x, _y) of side _size that a row's box meets."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / F.col("_size")), F.floor(F.col(b) / F.col("_size"))))
    return df.withColumn("_x", span("west", "east")).withColumn("_y", span("south", "north"))


def _own_cells(scenes: DataFrame) -> DataFrame:
    """The cells of the least size that a box fits in: four at most."""
    longer = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"))
    fit = F.lit(CELLS[-1])
    for size in reversed(CELLS[:-1]):
        fit = F.when(longer <= size, size).otherwise(fit)
    return _cells(scenes.withColumn("_size", fit))


def _boxes_meet(scenes: DataFrame, windows: DataFrame) -> DataFrame:
    """Pairs of rows s and w whose boxes meet."""
    s, w = _own_cells(scenes).alias("s"), _cells(windows.withColumn("_size", F.explode(F.array(*map(F.lit, CELLS))))).alias("w")
    meet = (F.col("s.west") <= F.col("w.east")) & (F.col("s.east") >= F.col("w.west")) & (F.col("s.south") <= F.col("w.north")) & (F.col("s.north") >= F.col("w.south"))
    own = (F.col("s._x") == F.floor(F.greatest("s.west", "w.west") / F.col("s._size"))) & (F.col("s._y") == F.floor(F.greatest("s.south", "w.south") / F.col("s._size")))
    return s.join(w, (F.col("s._size") == F.col("w._size")) & (F.col("s._x") == F.col("w._x")) & (F.col("s._y") == F.col("w._y")) & meet & own)


def tile_windows(grid: Grid, tiles: DataFrame) -> DataFrame:
    """tile_id and the bounds of each tile in degrees."""
    return tiles.select("tile_id", *[v.alias(k) for k, v in grid.window(F.col("row"), F.col("col"), F.col("height"), F.col("width")).items()])
