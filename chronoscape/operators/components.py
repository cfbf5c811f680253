"""8-connected patches of flagged pixels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import drop_table, materialize

#: A patch is named row * 2^32 + column of its first pixel in raster order.
SHIFT = 32
#: Pixels are first labelled within tiles of this side, so what meets in one task is bounded.
TILE = 1024


def patches(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """For pixels in raster order the name of each one's patch, by joining runs of neighbouring rows."""
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (col[1:] != col[:-1] + 1)))
    begin = np.flatnonzero(new)
    end = np.concatenate((begin[1:], [len(row)])) - 1
    line, first, last = row[begin], col[begin], col[end]
    key = lambda r, c: (r.astype(np.int64) << SHIFT) + c
    # runs of the row above that reach from one pixel left of this run to one right of it
    lo, hi = np.searchsorted(key(line, last), key(line - 1, first - 1)), np.searchsorted(key(line, first), key(line - 1, last + 1), "right")
    root = list(range(len(begin)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in np.flatnonzero(hi > lo).tolist():
        for j in range(int(lo[i]), int(hi[i])):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    top = np.array([find(i) for i in range(len(root))])
    return key(line, first)[top][np.cumsum(new) - 1]


def label_tiles(flagged: DataFrame) -> DataFrame:
    """flagged with part: the name of the pixel's patch within its tile."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending"), ("col", "ascending")])
        named = patches(table.column("row").to_numpy(), table.column("col").to_numpy())
        return table.append_column("part", pa.array(named)).select([f.name for f in schema])

    schema = T.StructType([*flagged.schema.fields, T.StructField("part", T.LongType())])
    tile = [F.floor(F.col(c) / TILE) for c in ("row", "col")]
    return flagged.groupBy(*tile).applyInArrow(run, schema)


def touching_parts(found: DataFrame) -> DataFrame:
    """a, b: parts of different tiles that touch, also at corners; only pixels at tiles' edges are looked at."""
    edge = lambda c: F.pmod(F.col(c), F.lit(TILE)).isin(0, TILE - 1)
    rim = found.where(edge("row") | edge("col")).select("row", "col", "part")
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 1), (1, -1), (1, 0), (1, 1))])
    moved = rim.withColumn("o", F.explode(steps)).select((F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col"), F.col("part").alias("b"))
    return rim.join(moved, ["row", "col"]).where("part <> b").select(F.col("part").alias("a"), "b").distinct()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connect(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the least node of its component) for every node of edges (a, b) that is not its own root.

    Alternating large and small stars centre on least nodes, found by map-side minima; a hot centre is only ever a
    join key whose rows Spark may split. Each round ends in a written table, and the one before is deleted.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        # 32-bit hashes, so that sums cannot overflow
        new = tuple(now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first())
        if new == mark or not new[0]:
            break
        mark, before = new, now
        now = materialize(_small_star(_large_star(now)), "edges")
        drop_table(before)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def label(flagged: DataFrame) -> DataFrame:
    """flagged (row, col, ...) with label: the name of the first pixel, in raster order, of the pixel's patch."""
    found = materialize(label_tiles(flagged), "parts")
    root = connect(touching_parts(found))
    return found.join(root, found.part == root.node, "left").withColumn("label", F.coalesce("root", "part")).select(*flagged.columns, "label")
