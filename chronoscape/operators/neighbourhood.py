"""Moving sums, edges and blocks over sparse pixel tables (row int, col int).

A moving sum deals pixels to tiles, those near a tile's rim to its neighbours as well, and adds up along rows and then
along columns of a tile. So about one row a pixel is shuffled whatever the size of the window, a task holds one tile,
and absent neighbours are simply not there.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pixels a side of the tiles in which windows are summed.
TILE = 256


def _along(a: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Sums of `size` neighbours along an axis, which gets shorter by size - 1."""
    n = a.shape[axis] - size + 1
    cut = lambda i: a[(slice(None),) * axis + (slice(i, i + n),)]
    if size <= 9:
        return sum((cut(i) for i in range(1, size)), cut(0))
    total = np.cumsum(a, axis=axis)
    ends = total[(slice(None),) * axis + (slice(size - 1, None),)]
    return ends - np.concatenate((np.zeros_like(cut(0)[(slice(None),) * axis + (slice(0, 1),)]), total[(slice(None),) * axis + (slice(0, n - 1),)]), axis=axis)


def window_sums(df: DataFrame, values: Sequence[str], size: int, height: int, width: int, keys: Sequence[str] = (), own: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """keys, row and col of every pixel there is, the sums of the values over its size x size window (nulls count as
    nothing), own_{v} for the pixel's own values v in `own`, and centre, the number of rows of the pixel itself.

    Pixels outside the grid are left out."""
    reach = size // 2
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    whole = {v: types[v] in ("int", "bigint", "smallint", "tinyint") for v in values}
    kind = lambda v: "long" if whole[v] else "double"
    inside = df.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)).select(*keys, "row", "col", *values)
    if not reach:
        sums = [F.coalesce(F.sum(v), F.lit(0)).cast(kind(v)) for v in values]
        return inside.groupBy(*keys, "row", "col").agg(*[c.alias(v) for c, v in zip(sums, values)], *[c.alias(f"own_{v}") for c, v in zip(sums, values) if v in own], F.count("*").alias("centre"))
    near = [F.floor(F.least(F.greatest(F.col(c) + d, F.lit(0)), F.lit(n - 1)) / tile).cast("int") for c, n in (("row", height), ("col", width)) for d in (-reach, reach)]
    dealt = inside.withColumn("_tr", F.explode(F.sequence(*near[:2]))).withColumn("_tc", F.explode(F.sequence(*near[2:])))
    side = tile + 2 * reach
    names = [*keys, "row", "col", *values, *[f"own_{v}" for v in own], "centre"]

    def run(table: pa.Table) -> pa.Table:
        top, left = table.column("_tr")[0].as_py() * tile, table.column("_tc")[0].as_py() * tile
        r, c = table.column("row").to_numpy() - top + reach, table.column("col").to_numpy() - left + reach
        at = r * side + c
        fill = lambda x: np.bincount(at, x, side * side).reshape(side, side)
        there = fill(None)
        y, x = np.nonzero(there[reach : side - reach, reach : side - reach])
        first = {k: table.column(k).slice(0, 1).take(pa.array(np.zeros(len(y), np.int64))) for k in keys}
        out = {"row": (y + top).astype(np.int32), "col": (x + left).astype(np.int32)}
        for v in values:
            cells = fill(table.column(v).cast(pa.float64()).fill_null(0.0).to_numpy())
            got = {v: _along(_along(cells, size, 1), size, 0)[y, x]} | ({f"own_{v}": cells[y + reach, x + reach]} if v in own else {})
            out |= {n: np.rint(g).astype(np.int64) if whole[v] else g for n, g in got.items()}
        out["centre"] = there[y + reach, x + reach].astype(np.int64)
        return pa.table(first | {n: pa.array(g) for n, g in out.items()}).select(names)

    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "row int, col int", *[f"{v} {kind(v)}" for v in values], *[f"own_{v} {kind(v)}" for v in own], "centre long"])
    return dealt.groupBy(*keys, "_tr", "_tc").applyInArrow(run, schema)


def edges(mask: DataFrame, height: int, width: int) -> DataFrame:
    """Pixels of the mask with a neighbour above, below, left or right that is not in it; the outside is not."""
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    moved = mask.select("row", "col", F.explode(steps).alias("o")).select((F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col"), ((F.col("o.r") == 0) & (F.col("o.c") == 0)).alias("own"))
    return moved.groupBy("row", "col").agg(F.max("own").alias("own"), F.count("*").alias("n")).where("own and n < 5").select("row", "col")


def block_mean(df: DataFrame, value: str, factor: int, keys: Sequence[str] = ()) -> DataFrame:
    """Means over factor x factor blocks of the pixels there are: block_row, block_col, mean."""
    block = [F.floor(F.col(c) / factor).cast("int").alias(f"block_{c}") for c in ("row", "col")]
    return df.groupBy(*keys, *block).agg(F.avg(value).alias("mean"))


def any_in_block(mask: DataFrame, factor: Column | float, keys: Sequence[str] = ()) -> DataFrame:
    """Output pixels (out_row, out_col) that hold any pixel of the mask, for `factor` output pixels a pixel."""
    out = [F.floor(F.col(c) * factor).cast("int").alias(f"out_{c}") for c in ("row", "col")]
    return mask.select(*keys, *out).distinct()
