"""The exact area that a union of polygons covers within bounds.

A polygon is a list of rings, the first around it and the others around its holes; a point lies in it if a ray from the
point crosses its rings an odd number of times, so neither the direction of rings nor the repeated last point matters.

The bounds are cut into boxes and every polygon into what it has in each box: edges inside, and spans of the box's west
side to the east of which it holds the whole box. A box that one polygon holds alone is covered. The polygons of any
other box are brought together; it is cut into quarters, and again, until few edges are left in each, and these are
swept: between two neighbouring heights at which an edge begins, ends or crosses another, the width where the number of
polygons is above zero changes linearly. Edges are looked at again only where they lie or cross, so the work grows with
their number and that of their crossings, and memory with the edges of a box. A box that holds too many for one task is
quartered by Spark first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import drop_table, materialize

Box = tuple[float, float, float, float]
POLYGONS = "array<array<array<array<double>>>>"
#: Edges that are swept at once; quarterings within a task; edges of a box that one task takes.
FEW, DEEPEST, MOST = 48, 24, 100_000


@dataclass(frozen=True)
class Edges:
    """Edges from (x, y) up to (u, v) with the number of the polygon they belong to; the first `west` lie on the box's west side."""

    of: np.ndarray
    x: np.ndarray
    y: np.ndarray
    u: np.ndarray
    v: np.ndarray
    west: int = 0

    @classmethod
    def of_rings(cls, polygons: Sequence[Sequence[Sequence[Sequence[float]]]]) -> Edges:
        """Level edges bound nothing and are left out; so are rings of fewer than three points and missing ones."""
        parts = []
        for k, rings in enumerate(polygons):
            for ring in rings or ():
                p = np.array([q[:2] for q in ring or ()], float).reshape(-1, 2)
                if len(p) >= 3:
                    q = np.roll(p, -1, axis=0)
                    up = (p[:, 1] < q[:, 1])[:, None]
                    parts.append(np.column_stack((np.full(len(p), k), np.where(up, p, q), np.where(up, q, p)))[p[:, 1] != q[:, 1]])
        return cls(*np.concatenate(parts).T) if parts else cls(*np.zeros((5, 0)))

    def __len__(self) -> int:
        return len(self.x)

    def pack(self) -> bytes:
        return np.stack((self.x, self.y, self.u, self.v)).astype("<f8").tobytes()

    def take(self, keep: np.ndarray) -> Edges:
        return Edges(*(c[keep] for c in (self.of, self.x, self.y, self.u, self.v)))

    def within(self, box: Box) -> Edges:
        """What counts of them in the box; whatever lies to the west of it becomes spans of its west side."""
        west, south, east, north = box
        e = self.take((self.y < north) & (self.v > south))
        slope = (e.u - e.x) / (e.v - e.y)
        low, high = np.maximum(e.y, south), np.minimum(e.v, north)
        at = lambda y: np.where(y == e.y, e.x, np.where(y == e.v, e.u, e.x + (y - e.y) * slope))
        x, u = at(low), at(high)
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = lambda side: np.clip(np.where(x == u, low, e.y + (side - e.x) / slope), low, high)
            left, right = cross(west), cross(east)
        # the part to the west of the box, as a span of its side
        a, b = np.where(x <= west, low, left), np.where(u <= west, high, left)
        a, b = np.where((x > west) & (u > west), low, a), np.where((x > west) & (u > west), low, b)
        spans = _odd(e.of[a < b], a[a < b], b[a < b])
        # the part inside
        first = np.where(x <= west, np.where(u <= west, high, left), np.where(x >= east, np.where(u >= east, high, right), low))
        last = np.where(u <= west, np.where(x <= west, low, left), np.where(u >= east, np.where(x >= east, low, right), high))
        inside = first < last
        f, t = first[inside], last[inside]
        place = lambda y, side: np.clip(np.where(y == low, x, np.where(y == high, u, e.x + (y - e.y) * slope))[inside] if side is None else side, west, east)
        p, q = place(first, None), place(last, None)
        side = np.full(len(spans[0]), west)
        return Edges(np.concatenate((spans[0], e.of[inside])), np.concatenate((side, p)), np.concatenate((spans[1], f)), np.concatenate((side, q)), np.concatenate((spans[2], t)), len(side))

    def whole(self, box: Box) -> np.ndarray:
        """Of edges within a box, the polygons that hold all of it."""
        n = self.west
        all_high = self.of[:n][(self.y[:n] == box[1]) & (self.v[:n] == box[3])]
        return np.setdiff1d(all_high, self.of[n:])


def _odd(of: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans in which an odd number of a polygon's spans lie: its ends in order, two by two."""
    every, owner = np.concatenate((low, high)), np.concatenate((of, of))
    order = np.lexsort((every, owner))
    every, owner = every[order], owner[order]
    a, b = every[::2], every[1::2]
    keep = a < b
    owner, a, b = owner[::2][keep], a[keep], b[keep]
    # spans that touch are one
    new = np.ones(len(a), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (a[1:] != b[:-1])
    end = np.append(np.flatnonzero(new)[1:], len(a)) - 1 if len(a) else np.zeros(0, int)
    return owner[new], a[new], b[end]


def _swept(e: Edges, box: Box) -> float:
    west, south, east, north = box
    slope = (e.u - e.x) / (e.v - e.y)
    base = e.x - slope * e.y
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (base[:, None] - base[None, :]) / (slope[None, :] - slope[:, None])
        cross = at[(at > np.maximum.outer(e.y, e.y)) & (at < np.minimum.outer(e.v, e.v))]
    levels = np.unique(np.concatenate(([south, north], e.y, e.v, cross)))
    mid, high, total = (levels[1:] + levels[:-1]) / 2, np.diff(levels), 0.0
    for k in range(0, len(mid), 512):
        y = mid[k : k + 512, None]
        active = (e.y <= y) & (y < e.v)
        x = np.where(active, np.clip(e.x + slope * (y - e.y), west, east), np.inf)
        order = np.lexsort((x, np.where(active, e.of, np.inf)), axis=1)  # by polygon and place: in and out by turns
        of = np.take_along_axis(np.where(active, e.of, np.inf), order, 1)
        first = np.ones(of.shape, bool)
        first[:, 1:] = of[:, 1:] != of[:, :-1]
        n = np.arange(of.shape[1])
        since = n - np.maximum.accumulate(np.where(first, n, 0), axis=1)
        step = np.where(np.isinf(of), 0, 1 - 2 * (since % 2))
        x = np.take_along_axis(x, order, 1)
        order = np.argsort(x, axis=1, kind="stable")
        x, step = np.take_along_axis(x, order, 1), np.take_along_axis(step, order, 1)
        width = np.diff(np.where(np.isinf(x), east, x), axis=1, append=east)
        total += float((np.where(np.cumsum(step, axis=1) > 0, width, 0).sum(1) * high[k : k + 512]).sum())
    return total


def area(e: Edges, box: Box, deep: int = 0) -> float:
    """Of the union within the box; e: edges within it."""
    west, south, east, north = box
    if not len(e):
        return 0.0
    if len(e.whole(box)):
        return (east - west) * (north - south)
    if len(e) <= FEW or deep == DEEPEST:
        return _swept(e, box)
    return sum(area(e.within(b), b, deep + 1) for b in quarters(box))


def quarters(box: Box) -> list[Box]:
    west, south, east, north = box
    x, y = (west + east) / 2, (south + north) / 2
    return [(west, south, x, y), (x, south, east, y), (west, y, x, north), (x, y, east, north)]


def share(polygons: Sequence, bounds: Box) -> float:
    """Share of the bounds that a few polygons (lists of rings) cover."""
    return area(Edges.of_rings(polygons).within(bounds), bounds) / ((bounds[2] - bounds[0]) * (bounds[3] - bounds[1]))


def polygons_of(kind: Column, coordinates: Column) -> Column:
    """The polygons of a GeoJSON geometry, given its type and its coordinates as JSON; null for other types."""
    one = F.from_json(coordinates, "array<array<array<double>>>")
    return F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", F.from_json(coordinates, POLYGONS))


def covered(shapes: DataFrame, keys: Sequence[str], bounds: Box, cells: int = 8, column: str = "polygons") -> DataFrame:
    """keys and `coverage`: the share of the bounds covered by all polygons of the rows with those keys.

    Rows without polygons, and keys that have none that meet the bounds, give 0. Polygons that occur often count once."""
    west, south, east, north = bounds
    wide, high = (east - west) / cells, (north - south) / cells
    seen = shapes.select(*keys).distinct()
    rings = shapes.select(*keys, F.explode(column).alias("_rings")).distinct().repartition(2 * shapes.sparkSession.sparkContext.defaultParallelism)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in seen.schema.fields)
    schema = f"{kinds}, _at array<double>, _whole boolean, _n int, _edges binary"

    def batch_of(batch, found):
        """found: (rows, box, sizes, edges in order of rows; no edges: the polygon holds the box)."""
        found = [f for f in found if len(f[0])]
        row = np.concatenate([f[0] for f in found]).astype(np.int64) if found else np.zeros(0, np.int64)
        columns = [batch.column(i).take(pa.array(row)) for i in range(len(keys))]
        at = [list(box) for rows, box, *_ in found for _ in rows]
        packed = [x.pack() if x is not None else None for *_, parts in found for x in parts]
        own = [pa.array(at, pa.list_(pa.float64())), pa.array([p is None for p in packed], pa.bool_()), pa.array([len(x) if x is not None else 0 for *_, parts in found for x in parts], pa.int32()), pa.array(packed, pa.binary())]
        return pa.RecordBatch.from_arrays([*columns, *own], names=[*keys, "_at", "_whole", "_n", "_edges"])

    def parts_in(e: Edges, box: Box):
        """What batch_of takes for all polygons of e that count in the box, at once."""
        e = e.within(box)
        whole = e.whole(box)
        e = e.take(np.argsort(e.of, kind="stable"))
        row, first = np.unique(e.of, return_index=True)
        last = np.append(first[1:], len(e))
        holds = np.isin(row, whole)
        return row, box, [None if h else e.take(slice(a, b)) for h, a, b in zip(holds, first, last)]

    def deal(batches):
        edge = lambda start, step, k, end: end if k == cells else start + k * step
        for batch in batches:
            e, found = Edges.of_rings(batch.column(len(keys)).to_pylist()), []
            for j in range(cells):
                strip = (west, edge(south, high, j, north), east, edge(south, high, j + 1, north))
                own = e.within(strip)
                found += [parts_in(own, (edge(west, wide, i, east), strip[1], edge(west, wide, i + 1, east), strip[3])) for i in range(cells if len(own) else 0)]
            yield batch_of(batch, found)

    def quarter(batches):
        for batch in batches:
            found = []
            for i, (box, data) in enumerate(zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist())):
                x = np.frombuffer(data, "<f8").reshape(4, -1)
                found += [parts_in(Edges(np.full(x.shape[1], float(i)), *x), b) for b in quarters(tuple(box))]
            yield batch_of(batch, found)

    def sweep(table: pa.Table) -> pa.Table:
        box = tuple(table.column("_at")[0].as_py())
        x = [np.frombuffer(d, "<f8").reshape(4, -1) for d in sorted(table.column("_edges").to_pylist())]
        e = Edges(np.repeat(np.arange(len(x)), [p.shape[1] for p in x]), *np.concatenate(x, axis=1)).within(box)
        return pa.table({**{k: table.column(k).slice(0, 1) for k in keys}, "_area": [area(e, box)]})

    box_of = Window.partitionBy(*keys, "_at")
    size = (F.col("_at")[2] - F.col("_at")[0]) * (F.col("_at")[3] - F.col("_at")[1])
    dealt, done = rings.mapInArrow(deal, schema), None
    for _ in range(DEEPEST):
        dealt = materialize(dealt.withColumn("_w", F.max("_whole").over(box_of)), "cover-boxes")
        full = dealt.where("_w").select(*keys, "_at").distinct().select(*keys, size.alias("_area"))
        rest = dealt.where("NOT _w").drop("_w")
        heavy = rest.groupBy(*keys, "_at").agg(F.sum("_n").alias("_all")).where(F.col("_all") > MOST).select(*keys, "_at")
        again = not heavy.isEmpty()
        light = rest.join(heavy, [*keys, "_at"], "left_anti") if again else rest
        swept = light.select(*keys, "_at", "_edges").groupBy(*keys, "_at").applyInArrow(sweep, f"{kinds}, _area double")
        done = full.unionByName(swept) if done is None else done.unionByName(full).unionByName(swept)
        if not again:
            break
        dealt = rest.join(heavy, [*keys, "_at"], "left_semi").select(*keys, "_at", "_edges").mapInArrow(quarter, schema)
    else:  # too many edges through one point even there: swept as they are
        done = done.unionByName(dealt.where("NOT _whole").select(*keys, "_at", "_edges").groupBy(*keys, "_at").applyInArrow(sweep, f"{kinds}, _area double"))
        done = done.unionByName(dealt.where("_whole").select(*keys, "_at").distinct().select(*keys, size.alias("_area")))
    total = done.groupBy(*keys).agg((F.sum("_area") / ((east - west) * (north - south))).alias("coverage"))
    return seen.join(total, list(keys), "left").fillna(0.0, ["coverage"])
