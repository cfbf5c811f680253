"""Tiled TIFF images as a Spark data source: a partition for each run of tiles that a pushed window and band meet.

Headers are read when partitions are planned, a few kilobytes a file; tasks fetch the bytes of their own tiles, from
files or by range requests over HTTP. Known are strips and tiles, no compression and deflate, the two predictors, whole
numbers and floats of 8 to 64 bits, the no-data value, and the place and projection in GeoTIFF's tags; anything else
is refused with its name. Classic TIFF with either byte order.
"""

from __future__ import annotations

import json
import os
import struct
import urllib.error
import urllib.request
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions.projection import Raster
from .catalogue import SourceError

# Numbers of the tags that are read, sizes of field types, kinds of samples.
TAGS = {
    "width": 256, "height": 257, "bits": 258, "compression": 259, "strip_offsets": 273, "samples": 277, "strip_rows": 278, "strip_sizes": 279, "planar": 284, "predictor": 317,
    "tile_width": 322, "tile_height": 323, "tile_offsets": 324, "tile_sizes": 325, "kind": 339, "pixel_scale": 33550, "tie_point": 33922, "geo_keys": 34735, "nodata": 42113,
}
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
KINDS = {1: "u", 2: "i", 3: "f"}
PROJECTED, GEOGRAPHIC = 3072, 2048
NONE, DEFLATE, OLD_DEFLATE = 1, 8, 32946
PIXELS = "path string, band int, row int, col int, value double"


def read_range(path: str, start: int, size: int) -> bytes:
    """Bytes of a file or, by a range request, of a web address."""
    try:
        if path.startswith(("http://", "https://")):
            ask = urllib.request.Request(path, headers={"Range": f"bytes={start}-{start + size - 1}"})
            with urllib.request.urlopen(ask, timeout=60) as reply:
                return reply.read(size) if reply.status == 206 else reply.read(start + size)[start:]
        with open(path.removeprefix("file://"), "rb") as f:
            f.seek(start)
            return f.read(size)
    except (OSError, urllib.error.URLError) as e:
        raise SourceError(f"The image cannot be read: {path.split('?')[0]}") from e


@dataclass(frozen=True)
class Header:
    path: str
    order: str
    width: int
    height: int
    tile_width: int
    tile_height: int
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    dtype: str
    samples: int
    planar: bool
    compression: int
    predictor: int
    nodata: float | None
    raster: Raster | None
    tiled: bool

    @property
    def across(self) -> int:
        return -(-self.width // self.tile_width)

    @property
    def down(self) -> int:
        return -(-self.height // self.tile_height)

    def tiles(self, rows: tuple[int, int], cols: tuple[int, int], bands: set[int] | None) -> Iterator[tuple[int, int, int]]:
        """Plane, tile row and tile column of what the window (first and last row and column) and the bands meet."""
        planes = range(self.samples) if self.planar else (0,)
        for p in planes:
            if bands is None or (p in bands if self.planar else bands & set(range(self.samples))):
                for r in range(max(0, rows[0]) // self.tile_height, min(self.height - 1, rows[1]) // self.tile_height + 1):
                    for c in range(max(0, cols[0]) // self.tile_width, min(self.width - 1, cols[1]) // self.tile_width + 1):
                        yield p, r, c

    def decode(self, data: bytes, rows: int) -> np.ndarray:
        """A tile as (rows, columns, samples)."""
        if self.compression in (DEFLATE, OLD_DEFLATE):
            data = zlib.decompress(data)
        samples = 1 if self.planar else self.samples
        kind = np.dtype(self.order + self.dtype)
        if self.predictor == 3:  # bytes of a row by significance, each as the difference to the one before
            raw = np.frombuffer(data, np.uint8)[: rows * self.tile_width * samples * kind.itemsize].reshape(rows, -1, samples)
            raw = np.cumsum(raw, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, self.tile_width * samples)
            return np.ascontiguousarray(raw.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, self.tile_width, samples)
        out = np.frombuffer(data, kind)[: rows * self.tile_width * samples].reshape(rows, self.tile_width, samples)
        return np.cumsum(out, axis=1, dtype=kind.newbyteorder("=")) if self.predictor == 2 else out

    def read(self, plane: int, r: int, c: int, fetch: Callable) -> np.ndarray | None:
        """A tile without what reaches over the edge; None where the file leaves it out."""
        at = (plane * self.down + r) * self.across + c
        if not self.sizes[at]:
            return None
        rows = self.tile_height if self.tiled else min(self.tile_height, self.height - r * self.tile_height)  # the last strip ends with the image
        tile = self.decode(fetch(self.path, self.offsets[at], self.sizes[at]), rows)
        return tile[: self.height - r * self.tile_height, : self.width - c * self.tile_width]


def read_header(path: str, fetch: Callable = read_range) -> Header:
    head = fetch(path, 0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or struct.unpack(order + "H", head[2:4])[0] != 42:
        raise SourceError(f"This is no classic TIFF: {path}")
    (at,) = struct.unpack(order + "I", head[4:])
    (count,) = struct.unpack(order + "H", fetch(path, at, 2))
    entries, found = fetch(path, at + 2, 12 * count), {}
    names = {v: k for k, v in TAGS.items()}
    for i in range(count):
        tag, kind, n = struct.unpack(order + "HHI", entries[12 * i : 12 * i + 8])
        if tag in names and kind in TYPES:
            form = f"{order}{n * len(TYPES[kind])}{TYPES[kind][0]}" if kind != 2 else f"{n}s"
            size = struct.calcsize(form)
            raw = entries[12 * i + 8 : 12 * i + 12]
            raw = raw[:size] if size <= 4 else fetch(path, struct.unpack(order + "I", raw)[0], size)
            found[names[tag]] = struct.unpack(form, raw)
    one = lambda name, default=None: found[name][0] if name in found else default
    if len(set(found.get("bits", (1,)))) > 1 or one("bits", 1) not in (8, 16, 32, 64) or one("kind", 1) not in KINDS:
        raise SourceError(f"Samples of this kind are not known: {path}")
    if one("compression", 1) not in (NONE, DEFLATE, OLD_DEFLATE):
        raise SourceError(f"Compression {one('compression')} is not known: {path}")
    if one("predictor", 1) not in (1, 2, 3):
        raise SourceError(f"Predictor {one('predictor')} is not known: {path}")
    width, height, tiled = one("width"), one("height"), "tile_offsets" in found
    raster = None
    if "pixel_scale" in found and "tie_point" in found:
        keys = found.get("geo_keys", ())
        codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        (dx, dy, *_), (i, j, _, x, y, *_) = found["pixel_scale"], found["tie_point"]
        raster = Raster(codes.get(PROJECTED) or codes.get(GEOGRAPHIC) or 0, x - i * dx, y + j * dy, dx, -dy, width, height)
    text = one("nodata", b"").rstrip(b"\0 ").decode() if "nodata" in found else ""
    return Header(
        path, order, width, height, one("tile_width") if tiled else width, one("tile_height") if tiled else min(height, one("strip_rows", height)),
        found["tile_offsets" if tiled else "strip_offsets"], found["tile_sizes" if tiled else "strip_sizes"], f"{KINDS[one('kind', 1)]}{one('bits', 8) // 8}",
        one("samples", 1), one("planar", 1) == 2, one("compression", 1), one("predictor", 1), float(text) if text else None, raster, tiled,
    )


@dataclass
class Tiles(InputPartition):
    header: Header
    tiles: list[tuple[int, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, options, fetch):
        self.o, self.fetch = options, fetch
        self.span = {"row": [0, 2**31 - 2], "col": [0, 2**31 - 2]}
        self.bands: set[int] | None = None
        self.paths: set[str] | None = None

    def pushFilters(self, filters):
        """Windows, bands and paths narrow what is fetched; Spark applies all filters again."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            some = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if name in self.span and some is None and isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                low, high = self.span[name]
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.span[name][0] = max(low, f.value + isinstance(f, GreaterThan))
                else:
                    self.span[name][1] = min(high, f.value - isinstance(f, LessThan))
            elif name in self.span and some:
                self.span[name] = [max(self.span[name][0], min(some)), min(self.span[name][1], max(some))]
            elif name == "band" and some:
                self.bands = some if self.bands is None else self.bands & some
            elif name == "path" and some:
                self.paths = some if self.paths is None else self.paths & some
            yield f

    def partitions(self):
        run, out = int(self.o.get("tiles", 1)), []
        for path in json.loads(self.o["paths"]):
            if self.paths is None or path in self.paths:
                header = read_header(path, self.fetch)
                met = list(header.tiles(tuple(self.span["row"]), tuple(self.span["col"]), self.bands))
                out += [Tiles(header, met[i : i + run]) for i in range(0, len(met), run)]
        return out or [Tiles(None, [])]

    def read(self, part):
        for plane, r, c in part.tiles:
            h = part.header
            tile = h.read(plane, r, c, self.fetch)
            for s in range(tile.shape[2] if tile is not None else 0):
                band = plane if h.planar else s
                if self.bands is None or band in self.bands:
                    value = tile[:, :, s].astype(float)
                    row, col = np.nonzero(np.isfinite(value) & (value != h.nodata if h.nodata is not None else True))
                    arrays = [pa.array([h.path] * len(row), pa.string()), pa.array(np.full(len(row), band, np.int32)), pa.array((row + r * h.tile_height).astype(np.int32)), pa.array((col + c * h.tile_width).astype(np.int32)), pa.array(value[row, col])]
                    yield pa.RecordBatch.from_arrays(arrays, names=["path", "band", "row", "col", "value"])


class GeoTiffSource(DataSource):
    """Options paths (JSON list), tiles (of a partition, 1). Columns path, band (from 0), row, col, value; no-data values and those that are not finite have no row."""

    fetch = staticmethod(read_range)

    @classmethod
    def name(cls):
        return "geotiff"

    def schema(self):
        return PIXELS

    def reader(self, schema):
        return _Reader(dict(self.options), type(self).fetch)


def register(spark, source: type[GeoTiffSource] = GeoTiffSource) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)


def read_images(spark, paths: list[str], tiles: int = 1, source: type[GeoTiffSource] = GeoTiffSource) -> DataFrame:
    register(spark, source)
    return spark.read.format(source.name()).options(paths=json.dumps(paths), tiles=str(tiles)).load()


# ---------------------------------------------------------------- writing


def _entry(tag: str, kind: int, values) -> tuple[int, int, bytes, int]:
    if kind == 2:
        return TAGS[tag], kind, values, len(values)
    values = list(values) if isinstance(values, (list, tuple)) else [values]
    return TAGS[tag], kind, struct.pack(f"<{len(values)}{TYPES[kind]}", *values), len(values)


def _directory(at: int, entries: list) -> bytes:
    """The tags of an image, which begin at a place of the file; long values follow them."""
    entries = sorted(entries)
    spare, head = b"", struct.pack("<H", len(entries))
    beyond = at + 2 + 12 * len(entries) + 4
    for tag, kind, raw, n in entries:
        if len(raw) <= 4:
            head += struct.pack("<HHI", tag, kind, n) + raw.ljust(4, b"\0")
        else:
            head += struct.pack("<HHII", tag, kind, n, beyond + len(spare))
            spare += raw + b"\0" * (len(raw) % 2)
    return head + struct.pack("<I", 0) + spare


def write_images(pixels: DataFrame, raster: Raster, tile: int = 256, nodata: float = -9999.0, predictor: int = 1) -> DataFrame:
    """Write pixels (path, row, col, value) as deflated one-band float64 images of the raster; returns path and tiles of each.

    Rows are brought together by image and sorted by tile, so a task holds one tile at a time; tiles without pixels take
    no place in the file. Paths are files in a folder that all executors share; one appears when it is whole."""
    across, down = -(-raster.width // tile), -(-raster.height // tile)

    def run(batches):
        state: dict = {}

        def flush():
            if state.get("tile") is not None:
                data = state["data"]
                if predictor == 3:
                    raw = data.astype(">f8").view(np.uint8).reshape(tile, tile, 8).transpose(0, 2, 1).reshape(tile, -1)
                    raw = np.diff(raw, axis=1, prepend=np.uint8(0))
                else:
                    raw = data.astype("<f8")
                packed = zlib.compress(raw.tobytes())
                state["offsets"][state["tile"]], state["sizes"][state["tile"]] = state["file"].tell(), len(packed)
                state["file"].write(packed)
                state["tile"] = None

        def close():
            flush()
            f = state["file"]
            f.write(b"\0" * (f.tell() % 2))
            at = f.tell()
            geo = [1, 1, 0, 1, PROJECTED if raster.epsg != 4326 else GEOGRAPHIC, 0, 1, raster.epsg]
            f.write(_directory(at, [
                _entry("width", 4, raster.width), _entry("height", 4, raster.height), _entry("bits", 3, 64), _entry("compression", 3, DEFLATE), _entry("samples", 3, 1), _entry("planar", 3, 1), _entry("predictor", 3, predictor),
                _entry("tile_width", 4, tile), _entry("tile_height", 4, tile), _entry("tile_offsets", 4, state["offsets"]), _entry("tile_sizes", 4, state["sizes"]), _entry("kind", 3, 3),
                _entry("pixel_scale", 12, [raster.dx, -raster.dy, 0.0]), _entry("tie_point", 12, [0.0, 0.0, 0.0, raster.x0, raster.y0, 0.0]), _entry("geo_keys", 3, geo), _entry("nodata", 2, f"{nodata:g}\0".encode()),
            ]))
            f.seek(0)
            f.write(struct.pack("<2sHI", b"II", 42, at))
            f.close()
            os.replace(f.name, state["path"].removeprefix("file://"))
            return pa.RecordBatch.from_arrays([pa.array([state["path"]]), pa.array([sum(n > 0 for n in state["sizes"])], pa.int32())], names=["path", "tiles"])

        for batch in batches:
            paths, rows, cols, values = batch.column(0), *(c.to_numpy() for c in batch.columns[1:])
            number = (rows // tile) * across + cols // tile
            names = np.array(paths.to_pylist(), object)
            cut = np.flatnonzero(np.append(True, (names[1:] != names[:-1]) | (number[1:] != number[:-1]))) if len(rows) else []
            for a, b in zip(cut, [*cut[1:], len(rows)]):
                if state.get("path") != names[a]:
                    if state:
                        yield close()
                    state = {"path": names[a], "file": open(f"{names[a].removeprefix('file://')}.{uuid.uuid4().hex}", "wb"), "offsets": [0] * (across * down), "sizes": [0] * (across * down)}
                    state["file"].write(b"\0" * 8)
                if state.get("tile") != number[a]:
                    flush()
                    state["tile"], state["data"] = int(number[a]), np.full((tile, tile), nodata)
                state["data"][rows[a:b] % tile, cols[a:b] % tile] = values[a:b]
        if state:
            yield close()

    order = [F.col("path"), F.floor(F.col("row") / tile), F.floor(F.col("col") / tile)]
    inside = pixels.where(F.col("row").between(0, raster.height - 1) & F.col("col").between(0, raster.width - 1))
    own = inside.select("path", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value"))
    return own.repartition("path").sortWithinPartitions(*order).mapInArrow(run, "path string, tiles int")
