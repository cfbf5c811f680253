"""Images and the grid: projections, tiled TIFF, nearest neighbours, mosaics in rounds, windows and order statistics."""

import json
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from chronoscape.functions import projection, stats
from chronoscape.functions.grid import Grid
from chronoscape.functions.projection import Raster
from chronoscape.operators import mosaic, neighbourhood, resample
from chronoscape.sources import geotiff, raster
from chronoscape.sources.catalogue import SourceError


def test_transverse_mercator(spark):
    """Against the meridian's length by numbers, and there and back in several zones."""
    e2 = projection.ECCENTRICITY**2
    phi = np.radians(np.linspace(0, 50, 200_001))
    mid = (phi[1:] + phi[:-1]) / 2
    length = (projection.MAJOR * (1 - e2) / (1 - e2 * np.sin(mid) ** 2) ** 1.5).sum() * (phi[1] - phi[0])
    places = spark.createDataFrame([(33.0, 50.0), (30.2, 50.5), (35.9, 10.0), (34.0, -70.0)], "lon double, lat double")
    x, y = projection.to_plane(32636, F.col("lon"), F.col("lat"))
    lon, lat = projection.from_plane(32636, x, y)
    rows = places.select("lon", "lat", x.alias("x"), y.alias("y"), lon.alias("l"), lat.alias("b")).collect()
    assert rows[0].x == pytest.approx(500_000) and rows[0].y == pytest.approx(0.9996 * length, abs=1e-3)
    assert all(abs(r.l - r.lon) < 1e-10 and abs(r.b - r.lat) < 1e-10 for r in rows)
    south = places.where("lat < 0").select(projection.to_plane(32736, F.col("lon"), F.col("lat"))[1].alias("y")).first().y
    assert south == pytest.approx(rows[3].y + 10_000_000)
    assert projection.utm_zone(30.2, 50.5) == 32636 and projection.utm_zone(180.0, -1.0) == 32760
    # conformal: a small step north and one east are equally long and at right angles
    d = 1e-5
    step = spark.createDataFrame([(31.0, 50.0), (31.0, 50.0 + d), (31.0 + d, 50.0)], "lon double, lat double")
    a, n, e = [np.array([r.x, r.y]) for r in step.select(x.alias("x"), y.alias("y")).collect()]
    m = projection.MAJOR * (1 - e2) / (1 - e2 * math.sin(math.radians(50)) ** 2) ** 1.5
    p = projection.MAJOR * math.cos(math.radians(50)) / math.sqrt(1 - e2 * math.sin(math.radians(50)) ** 2)
    assert np.linalg.norm(n - a) / m == pytest.approx(np.linalg.norm(e - a) / p, rel=1e-5) and abs(np.dot(n - a, e - a)) < 1e-4
    with pytest.raises(ValueError):
        projection.to_plane(32661, x, y)


def test_nearest_neighbours_as_by_hand(spark):
    source, target = Raster(3857, 0.0, 100.0, 10.0, -10.0, 10, 10), Raster(3857, 12.0, 95.0, 4.0, -4.0, 30, 12)
    pixels = spark.createDataFrame([(p, r, c, 100.0 * r + c) for p in (0, 1) for r in range(10) for c in range(10) if (r + c) % 7], "pass_idx int, row int, col int, v double")
    got = {(r.pass_idx, r.row, r.col): r.v for r in resample.warp_nearest(pixels, source, target).collect()}
    want = {}
    for r in range(12):
        for c in range(30):
            s, t = int((100 - (95 - (r + 0.5) * 4)) // 10), int((12 + (c + 0.5) * 4) // 10)
            if s < 10 and t < 10 and (s + t) % 7:
                want |= {(p, r, c): 100.0 * s + t for p in (0, 1)}
    assert got == want and len(got) > 300


@pytest.mark.parametrize("predictor", [1, 3])
def test_images_are_written_and_read(spark, tmp_path, predictor):
    rng = random.Random(1)
    place = Raster(32636, 300_000.0, 5_600_000.0, 10.0, -10.0, 70, 45)
    rows = [(f"file://{tmp_path}/{k}.tif", r, c, rng.uniform(0, 9)) for k in range(3) for r in range(45) for c in range(70) if rng.random() < 0.5 and (r < 16 or c < 32)]
    df = spark.createDataFrame(rows, "path string, row int, col int, value double").repartition(5)
    made = {r.path: r.tiles for r in geotiff.write_images(df, place, 16, predictor=predictor).collect()}
    assert set(made.values()) == {5 + 2 * 2}
    header = geotiff.read_header(rows[0][0])
    assert header.raster == place and (header.nodata, header.dtype, header.predictor) == (-9999.0, "f8", predictor)
    got = sorted((r.path, r.row, r.col, r.value) for r in geotiff.read_images(spark, sorted(made)).collect())
    assert got == sorted(rows)
    part = geotiff.read_images(spark, sorted(made)).where(f"row between 10 and 20 and col = 17 and path = '{rows[0][0]}'").collect()
    assert sorted((r.row, r.value) for r in part) == sorted((r, v) for p, r, c, v in rows if p == rows[0][0] and 10 <= r <= 20 and c == 17)


def plain(path, data, order="<", strip_rows=None, tile=None, planar=1, predictor=1, packed=False, nodata=None):
    """A TIFF of (height, width, samples) by the rules of the format, one tag after the other."""
    h, w, n = data.shape
    kind = {"u": 1, "i": 2, "f": 3}[data.dtype.kind]
    blocks = []
    for plane in [data[:, :, i : i + 1] for i in range(n)] if planar == 2 else [data]:
        if tile:
            full = np.zeros((-(-h // tile) * tile, -(-w // tile) * tile, plane.shape[2]), data.dtype)
            full[:h, :w] = plane
            blocks += [full[r : r + tile, c : c + tile] for r in range(0, full.shape[0], tile) for c in range(0, full.shape[1], tile)]
        else:
            blocks += [plane[r : r + strip_rows] for r in range(0, h, strip_rows)]
    if predictor == 2:
        blocks = [np.diff(b, axis=1, prepend=np.zeros_like(b[:, :1])) for b in blocks]
    raw = [b.astype(b.dtype.newbyteorder(order)).tobytes() for b in blocks]
    raw = [zlib.compress(b) for b in raw] if packed else raw
    at, offsets = 8, []
    for b in raw:
        offsets.append(at)
        at += len(b)
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [data.dtype.itemsize * 8] * n), (259, 3, [8 if packed else 1]), (277, 3, [n]), (284, 3, [planar]), (317, 3, [predictor]), (339, 3, [kind] * n)]
    tags += [(322, 3, [tile]), (323, 3, [tile]), (324, 4, offsets), (325, 4, [len(b) for b in raw])] if tile else [(273, 4, offsets), (278, 4, [strip_rows]), (279, 4, [len(b) for b in raw])]
    size = {3: ("H", 2), 4: ("I", 4)}
    head, spare = struct.pack(order + "H", len(tags) + (nodata is not None)), b""
    beyond = at + 2 + 12 * (len(tags) + (nodata is not None)) + 4
    for tag, kind, values in sorted(tags):
        body = struct.pack(f"{order}{len(values)}{size[kind][0]}", *values)
        if len(body) <= 4:
            head += struct.pack(order + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        else:
            head += struct.pack(order + "HHII", tag, kind, len(values), beyond + len(spare))
            spare += body
    if nodata is not None:
        body = f"{nodata}\0".encode()
        head += struct.pack(order + "HHI", 42113, 2, len(body)) + (body.ljust(4, b"\0") if len(body) <= 4 else struct.pack(order + "I", beyond + len(spare)))
        spare += body if len(body) > 4 else b""
    path.write_bytes(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, at) + b"".join(raw) + head + b"\0" * 4 + spare)
    return str(path)


@pytest.mark.parametrize("how", [{"strip_rows": 7}, {"strip_rows": 7, "packed": True}, {"tile": 16}, {"tile": 16, "packed": True, "predictor": 2}, {"tile": 16, "planar": 2, "order": ">"}, {"strip_rows": 45, "planar": 2, "packed": True, "order": ">"}])
@pytest.mark.parametrize("kind", ["u1", "i2", "f4"])
def test_layouts_of_other_writers(tmp_path, how, kind):
    if how.get("predictor") == 2 and kind == "f4":
        how = how | {"predictor": 1}
    data = np.random.default_rng(3).integers(0, 100, (45, 37, 2)).astype(kind)
    path = plain(tmp_path / "x.tif", data, nodata=7, **how)
    reader = geotiff._Reader({"paths": json.dumps([path])}, geotiff.read_range)
    got = np.full(data.shape, 7.0)
    for part in reader.partitions():
        for b in reader.read(part):
            band, row, col, value = (c.to_numpy() for c in b.columns[1:])
            got[row, col, band] = value
    assert (got == data).all()


def test_only_tiles_of_the_window_are_fetched(tmp_path):
    data = np.arange(64 * 64 * 2, dtype="f4").reshape(64, 64, 2)
    paths = [plain(tmp_path / f"{k}.tif", data, tile=16, planar=2) for k in range(2)]
    fetched = []

    def fetch(path, start, size):
        fetched.append((path, size))
        return geotiff.read_range(path, start, size)

    reader = geotiff._Reader({"paths": json.dumps(paths)}, fetch)
    filters = [GreaterThanOrEqual(("row",), 16), LessThan(("row",), 32), EqualTo(("col",), 40), In(("band",), (1,)), EqualTo(("path",), paths[1])]
    assert list(reader.pushFilters(filters)) == filters
    parts = reader.partitions()
    assert [p.tiles for p in parts] == [[(1, 1, 2)]]
    fetched.clear()
    rows = [b for p in parts for b in reader.read(p)]
    assert fetched == [(paths[1], 16 * 16 * 4)] and sum(b.num_rows for b in rows) == 256
    assert list(reader.read(geotiff.Tiles(None, []))) == []
    wide = geotiff._Reader({"paths": json.dumps(paths), "tiles": "8"}, fetch)
    assert [len(p.tiles) for p in wide.partitions()] == [8] * 8


def test_images_that_cannot_be_read(tmp_path):
    (tmp_path / "x.tif").write_bytes(b"no image at all")
    for path in ("x.tif", "missing.tif"):
        with pytest.raises(SourceError):
            geotiff.read_header(str(tmp_path / path))
    packed = bytearray(open(plain(tmp_path / "y.tif", np.zeros((4, 4, 1), "u1"), strip_rows=4), "rb").read())
    at = packed.index(struct.pack("<HHIH", 259, 3, 1, 1))
    packed[at + 8] = 5
    (tmp_path / "y.tif").write_bytes(packed)
    with pytest.raises(SourceError, match="Compression 5"):
        geotiff.read_header(str(tmp_path / "y.tif"))


def test_scenes_come_onto_the_grid(spark, tmp_path):
    grid = Grid.over((30.205, 50.502, 30.209, 50.505))
    place = Raster(32636, 301_400.0, 5_599_500.0, 10.0, -10.0, 200, 200)
    df = spark.range(200 * 200).select(F.floor(F.col("id") / 200).cast("int").alias("row"), (F.col("id") % 200).cast("int").alias("col"))
    value = F.when((F.col("row") + F.col("col")) % 5 == 0, -1.0).otherwise(F.col("row") * 1000.0 + F.col("col"))
    images = [(1, 4, b, f"file://{tmp_path}/{b}.tif") for b in ("vv", "vh")]
    pixels = df.withColumn("path", F.explode(F.array(*[F.lit(i[3]) for i in images]))).withColumn("value", value)
    geotiff.write_images(pixels, place, 32).collect()
    got = raster.observations(spark, images, grid).collect()
    at = resample.places(resample.cells_of(spark, Raster.of_grid(grid)), place, Raster.of_grid(grid)).collect()
    want = {(a.row, a.col): a.s_row * 1000.0 + a.s_col for a in at if (a.s_row + a.s_col) % 5}
    assert len(at) == grid.pixels and {(r.row, r.col): r.vv for r in got} == want and all(r.vv == r.vh and (r.pass_idx, r.scene_seq) == (1, 4) for r in got)
    assert raster.observations(spark, images, Grid.over((10.0, 10.0, 10.01, 10.01))).count() == 0


def test_rounds_read_later_scenes_for_holes_only(spark):
    rng = random.Random(8)
    grid = Grid(0.0, 0.0, 10.0, 12, 9)
    raw = [(p, s, r, c, rng.choice([1.0 + s, float("nan"), 0.0]) if s else 5.0 + c, 2.0) for p in (0, 1) for s in range(4) for r in range(9) for c in range(12) if s or (p == 0 and r < 4) or rng.random() < 0.9]
    df = spark.createDataFrame(raw, "pass_idx int, scene_seq long, row int, col int, vv double, vh double")
    tile = grid.tile_id(F.col("row"), F.col("col"), 4).alias("tile_id")
    asked = []

    def read(tasks):
        asked.append({(t.pass_idx, t.scene_seq, t.tile_id) for t in tasks.collect()})
        return df.withColumn("tile_id", tile).join(tasks, ["pass_idx", "scene_seq", "tile_id"], "left_semi")

    got = mosaic.mosaic_in_rounds(df.select("pass_idx", "scene_seq", tile), read, grid, 4)
    key = lambda rows: sorted((r.pass_idx, r.row, r.col, r.vv, r.vh) for r in rows)
    assert key(got.collect()) == key(mosaic.mosaic(df).collect())
    assert asked[0] == {(p, 0, t) for p in (0, 1) for t in range(9)}
    assert all(not (p == 0 and t < 3) for later in asked[1:] for p, _, t in later) and asked[1]
    one = df.where("pass_idx = 0 and row < 4")
    asked.clear()
    mosaic.mosaic_in_rounds(one.select("pass_idx", "scene_seq", tile), read, grid, 4).count()
    assert len(asked) == 1
    assert mosaic.mosaic_in_rounds(df.limit(0).select("pass_idx", "scene_seq", tile), read, grid, 4).count() == 0


@pytest.mark.parametrize("size", [1, 3, 5, 11])
def test_window_sums_by_hand(spark, size):
    rng = random.Random(size)
    rows = [(p, r, c, rng.choice([None, rng.uniform(0, 9)]), rng.randrange(5)) for p in (0, 1) for r in range(-1, 20) for c in range(17) if rng.random() < 0.5]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "p int, row int, col int, v double, n int")
    got = {(r.p, r.row, r.col): r for r in neighbourhood.window_sums(df, ["v", "n"], size, 20, 16, ["p"], own=["n"], tile=6).collect()}
    inside = [x for x in rows if 0 <= x[1] < 20 and x[2] < 16]
    assert got.keys() == {x[:3] for x in inside}
    for (p, r, c), g in got.items():
        near = [x for x in inside if x[0] == p and abs(x[1] - r) <= size // 2 and abs(x[2] - c) <= size // 2]
        own = [x for x in near if x[1:3] == (r, c)]
        assert g.v == pytest.approx(sum(x[3] or 0 for x in near)) and g.n == sum(x[4] for x in near) and (g.own_n, g.centre) == (sum(x[4] for x in own), len(own))


def test_windows_shuffle_few_rows(spark):
    """Rims aside, a pixel is dealt once, whatever the size of the window."""
    df = spark.range(200 * 200).select(F.floor(F.col("id") / 200).cast("int").alias("row"), (F.col("id") % 200).cast("int").alias("col"), F.lit(1.0).alias("v"))
    for size in (3, 9):
        plan = neighbourhood.window_sums(df, ["v"], size, 200, 200, tile=64)
        assert plan.agg(F.sum("v")).first()[0] == sum(sum(1 for d in range(-(size // 2), size // 2 + 1) if 0 <= x + d < 200) for x in range(200)) ** 2
        reach = size // 2
        copies = sum(len({(x - reach) // 64 if x >= reach else 0, min(199, x + reach) // 64}) for x in range(200)) ** 2 / 200**2
        assert copies < 1.3


@pytest.mark.parametrize("seed", range(4))
def test_order_values(spark, seed):
    rng = random.Random(seed)
    draw = [lambda: rng.gauss(0, 1), lambda: float(rng.randrange(3)), lambda: math.exp(rng.uniform(-600, 600)) * rng.choice([-1, 1]), lambda: 1.0 + rng.randrange(50) * 2**-52][seed]
    values = [draw() for _ in range(3000)] + [7.25] * 1000
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    ranks = [0, 1, 999, 1000, 2500, 3998, 3999]
    assert stats.order_values(df, "x", ranks, bins=16, few=40) == [sorted(values)[r] for r in ranks]


def test_quartiles_equal_the_built_in_ones(spark):
    rng = random.Random(9)
    for n in (1, 2, 5, 403):
        df = spark.createDataFrame([(rng.gauss(0, 1),) for _ in range(n)] + [(float("nan"),), (None,), (float("-inf"),)], "log_ratio double")
        fine = df.where("not isnan(log_ratio) and abs(log_ratio) < 1e300")
        want = fine.agg(F.count("*"), F.percentile("log_ratio", F.lit(0.25)), F.percentile("log_ratio", F.lit(0.75))).first()
        assert tuple(stats.quartiles(df).first()) == tuple(want)
    assert tuple(stats.quartiles(df.limit(0)).first()) == (0, None, None)


def files_read(node):
    """Files that each scan of a partitioned table has read, of a plan that has run."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return files_read(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return files_read(node.plan())
    if kind == "FileSourceScanExec":
        return [node.metrics().get("numFiles").get().value()] if node.relation().partitionSchema().length() else []
    return [n for i in range(node.children().size()) for n in files_read(node.children().apply(i))]


def test_windows_of_a_result_list_their_tiles_only(spark, tmp_path):
    from chronoscape.plans.analysis import Params
    from chronoscape.storage import Store

    grid = Grid(0.0, 0.0, 10.0, 50, 40)
    pixels = spark.range(2000).select(F.floor(F.col("id") / 50).cast("int").alias("row"), (F.col("id") % 50).cast("int").alias("col"), F.col("id").alias("v"))
    store, params = Store(spark, f"file://{tmp_path}"), Params("a", (1.0, 1.0, 2.0, 2.0), "2026-01-01", "2026-02-01")
    store.save(params, {"x": 1}, {"pixel_change": pixels, "overview": pixels.select(F.col("v").alias("block"))}, grid, 8)
    header, tables = store.load(params)
    assert header["x"] == 1 and tables["pixel_change"].columns == ["row", "col", "v"] and tables["pixel_change"].count() == 2000
    windows = spark.createDataFrame([(1, 7, 9, 3, 2), (2, -5, 45, 6, 90), (3, 40, 0, 1, 1), (4, 3, 3, 0, 5)], "w int, row int, col int, height int, width int")
    got = store.load_windows(params, "pixel_change", windows)
    inside = lambda w, r, c, h, n: {(w, i, j, i * 50 + j) for i in range(r, r + h) for j in range(c, c + n) if 0 <= i < 40 and 0 <= j < 50}
    assert {tuple(r) for r in got.collect()} == inside(1, 7, 9, 3, 2) | inside(2, -5, 45, 6, 90)
    plan = got._jdf.queryExecution().executedPlan()
    assert "dynamicpruning" in plan.toString().lower()
    assert files_read(plan) == [2 + 2]
    store.save(params, {}, {"pixel_change": pixels})
    with pytest.raises(ValueError):
        store.load_windows(params, "pixel_change", windows)
