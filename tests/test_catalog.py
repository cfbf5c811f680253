import datetime as dt
import json
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from chronoscape.functions import grid
from chronoscape.operators import catalog, cover, mosaic
from chronoscape.sources import adapters, catalogue

AOI = (0.0, 0.0, 10.0, 10.0)


def item(k, day, orbit, box=(0, 0, 10, 10), **more):
    w, s, e, n = map(float, box)
    p = {"datetime": f"{day}T04:00:00Z", "sat:relative_orbit": orbit, "sat:orbit_state": "Descending", "sar:instrument_mode": "IW"} | more
    return {"id": f"S{k}", "geometry": {"type": "Polygon", "coordinates": [[[w, s], [e, s], [e, n], [w, n], [w, s]]]}, "properties": p, "assets": {"vv": {"href": f"v{k}"}, "VH": {"href": f"h{k}"}, "x": {"href": "x"}}}


def table(spark, items):
    return spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(items)], "seq long, item string")


def test_items_become_scenes(spark):
    bad = item(2, "2026-06-01", 5)
    del bad["assets"]["VH"]
    plain = item(3, "2026-06-01", 5)
    del plain["properties"]["sar:instrument_mode"], plain["properties"]["sat:orbit_state"]
    got = catalog.scenes(table(spark, [item(0, "2026-06-01", 5), item(1, "2026-06-01", 5, **{"sar:instrument_mode": "EW"}), bad, plain])).collect()
    assert [r.id for r in got] == ["S0", "S3"] and got[0].orbit_state == "descending" and got[1].orbit_state == "" and got[0].hrefs == {"VV": "v0", "VH": "h0"} and got[0].day == dt.date(2026, 6, 1)


def test_plan(spark):
    days = [str(dt.date(2026, 5, 29) + dt.timedelta(days=6 * k)) for k in range(12)]
    items = [item(f"{d}a", d, 36, (0, 0, 10, 6) if d == "2026-06-22" else (0, 0, 10, 10)) for d in days] + [item("split", "2026-06-22", 36, (0, 6, 10, 10))] + [item(f"{d}b", d, 109, (0, 0, 3, 10), **{"sat:orbit_state": "ascending"}) for d in days]
    found = catalog.scenes(table(spark, items))
    plan = catalog.make_plan(found, catalog.Request(AOI, "2026-07-04", "2026-08-04"))
    assert plan.orbit == 36 and plan.orbit_state == "descending"
    assert [str(d) for d in plan.before] == ["2026-06-22", "2026-06-28", "2026-07-04"] and [str(d) for d in plan.after] == ["2026-07-22", "2026-07-28", "2026-08-03"]
    assert plan.scenes.where("day = '2026-06-22'").count() == 2 and len(plan.all_before) == 7
    rows = {r.orbit: r for r in plan.table.collect()}
    assert rows[36].coverage == pytest.approx(1) and rows[109].coverage == pytest.approx(0.3)
    assert catalog.make_plan(found, catalog.Request(AOI, "2026-07-04", "2026-08-04", orbit_pass="ASCENDING")).orbit == 109
    few = catalog.make_plan(found, catalog.Request(AOI, "2026-07-04", "2026-07-12", images=20))
    assert len(few.before) == 7 and any("images wanted" in n for n in catalog.notes(few, catalog.Request(AOI, "2026-07-04", "2026-07-12", images=20)))
    with pytest.raises(ValueError):
        catalog.make_plan(found, catalog.Request(AOI, "2026-07-04", "2026-08-04", orbit=7))


def test_cover_of_polygons():
    rng = random.Random(3)
    tri = [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)]
    assert cover.share([[tri]], AOI) == pytest.approx(0.5)
    assert cover.share([[tri], [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)]]], AOI) == pytest.approx(0.75)
    assert cover.share([], AOI) == 0 and cover.share([[], [[]], [tri[:2]]], AOI) == 0
    square = lambda w, s, e, n: [(w, s), (e, s), (e, n), (w, n), (w, s)]
    assert cover.share([[square(0, 0, 10, 10), square(2, 2, 8, 8)]], AOI) == pytest.approx(0.64)
    assert cover.share([[square(0, 0, 10, 10)[::-1], square(2, 2, 8, 8)], [square(4, 4, 5, 5)]], AOI) == pytest.approx(0.65)
    assert cover.share([[square(-9, -9, 19, 19), square(-1, -1, 11, 11)]], AOI) == 0 and cover.share([[square(-9, -9, 19, 19)]], AOI) == 1
    shapes = [[(rng.uniform(-3, 13), rng.uniform(-3, 13)) for _ in range(3)] for _ in range(6)]
    assert cover.share([[t] for t in shapes], AOI) == pytest.approx(dense([[t] for t in shapes]), abs=0.01)


def dense(polygons, n=150):
    """Share of points that lie in a polygon, by rays."""
    points = [(10 * (i + 0.5) / n, 10 * (j + 0.5) / n) for i in range(n) for j in range(n)]
    crossed = lambda p, rings: sum((a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0] for r in rings for a, b in zip(r, r[1:] + r[:1]))
    return sum(any(crossed(p, rings) % 2 for rings in polygons) for p in points) / len(points)


def tilted(rng):
    x, y, a, b = rng.uniform(-4, 8), rng.uniform(-4, 8), rng.uniform(2, 7), rng.uniform(-2, 2)
    return [[x, y], [x + a, y + b], [x + a - b, y + a + b], [x - b, y + a], [x, y]]


def holed(rng):
    ring = tilted(rng)
    (x, y), m = [sum(p[i] for p in ring[:4]) / 4 for i in (0, 1)], rng.uniform(0.2, 0.8)
    return [ring, [[x + (p - x) * m, y + (q - y) * m] for p, q in ring]]


def test_few_edges_or_many_give_the_same_area(monkeypatch):
    rng = random.Random(4)
    for n in (1, 5, 40):
        shapes = [holed(rng) for _ in range(n)]
        monkeypatch.setattr(cover, "FEW", 10**9)
        want = cover.share(shapes, AOI)
        assert want == pytest.approx(dense(shapes, 60), abs=0.02)
        for few in (4, 30):
            monkeypatch.setattr(cover, "FEW", few)
            assert cover.share(shapes, AOI) == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("most", [cover.MOST, 12])
def test_coverage_by_boxes_equals_one_sweep(spark, monkeypatch, most):
    monkeypatch.setattr(cover, "MOST", most)
    rng = random.Random(5)
    rows, want = [], {}
    for orbit in range(6):
        polygons = [holed(rng) if k % 2 else [tilted(rng)] for k in range(orbit + 1)]
        rows += [(orbit, "before", ("Polygon", [p])) for p in polygons + polygons[:1]] + [(orbit, "before", ("MultiPolygon", polygons[:2])), (orbit, "before", (None, None))]
        want[orbit] = cover.share(polygons, AOI)
    rows.append((9, "before", ("Polygon", [[[[20.0, 20.0], [21.0, 20.0], [21.0, 21.0], [20.0, 20.0]]]])))
    found = spark.createDataFrame(rows, f"orbit int, side string, geometry struct<type:string,coordinates:{cover.POLYGONS}>")
    got = {r.orbit: r.coverage for r in catalog.coverage(found, AOI).collect()}
    assert got.keys() == {*want, 9} and got[9] == 0
    assert all(got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())


def test_many_rings_are_covered_fast():
    """Forty thousand edges, in memory that grows with their number."""
    rng = random.Random(6)
    small = [[[[x, y], [x + 0.1, y + 0.02], [x + 0.08, y + 0.12], [x - 0.02, y + 0.1]]] for x, y in ((rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(10_000))]
    assert 0.5 < cover.share(small, AOI) < 0.75


def test_parts_and_holes_of_catalogue_items(spark):
    square = lambda w, s, e, n: [[w, s], [e, s], [e, n], [w, n], [w, s]]
    shapes = [("Polygon", [square(0, 0, 10, 10), square(2, 2, 8, 8)]), ("MultiPolygon", [[square(0, 0, 4, 4)], [square(6, 6, 10, 10)]]), ("Point", [1, 2]), ("Polygon", [square(30, 30, 31, 31)])]
    found = catalog.scenes(table(spark, [item(k, "2026-07-01", 5) | {"geometry": {"type": t, "coordinates": c}} for k, (t, c) in enumerate(shapes)])).withColumn("side", F.lit("before"))
    assert [r.id for r in catalog.search(found, AOI, "2026-01-01", "2027-01-01").orderBy("seq").collect()] == ["S0", "S1"]
    one = lambda k: catalog.coverage(found.where(F.col("seq") == k), AOI).first().coverage
    assert [one(k) for k in range(4)] == pytest.approx([0.64, 0.32, 0, 0])
    windows = [((3, 3, 7, 7), [1]), ((1, 1, 3, 3), [0, 1]), ((4.5, 4.5, 5.5, 5.5), []), ((9, 9, 12, 12), [0, 1]), ((30.2, 30.2, 30.4, 30.4), [3])]
    for box, want in windows:
        meets = found.where(grid.polygons_meet(F.col("geometry.coordinates"), *[F.lit(float(v)) for v in box]))
        assert [r.seq for r in meets.orderBy("seq").collect()] == want, box


def test_polygons_meet_boxes_as_dense_points_do(spark):
    rng = random.Random(7)
    rows = [(i, tilted(rng), *(v for x, y in [(rng.uniform(-6, 12), rng.uniform(-6, 12))] for v in (x, y, x + rng.uniform(1, 8), y + rng.uniform(1, 8)))) for i in range(150)]
    df = spark.createDataFrame(rows, "i long, ring array<array<double>>, west double, south double, east double, north double")
    got = {r.i: r.m for r in df.select("i", grid.ring_meets(F.col("ring"), *map(F.col, ("west", "south", "east", "north"))).alias("m")).collect()}
    side = lambda p, a, b: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    for i, ring, w, s, e, n in rows:
        deepest = max(min(side((w + (e - w) * u / 40, s + (n - s) * v / 40), a, b) for a, b in zip(ring, ring[1:])) for u in range(41) for v in range(41))
        if abs(deepest) > 1e-1 or got[i] != (deepest >= 0):
            assert got[i] == (deepest >= 0) or abs(deepest) < 0.5, (i, deepest)
    assert 20 < sum(got.values()) < 130



def test_mosaic_takes_the_first_whole_scene(spark):
    rows = [(0, 1, 0, 0, 1.0, None), (0, 2, 0, 0, 2.0, 2.5), (0, 3, 0, 0, 3.0, 3.5), (0, 1, 0, 1, float("nan"), 1.0), (0, 2, 0, 1, -1.0, 1.0), (0, 2, 0, 2, 5.0, 9.0), (1, 4, 0, 2, 6.0, 6.5)]
    df = spark.createDataFrame(rows, "pass_idx int, scene_seq long, row int, col int, vv double, vh double")
    got = {(r.pass_idx, r.row, r.col): (r.vv, r.vh) for r in mosaic.mosaic(df, nodata=9.0).collect()}
    assert got == {(0, 0, 0): (2.0, 2.5), (1, 0, 2): (6.0, 6.5)}


def test_touching_boxes_equal_brute_force(spark):
    rng = random.Random(4)
    box = lambda: (x := rng.uniform(-5, 5), y := rng.uniform(-5, 5), x + rng.uniform(0, 4), y + rng.uniform(0, 4))
    a, b = [(i, *box()) for i in range(40)], [(i, *box()) for i in range(30)] + [(99, 1.0, 1.0, 2.0, 2.0)]
    a.append((88, 2.0, 2.0, 3.0, 3.0))
    scenes = spark.createDataFrame(a, "seq long, west double, south double, east double, north double")
    tiles = spark.createDataFrame(b, "tile_id long, west double, south double, east double, north double")
    got = sorted((r.seq, r.tile_id) for r in mosaic.touching(scenes, tiles).select("seq", "tile_id").collect())
    assert got == sorted((i, j) for i, w, s, e, n in a for j, x, y, u, v in b if w <= u and e >= x and s <= v and n >= y)


def test_wide_boxes_are_dealt_to_few_cells(spark):
    rng = random.Random(8)
    box = lambda most: (x := rng.uniform(-180, 100), y := rng.uniform(-90, 20), x + rng.uniform(0, most), y + rng.uniform(0, most))
    a, b = [(i, *box((0.5, 7, 40, 700)[i % 4])) for i in range(60)], [(i, *box((1, 30, 90)[i % 3])) for i in range(40)]
    a.append((88, -64.0, -64.0, 0.0, 0.0))
    columns = "west double, south double, east double, north double"
    scenes, tiles = spark.createDataFrame(a, f"seq long, {columns}"), spark.createDataFrame(b, f"tile_id long, {columns}")
    want = sorted((i, j) for i, w, s, e, n in a for j, x, y, u, v in b if w <= u and e >= x and s <= v and n >= y)
    assert sorted((r.seq, r.tile_id) for r in mosaic.touching(scenes, tiles).collect()) == want
    cells = mosaic._own_cells(scenes.where("seq % 4 < 3 or seq = 88")).groupBy("seq").count()  # the others may be wider than the world
    assert {r["count"] for r in cells.collect()} <= {1, 2, 3, 4}


@pytest.mark.parametrize("few", [0, 100_000])
def test_footprints_are_looked_at_once(spark, monkeypatch, few):
    """Ten passes over each of two tilted footprints, in boxes that are the same."""
    monkeypatch.setattr(mosaic, "FEW_PAIRS", few)
    seen, meets = [], mosaic._boxes_meet
    monkeypatch.setattr(mosaic, "_boxes_meet", lambda s, w: (seen.append(s.count()), meets(s, w))[1])
    tilted, other = [[10.0, 0.0], [40.0, 10.0], [30.0, 40.0], [0.0, 30.0]], [[0.0, 0.0], [40.0, 40.0], [0.0, 40.0]]
    scenes = spark.createDataFrame([(k, 0.0, 0.0, 40.0, 40.0, other if k % 2 else tilted) for k in range(20)], "seq long, west double, south double, east double, north double, ring array<array<double>>")
    tiles = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0), (2, 30.0, 1.0, 33.0, 3.0), (3, 18.0, 18.0, 19.0, 19.0)], "tile_id long, west double, south double, east double, north double")
    got = sorted((r.seq, r.tile_id) for r in mosaic.touching(scenes, tiles).select("seq", "tile_id").collect())
    assert got == sorted((k, t) for k in range(20) for t in ((1, 3) if k % 2 else (3,))) and seen == [2]


def pages(method, url, body):
    if method == "POST" and "token" not in body:
        assert body["datetime"] == "2026-06-01T00:00:00Z/2026-06-30T23:59:59Z"
        return {"features": [item(0, "2026-06-01", 1)], "links": [{"rel": "next", "method": "POST", "href": url, "body": body | {"token": 1}}]}
    if method == "POST":
        return {"features": [item(1, "2026-06-02", 1)], "links": [{"rel": "next", "href": "http://x/3"}]}
    return {"features": [item(2, "2026-06-30", 1)]}


def test_paged_search_and_signing():
    got = list(catalogue.search_pages("http://x", "c", AOI, "2026-06-01", "2026-07-01", pages))
    assert [x["id"] for x in got] == ["S0", "S1", "S2"]
    calls, clock = [], [dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)]

    def tokens(method, url, body):
        calls.append(url)
        return {"token": f"t{len(calls)}", "msft:expiry": (clock[0] + dt.timedelta(hours=1)).isoformat().replace("+00:00", "Z")}

    signer = catalogue.Signer("http://t", tokens, lambda: clock[0])
    for other in ("/local/file.tif", "file:///local/file.tif", "s3://bucket/file.tif"):
        assert signer.sign(other) == other and not calls
    assert signer.sign("http://a") == "http://a?t1" and signer.sign("http://a?b=1") == "http://a?b=1&t1"
    clock[0] += dt.timedelta(minutes=56)
    assert signer.sign("http://a") == "http://a?t2"
    places = catalogue.search_places("q", "http://p", lambda m, u, b: [{"display_name": "P", "boundingbox": ["50.1", "50.2", "30.1", "30.2"]}])
    assert places == [("P", (30.1, 50.1, 30.2, 50.2))]


def test_offline_catalogue_reads_a_page_for_a_page(tmp_path, monkeypatch):
    """The bytes read grow with the items, not with their square; pages, files and days are met whole."""
    import builtins

    want, read = [], []
    for d in range(1, 6):
        (tmp_path / f"day=2026-06-0{d}").mkdir()
        for n, size in enumerate((80, 0, 37, 3 * d) if d != 3 else ()):
            lines = [json.dumps(item(1000 * d + 100 * n + k, f"2026-06-0{d}", 1)) for k in range(size)]
            (tmp_path / f"day=2026-06-0{d}" / f"part-{n}").write_text("".join(f"{x}\n" for x in lines))
            want += [json.loads(x)["id"] for x in lines if 1 < d < 5]

    real_open, methods = builtins.open, []

    def counted(file, *args, **kw):
        f = real_open(file, *args, **kw)
        if "part-" not in str(file):
            return f

        class Counted:
            seek, tell = f.seek, f.tell
            __enter__ = lambda self: self
            __exit__ = lambda self, *_: f.close()

            def readline(self):
                read.append(1)
                return f.readline()

            def __iter__(self):
                return iter(self.readline, type(f.read(0))())

        return Counted()

    monkeypatch.setattr(builtins, "open", counted)
    ask = lambda *a: (methods.append(a[0]), adapters.offline_catalogue(*a))[1]
    got = [x["id"] for x in catalogue.search_pages(f"file://{tmp_path}", "c", AOI, "2026-06-02", "2026-06-05", ask)]
    assert got == want and {"GET", "POST"} == set(methods)
    assert len(want) <= len(read) <= len(want) + len(methods) + 20


def test_data_source(spark):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])

    class Fake(catalogue.CatalogueSource):
        @classmethod
        def name(cls):
            return "fake_catalogue"

        @staticmethod
        def fetch(method, url, body):
            first, last = (x[:10] for x in body["datetime"].split("/"))
            return {"features": [item(k, d, k) for k, d in enumerate(("2026-06-01", "2026-06-15", "2026-06-30")) if first <= d <= last]}

    catalogue.register(spark, Fake)
    df = spark.read.format("fake_catalogue").options(url="http://x", bbox=json.dumps(AOI), start="2026-06-01", end="2026-07-01", partitions=3).load()
    assert [r.id for r in catalog.scenes(df).orderBy("seq").collect()] == ["S0", "S1", "S2"]
    assert df.where(F.col("day") >= dt.date(2026, 6, 10)).count() == 2
