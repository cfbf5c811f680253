"""The registered queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

import datetime as dt
import json
import sys
import uuid
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import grid as grids
from ..functions import labels, projection, stats
from ..functions import sql as sql_functions
from ..functions.grid import Grid
from ..functions.projection import Raster
from ..operators import catalog, change, detect, mosaic, neighbourhood, picture, present, resample
from ..sources import adapters, catalogue, geotiff
from ..storage import Store, materialize, shared_dir
from ..streaming import passes as streams
from . import analysis

B = ("vv", "vh")
SMOOTH = 3
BALANCED = detect.PRESETS["Balanced"]


def _obs(spark: SparkSession, sf_dir: str) -> tuple[Grid, DataFrame]:
    grid = adapters.grid_of(spark, sf_dir)
    return grid, adapters.obs(spark, sf_dir, grid.width)


def _compared(spark, sf_dir, size: int, keep=lambda df: df) -> tuple[Grid, dict[str, DataFrame]]:
    grid, obs = _obs(spark, sf_dir)
    return grid, change.pixel_change(obs, adapters.N_BEFORE, stats.NOMINAL_LOOKS * size * size, size, grid.height, grid.width, B, keep)


STORED = ("row", "col", "signed", "change_db")


def q01_pixel_change(spark, sf_dir):
    return _compared(spark, sf_dir, 1)[1]["change"].select(*STORED)


def q02_pixel_change_smooth3(spark, sf_dir):
    return _compared(spark, sf_dir, 3)[1]["change"].select(*STORED)


def q03_pixel_change_smooth5(spark, sf_dir):
    return _compared(spark, sf_dir, 5)[1]["change"].select(*STORED)


def q04_null_change(spark, sf_dir):
    return _compared(spark, sf_dir, 3)[1]["null"].select(*STORED)


def q05_pixel_events(spark, sf_dir):
    grid, obs = _obs(spark, sf_dir)
    return change.pixel_events(obs, adapters.N_BEFORE, stats.NOMINAL_LOOKS * 9, 3, grid.height, grid.width, B)


def q06_overview(spark, sf_dir):
    return change.overview(_compared(spark, sf_dir, 3)[1]["change"])


def q07_one_band(spark, sf_dir):
    grid, obs = _obs(spark, sf_dir)
    got = change.pixel_change(obs.drop("vh"), adapters.N_BEFORE, stats.NOMINAL_LOOKS * 9, 3, grid.height, grid.width, ("vv",))["change"]
    return detect.candidates(got, detect.PRESETS["Sensitive"], 1)


def _flagged(spark, sf_dir, det=BALANCED):
    grid, found = _compared(spark, sf_dir, 3)
    return grid, found, materialize(detect.detect(found["change"], det), "flagged")


def q08_candidates(spark, sf_dir):
    return detect.candidates(_compared(spark, sf_dir, 3)[1]["change"], BALANCED)


def q09_detected(spark, sf_dir):
    _, _, found = _flagged(spark, sf_dir)
    return found.select("row", "col", "increased", "label")


def q10_detected_sensitive(spark, sf_dir):
    _, _, found = _flagged(spark, sf_dir, detect.PRESETS["Sensitive"])
    return found.select("row", "col", "increased", "label")


def _spots(spark, sf_dir):
    grid, _, found = _flagged(spark, sf_dir)
    return grid, detect.spots(found, q05_pixel_events(spark, sf_dir), grid, adapters.PASS_DAYS)


def q11_spots(spark, sf_dir):
    spots = _spots(spark, sf_dir)[1]
    when = F.array_join("when", "; ").alias("seen")
    return spots.select("spot_id", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), F.round("area_m2", 2).alias("area_m2"), F.round("change_db", 4).alias("change_db"), "direction", F.col("times_changed").cast("long").alias("times_changed"), when, F.round("row", 4).alias("row"), F.round("col", 4).alias("col"), "n_pixels")


def q12_spot_csv(spark, sf_dir):
    return detect.spot_lines(_spots(spark, sf_dir)[1]).select("spot_id", "line")


def q13_captions(spark, sf_dir):
    s = _spots(spark, sf_dir)[1]
    return s.select("spot_id", present.caption(F.col("change_db"), F.col("area_m2"), F.col("times_changed"), F.col("when")).alias("caption"), present.badge_colour(F.col("change_db")).alias("colour"))


def q14_summary(spark, sf_dir):
    grid, found = _compared(spark, sf_dir, 3, lambda sums: materialize(sums, "sums"))
    now = materialize(detect.detect(found["change"], BALANCED), "flagged")
    noise = detect.detect(found["null"], BALANCED)
    got = detect.summarise(found["change"], now, found["null"], noise, grid)
    return got.select(*[F.round(c, 6).alias(c) for c in ("analysed_km2", "increase_km2", "decrease_km2", "noise_km2")], "spots", "noise_spots")


def q15_looks(spark, sf_dir):
    """Quartiles of the log ratios of the passes before, whole grid as one sample window, and their number."""
    grid, obs = _obs(spark, sf_dir)
    got = stats.quartiles(change.log_ratios(obs.where(F.col("pass_idx") < adapters.N_BEFORE), 1, grid.height, grid.width, B))
    return got.select("n", F.round("q25", 9).alias("q25"), F.round("q75", 9).alias("q75"))


def _four_places(*names: str):
    """Mean prices to four places; a mean of eight prices may lie halfway between two of them."""
    return [stats.rounded(F.col(c), 4).alias(c) for c in names]


def q16_mosaic(spark, sf_dir):
    grid = adapters.grid_of(spark, sf_dir)
    got = mosaic.mosaic(adapters.raw_obs(spark, sf_dir, grid.width))
    return got.select("pass_idx", "row", "col", *_four_places("vv", "vh"))


def _scenes(spark, sf_dir):
    return catalog.scenes(adapters.items(spark, sf_dir))


def q17_scenes(spark, sf_dir):
    box = catalog.footprint_box(F.col("geometry"))
    return _scenes(spark, sf_dir).select("id", F.col("day").cast("string").alias("day"), "orbit", "orbit_state", "seq", F.col("hrefs")["VV"].alias("vv"), F.col("hrefs")["VH"].alias("vh"), F.size("hrefs").alias("n_hrefs"), box["west"].alias("west"), box["north"].alias("north"))


def _request(**more):
    return catalog.Request(adapters.AOI, adapters.START, adapters.END, lookback=adapters.LOOKBACK, **more)


def q18_orbits(spark, sf_dir):
    found = catalog.sides(catalog.search(_scenes(spark, sf_dir), adapters.AOI, "1990-01-01", "2030-01-01"), _request())
    got = catalog.orbits(found, _request())
    return got.select("orbit", F.round("coverage", 6).alias("coverage"), "before", "after", F.col("gap_days").cast("long").alias("gap_days"))


def q19_best_orbit(spark, sf_dir):
    found = catalog.sides(catalog.search(_scenes(spark, sf_dir), adapters.AOI, "1990-01-01", "2030-01-01"), _request())
    return catalog.best_orbit(catalog.orbits(found, _request())).select("orbit", "before", "after")


def q20_selected_days(spark, sf_dir):
    got = catalog.select_days(catalog.sides(_scenes(spark, sf_dir), _request(orbit_pass="ASCENDING")), None, 3)
    return got.groupBy("orbit", "side", F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n_scenes"), F.min("seq").alias("first_seq"))


def q21_scene_windows(spark, sf_dir):
    box = catalog.footprint_box(F.col("geometry"))
    scenes = _scenes(spark, sf_dir).select("seq", *[v.alias(k) for k, v in box.items()])
    windows = spark.range(16).select(F.col("id").alias("tile_id"), (F.col("id") % 4 * 25).cast("double").alias("west"), (F.floor(F.col("id") / 4) * 25).cast("double").alias("south")).withColumns({"east": F.col("west") + 25, "north": F.col("south") + 25})
    return mosaic.touching(scenes, windows).groupBy("tile_id").agg(F.count("*").alias("n_scenes"), F.min("seq").alias("first_seq"))


def q22_grid(spark, sf_dir):
    grid = adapters.grid_of(spark, sf_dir)
    r, c = F.col("row"), F.col("col")
    return grid.cells(spark).select("row", "col", F.round(grid.latitude(r), 8).alias("latitude"), F.round(grid.longitude(c), 8).alias("longitude"), F.round(grid.pixel_km2(r), 10).alias("km2"), grid.tile_id(r, c, 16).cast("long").alias("tile_id"))


def q23_tiles(spark, sf_dir):
    return adapters.grid_of(spark, sf_dir).tiles(spark, 16)


def q24_edges(spark, sf_dir):
    grid, _, found = _flagged(spark, sf_dir)
    return neighbourhood.edges(found, grid.height, grid.width)


def q25_painted(spark, sf_dir):
    grid, _, found = _flagged(spark, sf_dir)
    return present.painted(found, 0.5, -(-grid.height // 2), -(-grid.width // 2))


def q26_overlay(spark, sf_dir):
    return present.overlay(_flagged(spark, sf_dir)[2])


def q27_label_places(spark, sf_dir):
    spots = _flagged(spark, sf_dir, detect.PRESETS["Sensitive"])
    grid = spots[0]
    table = detect.spots(spots[2], None, grid, adapters.PASS_DAYS)
    return present.place_labels(table, 20.0, 30.0).select("spot_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def q28_date_labels(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.to_date("ts")
    got = events.groupBy("user_id").agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count_distinct(day).alias("days"))
    return got.select("user_id", labels.span_label(F.col("first"), F.col("last")).alias("span"), labels.day_label(F.col("first")).alias("first_day"), F.datediff("last", "first").cast("long").alias("gap"), F.greatest(F.lit(90), F.lit(30) + F.col("days") * 12).alias("lookback"))


def q29_sizes(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    x = F.floor("o_totalprice")
    return o.select("o_orderkey", labels.nice_length(x / 7).alias("bar"), labels.length_label(labels.nice_length(x / 7)).alias("bar_label"), labels.rgb(F.lit(labels.DECREASE))[1].alias("green"), labels.html_escape(F.concat(F.lit("<a & '"), F.col("o_orderpriority"), F.lit("\">"))).alias("escaped"))


def q30_pass_history(spark, sf_dir):
    """Step from each pass to the next at a pixel, only between neighbouring passes."""
    grid, obs = _obs(spark, sf_dir)
    later = obs.select((F.col("pass_idx") - 1).alias("pass_idx"), "row", "col", F.col("vv").alias("vv_next"), F.col("vh").alias("vh_next"))
    step = F.rint(stats.decibels(F.col("vv") + F.col("vh"), F.col("vv_next") + F.col("vh_next")) * 100).cast("int")
    return obs.join(later, ["pass_idx", "row", "col"]).select("pass_idx", "row", "col", step.alias("step_db"))


def q31_threshold_table(spark, sf_dir):
    """The presets with their thresholds, least patch sizes, and the pixels that pass each."""
    rows = [(n, round(stats.chi2_threshold(d.alpha, 2), 9), d.min_db, d.min_pixels) for n, d in detect.PRESETS.items()]
    table = spark.createDataFrame(rows, "name string, threshold double, min_db double, min_pixels long")
    compared = _compared(spark, sf_dir, 3)[1]["change"]
    stat, _, valid = stats.decode(F.col("signed"))
    passing = [F.sum((valid & (stat > stats.chi2_threshold(d.alpha, 2)) & (F.abs(F.col("change_db") / 100.0) >= d.min_db)).cast("long")).alias(n) for n, d in detect.PRESETS.items()]
    counts = compared.agg(*passing).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, detect.PRESETS)), F.array(*detect.PRESETS))).alias("name", "pixels"))
    return table.join(counts, "name")


def q32_areas(spark, sf_dir):
    """The named areas with size and grid, and what the passes chosen for each orbit would take to download there."""
    rows = [(n, *b, round(grids.area_km2(b), 6), grids.Grid.over(b).pixels) for n, b in grids.AREAS.items()]
    areas = spark.createDataFrame(rows, "name string, west double, south double, east double, north double, km2 double, pixels long")
    days = q20_selected_days(spark, sf_dir).groupBy("orbit").agg(F.count("*").alias("reads"))
    return days.crossJoin(F.broadcast(areas)).select("name", "west", "south", "east", "north", "km2", "pixels", "orbit", F.round(F.col("pixels") * 2 * F.col("reads") * catalog.PIXEL_BYTES / 1e6, 3).alias("mb"))  # three areas


def q33_drawn_bounds(spark, sf_dir):
    """Bounds of drawn rings: here, the footprints."""
    ring = F.col("geometry")["coordinates"][0][0]
    return _scenes(spark, sf_dir).select("seq", grids.drawn_bounds_column(ring).alias("b")).select("seq", "b.*")


def q34_stream_events(spark, sf_dir):
    """The pass-to-pass steps again, from a stream of passes."""
    grid, obs = _obs(spark, sf_dir)
    return streams.replay(obs, adapters.N_PASSES)


def q35_download(spark, sf_dir):
    """Size of each orbit's selected passes, as an estimate and in words."""
    days = q20_selected_days(spark, sf_dir).groupBy("orbit").agg(F.count("*").alias("reads"))
    mb = F.lit(2_000_000) * 2 * F.col("reads") * catalog.PIXEL_BYTES / 1e6
    return days.select("orbit", "reads", F.round(mb, 3).alias("mb"))


def q36_tilted_windows(spark, sf_dir):
    """Tilted footprints and windows: pairs of boxes that meet, then of polygons."""
    box = catalog.footprint_box(F.col("geometry"))
    corner = lambda dx, dy: F.array(F.col("west") + dx, F.col("south") + dy)
    scenes = _scenes(spark, sf_dir).select("seq", *[v.alias(k) for k, v in box.items()]).withColumn("ring", F.array(corner(10, 0), corner(40, 10), corner(30, 40), corner(0, 30), corner(10, 0)))
    windows = spark.range(16).select(F.col("id").alias("tile_id"), (F.col("id") % 4 * 25).cast("double").alias("west"), (F.floor(F.col("id") / 4) * 25).cast("double").alias("south")).withColumns({"east": F.col("west") + 25, "north": F.col("south") + 25})
    return mosaic.touching(scenes, windows).groupBy("tile_id").agg(F.count("*").alias("n_scenes"), F.min("seq").alias("first_seq"))


def q37_explicit_orbit(spark, sf_dir):
    return catalog.sides(_scenes(spark, sf_dir), _request(orbit=7)).groupBy("orbit", "side").agg(F.count("*").alias("n_scenes"), F.count_distinct("day").alias("days"), F.min("seq").alias("first_seq"))


def _sensitive_spots(spark, sf_dir):
    grid, _, found = _flagged(spark, sf_dir, detect.PRESETS["Sensitive"])
    return detect.spots(found, None, grid, adapters.PASS_DAYS)


def q38_largest_spots(spark, sf_dir):
    return detect.largest_first(_sensitive_spots(spark, sf_dir), 10).select("spot_id", "n_pixels", F.round("area_m2", 2).alias("area_m2"))


def q39_full_windows(spark, sf_dir):
    """Quartiles of log ratios of 3 x 3 means: whole windows only, and of all passes the last four."""
    grid = adapters.grid_of(spark, sf_dir)
    got = stats.quartiles(change.log_ratios(adapters.dense_obs(spark, sf_dir, grid.width), 3, grid.height, grid.width, B))
    return got.select("n", F.round("q25", 9).alias("q25"), F.round("q75", 9).alias("q75"))


def q40_finite_samples(spark, sf_dir):
    """Quartiles of samples of which some are infinite, no number or missing."""
    o, k = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderkey")
    x = F.when(k % 11 == 0, float("nan")).when(k % 13 == 0, float("inf")).when(k % 17 == 0, float("-inf")).when(k % 19 != 0, F.ln(F.col("o_totalprice") / 1e5))
    got = stats.quartiles(o.select(x.alias("log_ratio")))
    return got.select("n", F.round("q25", 9).alias("q25"), F.round("q75", 9).alias("q75"))


def q41_looks_table(spark, sf_dir):
    """The scatter of log ratios that so many looks have, and the looks told from that scatter: as many looks as orders have lines."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("orders"))

    def spread(batches):
        for batch in batches:
            n = batch.column(0).to_pylist()
            iqr = [stats.log_ratio_iqr(float(x)) for x in n]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([round(x, 8) for x in iqr]), pa.array([round(stats.looks_from_iqr(x), 5) for x in iqr])], names=["n", "orders", "iqr", "looks"])

    return lines.mapInArrow(spread, "n long, orders long, iqr double, looks double")


def q42_sample_windows(spark, sf_dir):
    grid = adapters.grid_of(spark, sf_dir)
    return spark.createDataFrame(change.sample_windows(grid.height, grid.width), "row long, col long, height long, width long")


def q43_measured_looks(spark, sf_dir):
    """Looks measured on the passes before, or none where the samples are too few; no SQL for the inverse."""
    grid = adapters.grid_of(spark, sf_dir)
    before = adapters.dense_obs(spark, sf_dir, grid.width).where(F.col("pass_idx") < adapters.N_BEFORE)
    return spark.createDataFrame([(change.measure_looks(before, 1, grid.height, grid.width, B),)], "looks double")


def q44_fitted_areas(spark, sf_dir):
    """Areas about the suppliers, from points to whole countries, each enlarged or trimmed until it can be analysed."""
    k = F.col("s_suppkey")
    lon, lat = (k * 37) % 120 - 60.0, (k * 53) % 100 - 50.0
    wide, high = (k % 7) * (k % 5) * 0.125, (k % 11) * 0.0625
    boxes = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("seq"), (lon - wide).alias("west"), (lat - high).alias("south"), (lon + wide).alias("east"), (lat + high).alias("north"))

    def fit(batches):
        for batch in batches:
            got = [grids.fit_area(b) for b in zip(*(c.to_pylist() for c in batch.columns[1:]))]
            sides = [pa.array([b[i] for b, _ in got], pa.float64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sides, pa.array([note for _, note in got], pa.string())], names=["seq", "west", "south", "east", "north", "note"])

    return boxes.mapInArrow(fit, "seq long, west double, south double, east double, north double, note string")


def q45_web_tiles(spark, sf_dir):
    grid = adapters.grid_of(spark, sf_dir)
    (width, height), _ = grids.map_size(grid)
    zoom, tiles = grids.web_tiles(grid, width)
    return spark.createDataFrame([(width, height, zoom, x, y) for x, y in tiles], "width long, height long, zoom long, x long, y long")


def _store(spark) -> Store:
    return Store(spark, f"{shared_dir(spark)}/chronoscape/store-{uuid.uuid4().hex}")


def _saved_params(label: str) -> analysis.Params:
    return analysis.Params(label, (30.2, 50.5, 30.3, 50.6), "2026-07-04", "2026-08-04", looks=4.4)


def q46_result_round_trip(spark, sf_dir):
    """The comparison saved as a result and loaded again."""
    store, params = _store(spark), _saved_params("round trip")
    store.save(params, {"n_before": adapters.N_BEFORE}, {"pixel_change": q01_pixel_change(spark, sf_dir)})
    return store.load(params)[1]["pixel_change"].select(*STORED)


def q47_saved_results(spark, sf_dir):
    """Comparisons saved under two names, listed newest first with the pixels they hold; one of another version is left out."""
    store, found = _store(spark), materialize(q01_pixel_change(spark, sf_dir), "compared")
    for label, tables in (("first", {"pixel_change": found}), ("second", {"pixel_change": found.where("change_db > 0")})):
        store.save(_saved_params(label), {}, tables)
    old = spark.createDataFrame([(0, "old", "{}", "{}")], "version int, label string, params string, header string")
    old.coalesce(1).write.parquet(f"{store.root}/old/header")
    pixels = None
    for label in ("first", "second"):
        one = store.load(_saved_params(label))[1]["pixel_change"].agg(F.lit(label).alias("label"), F.count("*").alias("pixels"))
        pixels = one if pixels is None else pixels.unionByName(one)
    place = F.row_number().over(Window.orderBy(F.desc("modified")))  # a row for each saved result
    return store.saved().select(place.alias("place"), "key", "label").join(pixels, "label")


def q48_request_problems(spark, sf_dir):
    """What is wrong with requests made of orders: their dates, images a side and filters; a row without text where nothing is."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    start = F.date_add(F.to_date("o_orderdate"), 7200)
    asked = o.select("o_orderkey", start.cast("string").alias("start"), F.date_add(start, (F.col("o_custkey") % 90 - 10).cast("int")).cast("string").alias("end"), (F.col("o_orderkey") % 23).alias("images"), (F.col("o_custkey") % 6).alias("smooth"))

    def check(batches):
        for batch in batches:
            keys, texts = [], []
            for key, start, end, images, smooth in zip(*(c.to_pylist() for c in batch.columns)):
                found = analysis.problems(replace(_saved_params("x"), start=start, end=end, images=images, smooth=smooth), dt.date(2016, 11, 1))
                keys += [key] * max(1, len(found))
                texts += found or [None]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts, pa.string())], names=["o_orderkey", "problem"])

    return asked.mapInArrow(check, "o_orderkey long, problem string")


class _Offline(catalogue.CatalogueSource):
    fetch = staticmethod(adapters.offline_catalogue)

    @classmethod
    def name(cls):
        return "offline_catalogue"


def q49_catalogue_search(spark, sf_dir):
    """A paged catalogue of the orders' features, read in parts, the days narrowed by the filter."""
    catalogue.register(spark, _Offline)
    folder = adapters.catalogue_files(spark, sf_dir, f"{shared_dir(spark)}/chronoscape/catalogue-{uuid.uuid4().hex}")
    options = {"url": folder, "bbox": "[0, 0, 1, 1]", "start": "1995-01-01", "end": "1995-05-01", "partitions": "3"}
    got = spark.read.format("offline_catalogue").options(**options).load().where("day >= '1995-01-20' and day < '1995-03-01'")
    return got.select(F.col("day").cast("string").alias("day"), F.get_json_object("item", "$.id").alias("id"))


def q50_signed_links(spark, sf_dir):
    """Links to the orders' images, signed with a token where they lead to the web; the token is renewed when it runs out."""
    k = F.col("seq")
    link = F.when(k % 5 == 0, F.concat(F.lit("/local/"), k)).when(k % 5 == 1, F.concat(F.lit("https://h/"), k, F.lit("?x=1"))).when(k % 5 == 2, F.concat(F.lit("s3://bucket/"), k)).otherwise(F.concat(F.lit("http://h/"), k))

    def sign(batches):
        for batch in batches:
            signed = []
            for key, href in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                clock = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=key % 70)
                tokens = iter([{"token": f"sig={n}", "msft:expiry": f"2026-01-01T0{n}:00:00Z"} for n in (1, 2)])
                times = iter([dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc), clock])
                signer = catalogue.Signer("http://token", lambda *_: next(tokens), lambda: next(times))
                signer.sign("http://h/first")  # asks for the first token at midnight
                signed.append(signer.sign(href))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signed, pa.string())], names=["seq", "link", "signed"])

    return _scenes(spark, sf_dir).select(k, link.alias("link")).mapInArrow(sign, "seq long, link string, signed string")


def q51_places(spark, sf_dir):
    """Places in replies of a place service, here the nations of each region, with bounds in the service's order."""
    n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    south, west = F.col("n_nationkey") * 2.5 - 30, F.col("n_nationkey") * 5.25 - 60
    box = F.array(*[v.cast("string") for v in (south, south + 2, west, west + 4.5)])
    place = F.struct(F.col("n_name").alias("display_name"), box.alias("boundingbox"))
    replies = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.to_json(F.collect_list(place)).alias("reply"))

    def ask(batches):
        for batch in batches:
            rows = [(region, name, *box) for region, reply in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for name, box in catalogue.search_places(region, "http://places", lambda *_, text=reply: json.loads(text))]
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 2 else pa.float64()) for i, c in enumerate(cols)], names=["query", "name", "west", "south", "east", "north"])

    return replies.mapInArrow(ask, "query string, name string, west double, south double, east double, north double")


def q52_plan_gaps(spark, sf_dir):
    """For each orbit the days chosen on each side, in words, and the longest time from a chosen day to its date."""
    asked = _request()
    days = catalog.select_days(catalog.sides(_scenes(spark, sf_dir), asked), None, 3).groupBy("orbit", "side").agg(F.array_sort(F.collect_set("day")).alias("days"))
    date = F.when(F.col("side") == "before", F.lit(asked.start)).otherwise(F.lit(asked.end)).cast("date")
    side = lambda s: F.max(F.when(F.col("side") == s, labels.day_list(F.col("days")))).alias(s)
    return days.groupBy("orbit").agg(F.max(F.datediff(date, F.element_at("days", -1))).cast("long").alias("gap"), side("before"), side("after"))


def q53_newest_drawing(spark, sf_dir):
    """Bounds of the newest ring of each orbit's footprints; null where it is a sliver."""
    ring = F.col("geometry")["coordinates"][0][0]
    drawn = F.when(F.col("seq") % 5 == 0, F.transform(ring, lambda p: F.array(ring[0][0], p[1]))).otherwise(ring)
    newest = F.element_at(F.array_sort(F.collect_list(F.struct("day", "seq", drawn.alias("ring")))), -1)["ring"]
    return _scenes(spark, sf_dir).groupBy("orbit").agg(newest.alias("ring")).select("orbit", grids.drawn_bounds_column(F.col("ring")).alias("b")).select("orbit", "b.*")


def q54_unusable_pixels(spark, sf_dir):
    """The mosaic of scenes with no numbers, zeros, infinities and no-data values in them; no mean of prices is the latter."""
    nodata = sys.float_info.max
    grid = adapters.grid_of(spark, sf_dir)
    spot = F.col("row") * 3 + F.col("col") + F.col("scene_seq")
    bad = F.when(spot % 5 == 0, float("nan")).when(spot % 7 == 0, 0.0).when(spot % 11 == 0, float("inf")).when(spot % 13 == 0, -1.0).when(spot % 17 == 0, nodata).otherwise(F.col("vv"))
    got = mosaic.mosaic(adapters.raw_obs(spark, sf_dir, grid.width).withColumn("vv", bad), nodata=nodata)
    return got.select("pass_idx", "row", "col", *_four_places("vv", "vh"))


def q55_legend(spark, sf_dir):
    """Legends of a picture for each nation: as many spots as it has suppliers, pictures and pixels of several sizes."""
    n, s = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "supplier"))
    counted = n.join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_nationkey", "n_name").agg(F.count("s_suppkey").alias("n_spots"))
    asked = counted.select("n_name", "n_spots", (F.col("n_nationkey") * 64 + 800).alias("width"), F.element_at(F.array(*map(F.lit, (1.0, 10.0, 37.0, 900.0))), (F.col("n_nationkey") % 4 + 1).cast("int")).alias("metres"))

    def draw(batches):
        for batch in batches:
            rows = []
            for name, spots, width, metres in zip(*(c.to_pylist() for c in batch.columns)):
                got = present.legend(name, "2026-07-04", "2026-08-04", "Balanced", BALANCED, spots, metres, width)
                rows.append((width, metres, got["title"], got["dates"], got["scale"], got["detection"], got["spots"]))
            cols, kinds = list(zip(*rows)) or [()] * 7, [pa.int64(), pa.float64()] + [pa.string()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["width", "metres", "title", "dates", "scale", "detection", "spots"])

    return asked.mapInArrow(draw, "width long, metres double, title string, dates string, scale string, detection string, spots string")


def q56_badges(spark, sf_dir):
    got = present.badges(_spots(spark, sf_dir)[1], 2.0)
    return got.select("spot_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.col("times").cast("long").alias("times"), "caption", "colour")


def q57_backscatter(spark, sf_dir):
    return present.backscatter(q06_overview(spark, sf_dir), "after")


def q58_radar_background(spark, sf_dir):
    grid = adapters.grid_of(spark, sf_dir)
    got = present.radar_background(q06_overview(spark, sf_dir), "before", grid, grid.height * 2, grid.width * 2)
    return got.select("out_row", "out_col", F.round("grey", 6).alias("grey"))


def q59_tile_background(spark, sf_dir):
    """A picture of the grid from tiles, each of whose pixels is coloured by its place."""
    grid = adapters.grid_of(spark, sf_dir)
    zoom, tiles = grids.web_tiles(grid, 64)
    pixel = F.explode(F.sequence(F.lit(0), F.lit(255)))
    every = spark.createDataFrame(tiles, "x int, y int").withColumn("row", pixel).withColumn("col", pixel)
    coloured = every.select("x", "y", "row", "col", F.col("col").alias("r"), F.col("row").alias("g"), F.pmod(F.col("x") + F.col("y"), F.lit(256)).alias("b"))
    got = present.tile_background(coloured, grid, zoom, tiles, 32, 64)
    return got.select("out_row", "out_col", *[F.round(c, 6).alias(c) for c in "rgb"])


def _polygon_scenes(spark, sf_dir):
    return catalog.scenes(adapters.polygon_items(spark, sf_dir))


def q60_polygon_cover(spark, sf_dir):
    """Cover by the areas of each orbit: tilted, with holes, in parts."""
    found = _polygon_scenes(spark, sf_dir).withColumn("side", F.lit("before"))
    return catalog.coverage(found, adapters.AOI).select("orbit", F.round("coverage", 8).alias("coverage"))


def q61_polygon_windows(spark, sf_dir):
    """Windows and the areas that have a point in common with them; a window within a hole has none."""
    box = catalog.footprint_box(F.col("geometry"))
    scenes = _polygon_scenes(spark, sf_dir).select("seq", F.col("geometry.coordinates").alias("polygons"), *[v.alias(k) for k, v in box.items()])
    windows = spark.range(400).select(F.col("id").alias("tile_id"), (F.col("id") % 20 * 5).cast("double").alias("west"), (F.floor(F.col("id") / 20) * 5).cast("double").alias("south")).withColumns({"east": F.col("west") + 4, "north": F.col("south") + 4})
    return mosaic.touching(scenes, windows).groupBy("tile_id").agg(F.count("*").alias("n_scenes"), F.min("seq").alias("first_seq"))


def _utm_raster(grid: Grid) -> Raster:
    """The grid's pixels laid out in zone 36 north, ten metres each, from the place of the grid's north-west corner."""
    return Raster(32636, 301_400.0, 5_598_000.0, 10.0, -10.0, grid.width, grid.height)


def q62_utm_and_back(spark, sf_dir):
    """Pixels of a UTM image moved onto the grid and from there onto the image's own pixels again, by nearest neighbour."""
    grid, obs = _obs(spark, sf_dir)
    image, own = _utm_raster(grid), Raster.of_grid(grid)
    there = resample.warp_nearest(obs, image, own)
    return resample.warp_nearest(there, own, image).select("pass_idx", "row", "col", *_four_places("vv", "vh"))


def q63_image_windows(spark, sf_dir):
    """The passes written as tiled images, an image a band, and a window of them read again."""
    grid, obs = _obs(spark, sf_dir)
    folder = f"{shared_dir(spark)}/chronoscape/images-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    path = F.concat(F.lit(f"{folder}/"), F.col("pass_idx"), F.lit("-"), F.col("x.band"), F.lit(".tif"))
    bands = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("value")) for b in B])).alias("x")
    pixels = obs.select("pass_idx", "row", "col", bands).select(path.alias("path"), "row", "col", "x.value")
    paths = [r.path for r in geotiff.write_images(pixels, _utm_raster(grid), 16, predictor=3).collect()]
    h, w = grid.height, grid.width
    got = geotiff.read_images(spark, paths, 4).where(f"row >= {h // 4} and row < {3 * h // 4} and col >= {w // 4} and col < {3 * w // 4}")
    name = F.split(F.element_at(F.split("path", "/"), -1), "[-.]")
    return got.select(name[0].cast("int").alias("pass_idx"), name[1].alias("polarisation"), "row", "col", *_four_places("value"))


def q64_mosaic_rounds(spark, sf_dir):
    """The mosaic once more, scene by scene, each read only for tiles that those before it left holes in."""
    grid = adapters.grid_of(spark, sf_dir)
    raw = adapters.raw_obs(spark, sf_dir, grid.width)
    tile = grid.tile_id(F.col("row"), F.col("col"), 16).alias("tile_id")
    read = lambda tasks: raw.withColumn("tile_id", tile).join(tasks, ["pass_idx", "scene_seq", "tile_id"], "left_semi")
    got = mosaic.mosaic_in_rounds(raw.select("pass_idx", "scene_seq", tile), read, grid, 16)
    return got.select("pass_idx", "row", "col", *_four_places("vv", "vh"))


def q65_result_windows(spark, sf_dir):
    """Two windows of a saved result that is laid out by tile; other tiles' files are not listed."""
    grid, found = _compared(spark, sf_dir, 1)
    store, params = _store(spark), _saved_params("tiles")
    store.save(params, {}, {"pixel_change": found["change"].select(*STORED)}, grid, 8)
    h, w = grid.height, grid.width
    windows = spark.createDataFrame([("middle", h // 3, w // 3, 9, 9), ("corner", h - 4, w - 5, 100, 100), ("outside", h, 0, 5, 5)], "part string, row int, col int, height int, width int")
    return store.load_windows(params, "pixel_change", windows)


def q66_picture(spark, sf_dir):
    """The composed picture: radar background, changes, arrow and the panel below, at twice the grid's size."""
    grid, found, flagged = _flagged(spark, sf_dir)
    drawn = present.radar_background(change.overview(found["change"]), "after", grid, 2 * grid.height, 2 * grid.width)
    return picture.picture(flagged, drawn, grid, 2 * grid.height, 2 * grid.width)[0]


def q67_sql_functions(spark, sf_dir):
    """Significant pixels and their patches in plain SQL, with the statistics as its functions."""
    grid, obs = _obs(spark, sf_dir)
    sql_functions.register(spark)
    name = uuid.uuid4().hex
    change.group_sums(obs, adapters.N_BEFORE, B).createOrReplaceTempView(f"sums_{name}")
    pixels = spark.sql(f"""
        SELECT row, col, encode_statistic(stat, db) AS signed, encode_db(db) AS change_db FROM (
            SELECT *, likelihood_ratio(vv1, vv2, l1, l2) + likelihood_ratio(vh1, vh2, l1, l2) AS stat, decibels(vv1 + vh1, vv2 + vh2) AS db FROM (
                SELECT row, col, (vv_0 + vv_1) / (n_0 + n_1) AS vv1, (vh_0 + vh_1) / (n_0 + n_1) AS vh1, vv_2 / n_2 AS vv2, vh_2 / n_2 AS vh2,
                       CAST((n_0 + n_1) * {stats.NOMINAL_LOOKS} AS DOUBLE) AS l1, CAST(n_2 * {stats.NOMINAL_LOOKS} AS DOUBLE) AS l2
                FROM sums_{name} WHERE n_0 + n_1 > 0 AND n_2 > 0))""")
    materialize(pixels, "sql-pixels").createOrReplaceTempView(f"pixels_{name}")
    spark.sql(f"SELECT row, col, signed FROM pixels_{name} WHERE decode_statistic(signed) > {stats.chi2_threshold(1e-3, 2)}D").createOrReplaceTempView(f"over_{name}")
    sql_functions.create_patches(spark, f"over_{name}", f"patches_{name}")
    return spark.sql(f"SELECT label, count(*) AS n_pixels, min(signed) AS lowest, max(signed) AS highest FROM patches_{name} GROUP BY label")


def queries() -> dict:
    return {n: f for n, f in globals().items() if n.startswith("q") and n[1:3].isdigit()}


# ---------------------------------------------------------------- SQL

_OBS = """
wd AS (SELECT CASE WHEN max(l_partkey) > 10000 THEN 100 WHEN max(l_partkey) > 1000 THEN 50 ELSE 20 END AS w, max(l_partkey) AS top FROM lineitem),
dim AS (SELECT w, top // w + 1 AS h FROM wd),
raw AS (SELECT (l_linenumber - 1)::INT AS pass_idx, (l_partkey // w)::INT AS r, (l_partkey % w)::INT AS c,
        avg(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END) AS vv, avg(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END) AS vh
        FROM lineitem, wd GROUP BY 1, 2, 3),
obs AS (SELECT pass_idx, r, c, vv * f AS vv, vh * f AS vh FROM (
        SELECT *, (CASE WHEN r BETWEEN 2 AND 5 AND c BETWEEN 5 AND 11 AND pass_idx >= 4 THEN pow(10::DOUBLE, -0.7::DOUBLE) ELSE 1.0::DOUBLE END)
                * (CASE WHEN r BETWEEN 1 AND 3 AND c BETWEEN 14 AND 17 AND pass_idx IN (4, 6) THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END) AS f
        FROM raw WHERE vv IS NOT NULL AND vh IS NOT NULL))"""


def _box(k: int) -> str:
    m = k // 2
    return f"""
bx AS (SELECT pass_idx, r + dr AS r, c + dc AS c, sum(vv) AS vv, sum(vh) AS vh, count(*) AS n, sum(CASE WHEN dr = 0 AND dc = 0 THEN 1 ELSE 0 END) AS own
       FROM obs, range({-m}, {m + 1}) a(dr), range({-m}, {m + 1}) b(dc), dim
       WHERE r + dr >= 0 AND r + dr < h AND c + dc >= 0 AND c + dc < w GROUP BY 1, 2, 3)"""


def _lrt(a: str, b: str, la: str, lb: str) -> str:
    p = f"(({la}) * ({a}) + ({lb}) * ({b})) / (({la}) + ({lb}))"
    return f"greatest(2 * ((({la}) + ({lb})) * ln({p}) - ({la}) * ln({a}) - ({lb}) * ln({b})) / (1 + (1 / ({la}) + 1 / ({lb}) - 1 / (({la}) + ({lb}))) / 6), 0)"


def _change(k: int, first: str, second: str, name: str = "ch", bands: tuple = B) -> str:
    """first, second: conditions on pass_idx."""
    looks = f"(4.4::DOUBLE * {k * k} / {k * k})"
    stat = " + ".join(_lrt(f"{b}1", f"{b}2", "l1", "l2") for b in bands)
    db = f"10 * log10(({' + '.join(f'{b}2' for b in bands)}) / ({' + '.join(f'{b}1' for b in bands)}))"
    return f"""
{name}_s AS (SELECT r, c, sum(vv) FILTER ({first}) AS a, sum(vh) FILTER ({first}) AS b, sum(n) FILTER ({first}) AS na, coalesce(sum(own) FILTER ({first}), 0) AS oa,
        sum(vv) FILTER ({second}) AS d, sum(vh) FILTER ({second}) AS e, sum(n) FILTER ({second}) AS nb, coalesce(sum(own) FILTER ({second}), 0) AS ob FROM bx GROUP BY 1, 2),
{name}_m AS (SELECT r, c, a / na AS vv1, b / na AS vh1, d / nb AS vv2, e / nb AS vh2, na * {looks} AS l1, nb * {looks} AS l2 FROM {name}_s WHERE oa > 0 AND ob > 0),
{name}_t AS (SELECT *, {stat} AS stat, {db} AS db FROM {name}_m),
{name} AS (SELECT r AS row, c AS col, round_even(least(stat, 320) * 100 * CASE WHEN db > 0 THEN 1 ELSE -1 END, 0)::SMALLINT AS signed,
        round_even(greatest(least(db, 300), -300) * 100, 0)::SMALLINT AS change_db, vv1, vv2 FROM {name}_t)"""


_FIRST, _SECOND = "pass_idx < 4", "pass_idx >= 4"


def _detected(det: detect.Detection, source: str = "ch", name: str = "det", bands: int = 2) -> str:
    return f"""
{name}_f AS (SELECT row, col, signed, change_db, change_db > 0 AS increased FROM {source}
        WHERE signed <> -32768 AND abs(signed::INT) / 100.0::DOUBLE > {stats.chi2_threshold(det.alpha, bands)!r}::DOUBLE AND abs(change_db::INT) / 100.0::DOUBLE >= {float(det.min_db)!r}::DOUBLE),
{name}_e AS (SELECT a.row AS ar, a.col AS ac, b.row AS br, b.col AS bc FROM {name}_f a JOIN {name}_f b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
{name}_r(row, col, label) AS (SELECT row, col, row::BIGINT * 4294967296 + col FROM {name}_f
        UNION SELECT e.br, e.bc, x.label FROM {name}_r x JOIN {name}_e e ON e.ar = x.row AND e.ac = x.col),
{name}_l AS (SELECT row, col, min(label) AS label FROM {name}_r GROUP BY 1, 2),
{name} AS (SELECT f.*, l.label FROM {name}_f f JOIN {name}_l l USING (row, col) WHERE l.label IN (SELECT label FROM {name}_l GROUP BY 1 HAVING count(*) >= {det.min_pixels}))"""


def _events() -> str:
    la, lb = "a.n * 4.4::DOUBLE", "b.n * 4.4::DOUBLE"
    stat = " + ".join(_lrt(f"a.{x} / a.n", f"b.{x} / b.n", la, lb) for x in B)
    return f"""
ev AS (SELECT a.r AS row, a.c AS col, bit_or(1::BIGINT << a.pass_idx) AS events FROM bx a JOIN bx b ON b.pass_idx = a.pass_idx + 1 AND a.r = b.r AND a.c = b.c AND a.own > 0 AND b.own > 0
        WHERE {stat} > {stats.chi2_threshold(stats.PASS_ALPHA, 2)!r}::DOUBLE AND abs(10 * log10((b.vv / b.n + b.vh / b.n) / (a.vv / a.n + a.vh / a.n))) >= 2
        AND (a.r, a.c) IN (SELECT (r, c) FROM obs GROUP BY r, c HAVING min(pass_idx) < 4 AND max(pass_idx) >= 4) GROUP BY 1, 2)"""


_LON, _LAT = adapters.SOUTH_WEST
_X0, _Y0 = f"(radians({_LON}::DOUBLE) * 6378137)", f"(6378137 * ln(tan(pi() / 4 + radians({_LAT}::DOUBLE) / 2)))"
_SC = f"(10 / cos(radians({_LAT}::DOUBLE)))"


def _lat_sql(row: str) -> str:
    return f"degrees(2 * atan(exp(({_Y0} - ({row} + 0.5::DOUBLE) * {_SC}) / 6378137)) - pi() / 2)"


def _lon_sql(col: str) -> str:
    return f"degrees(({_X0} + ({col} + 0.5::DOUBLE) * {_SC}) / 6378137)"


def _km2(row: str) -> str:
    return f"(pow({_SC} * cos(radians({_lat_sql(row)})), 2) / 1e6::DOUBLE)"


def _spots_sql() -> str:
    day = lambda d: f"strftime(DATE '{d}', '%-d %b %Y')"
    when = [f"CASE WHEN s{i} >= 0.3::DOUBLE THEN {day(a)} || ' → ' || {day(b)} END" for i, (a, b) in enumerate(zip(adapters.PASS_DAYS, adapters.PASS_DAYS[1:]))]
    shares = ", ".join(f"avg((coalesce(events, 0) >> {i}) & 1) AS s{i}" for i in range(adapters.N_PASSES - 1))
    return f"""
sp AS (SELECT label, count(*) AS n_pixels, sum({_km2('d.row')} * 1e6::DOUBLE) AS area_m2, sum(change_db) / (count(*) * 100.0::DOUBLE) AS change_db, avg(d.row) AS row, avg(d.col) AS col, {shares}
       FROM det d LEFT JOIN ev USING (row, col) GROUP BY 1),
spots AS (SELECT *, CASE WHEN change_db < 0 THEN 'decrease' ELSE 'increase' END AS direction, concat_ws('; ', {', '.join(when)}) AS seen, concat_ws('<br>', {', '.join(when)}) AS seen_html,
       {' + '.join(f'(s{i} >= 0.3::DOUBLE)::BIGINT' for i in range(adapters.N_PASSES - 1))} AS times_changed FROM sp)"""


_ITEMS = """
it AS (SELECT o_orderkey AS seq, c_nationkey AS orbit, o_orderdate::DATE AS day, ((o_custkey * 37) % 100 - 20)::DOUBLE AS west, ((o_custkey * 53) % 100 - 20)::DOUBLE AS south
       FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0)"""
_SIDES = """
sd AS (SELECT *, CASE WHEN day BETWEEN DATE '1998-06-01' - 90 AND DATE '1998-06-01' THEN 'before' WHEN day > DATE '1998-06-01' AND day <= DATE '1998-09-01' THEN 'after' END AS side FROM it)"""
_ORBITS = """
bb AS (SELECT * FROM sd WHERE side IS NOT NULL AND west <= 100 AND west + 40 >= 0 AND south <= 100 AND south + 40 >= 0),
xs AS (SELECT DISTINCT orbit, side, least(greatest(unnest([west, west + 40, 0, 100]), 0), 100) AS x FROM bb),
ys AS (SELECT DISTINCT orbit, side, least(greatest(unnest([south, south + 40, 0, 100]), 0), 100) AS y FROM bb),
xi AS (SELECT *, lead(x) OVER (PARTITION BY orbit, side ORDER BY x) AS x2 FROM xs), yi AS (SELECT *, lead(y) OVER (PARTITION BY orbit, side ORDER BY y) AS y2 FROM ys),
cv AS (SELECT xi.orbit, xi.side, sum(CASE WHEN EXISTS (SELECT 1 FROM bb WHERE bb.orbit = xi.orbit AND bb.side = xi.side AND west <= x AND west + 40 >= x2 AND south <= y AND south + 40 >= y2)
       THEN (x2 - x) * (y2 - y) ELSE 0 END) / 10000 AS cover FROM xi JOIN yi ON xi.orbit = yi.orbit AND xi.side = yi.side WHERE x2 IS NOT NULL AND y2 IS NOT NULL GROUP BY 1, 2),
ob AS (SELECT orbit, count(DISTINCT day) FILTER (side = 'before') AS before, count(DISTINCT day) FILTER (side = 'after') AS after,
       (DATE '1998-06-01' - max(day) FILTER (side = 'before')) + (DATE '1998-09-01' - max(day) FILTER (side = 'after')) AS gap_days FROM bb GROUP BY 1),
orb AS (SELECT ob.orbit, cover AS coverage, before, after, gap_days FROM ob JOIN (SELECT orbit, min(cover) AS cover FROM cv GROUP BY 1) k ON k.orbit = ob.orbit WHERE before > 0 AND after > 0)"""

_EDGES = [(k, p, *a, *b) for k, shape in adapters.SHAPES.items() for p, part in enumerate(shape) for ring in part for a, b in zip(ring, ring[1:] + ring[:1])]
_AREAS = f"""
sup AS (SELECT s_suppkey AS seq, s_nationkey AS orbit, ((s_suppkey * 37) % 100 - 20)::DOUBLE AS west, ((s_suppkey * 53) % 100 - 20)::DOUBLE AS south FROM supplier),
ed AS (SELECT seq, orbit, part, west + a AS x, south + b AS y, west + c AS u, south + d AS v FROM sup JOIN (VALUES {', '.join(map(str, _EDGES))}) z(k, part, a, b, c, d) ON seq % 3 = k)"""
#: Heights at which edges end or cross; between two of them edges in order of place, in and out of each area by turns.
_COVER = """
up AS (SELECT orbit, seq, part, CASE WHEN y < v THEN x ELSE u END AS x, least(y, v) AS y, CASE WHEN y < v THEN u ELSE x END AS u, greatest(y, v) AS v FROM ed WHERE y <> v),
ln AS (SELECT *, (u - x) / (v - y) AS m, x - (u - x) / (v - y) * y AS c FROM up),
lv AS (SELECT orbit, unnest([y, v, 0, 100]) AS h FROM ln UNION SELECT a.orbit, (b.c - a.c) / (a.m - b.m) FROM ln a JOIN ln b ON a.orbit = b.orbit AND a.m <> b.m AND (b.c - a.c) / (a.m - b.m) BETWEEN greatest(a.y, b.y) AND least(a.v, b.v)
       UNION SELECT orbit, (side - c) / m FROM ln, (VALUES (0), (100)) t(side) WHERE m <> 0 AND (side - c) / m BETWEEN y AND v),
sb AS (SELECT orbit, h, lead(h) OVER (PARTITION BY orbit ORDER BY h) AS h2 FROM lv WHERE h BETWEEN 0 AND 100),
ac AS (SELECT s.orbit, h, h2, seq, part, least(greatest(m * (h + h2) / 2 + c, 0), 100) AS x, m * (h + h2) / 2 + c AS raw FROM sb s JOIN ln l ON l.orbit = s.orbit AND l.y <= (h + h2) / 2 AND l.v > (h + h2) / 2),
st AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY orbit, h, seq, part ORDER BY raw) % 2 = 1 THEN 1 ELSE -1 END AS step FROM ac),
wd AS (SELECT orbit, h2 - h AS high, sum(step) OVER o AS n, lead(x, 1, 100) OVER o - x AS wide FROM st WINDOW o AS (PARTITION BY orbit, h ORDER BY x, seq, part, raw ROWS UNBOUNDED PRECEDING))"""


def _taps(kernel: str, reach: int) -> str:
    """tp (a, out, src, weight) of axes ax (a, n_out, n_in, start, step)."""
    return f"""ct AS (SELECT *, (k + 0.5::DOUBLE) * step + start AS c, greatest(step, 1) AS s FROM (SELECT *, unnest(range(n_out)) AS k FROM ax)),
        tr AS (SELECT a, k, c, s, unnest(range(greatest(floor(c - {reach} * s + 0.5::DOUBLE), 0)::BIGINT, least(floor(c + {reach} * s + 0.5::DOUBLE), n_in)::BIGINT)) AS src FROM ct),
        tx AS (SELECT a, k, src, (src - c + 0.5::DOUBLE) / s AS x FROM tr), tk AS (SELECT a, k, src, {kernel} AS v FROM tx),
        tp AS (SELECT a, k AS out, src, v / sum(v) OVER (PARTITION BY a, k) AS weight FROM tk)"""


def _utm_sql() -> str:
    """there: the image's pixel (r, c) under each cell of the grid; back: the grid's cell (r, c) under each pixel of the image."""
    image = _utm_raster(Grid(0, 0, 1, 1, 1))
    k, a = 0.9996, projection.RECTIFYING
    series = lambda table, f, g, sign: " ".join(f"{sign} {c!r}::DOUBLE * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, c in enumerate(table, 1))
    chi = " ".join(f"+ {c!r}::DOUBLE * sin({2 * j} * chi)" for j, c in enumerate(projection.TRUE_LATITUDE, 1))
    ecc = f"{projection.ECCENTRICITY!r}::DOUBLE"
    return f"""
every AS (SELECT (i // w)::INT AS row, (i % w)::INT AS col, w, h FROM dim, range(100000) t(i) WHERE i < w * h),
f1 AS (SELECT *, radians(({_lon_sql('col')}) - 33) AS lam, radians({_lat_sql('row')}) AS phi FROM every),
f2 AS (SELECT *, sinh(atanh(sin(phi)) - {ecc} * atanh({ecc} * sin(phi))) AS t FROM f1),
f3 AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM f2),
f4 AS (SELECT row, col, w, h, 500000 + {k * a!r}::DOUBLE * (eta {series(projection.TO_PLANE, 'cos', 'sinh', '+')}) AS x, {k * a!r}::DOUBLE * (xi {series(projection.TO_PLANE, 'sin', 'cosh', '+')}) AS y FROM f3),
there AS (SELECT * FROM (SELECT row, col, w, h, floor(({image.y0!r}::DOUBLE - y) / 10)::INT AS r, floor((x - {image.x0!r}::DOUBLE) / 10)::INT AS c FROM f4) WHERE r BETWEEN 0 AND h - 1 AND c BETWEEN 0 AND w - 1),
i1 AS (SELECT *, ({image.y0!r}::DOUBLE - (row + 0.5::DOUBLE) * 10) / {k * a!r}::DOUBLE AS xi, ({image.x0!r}::DOUBLE + (col + 0.5::DOUBLE) * 10 - 500000) / {k * a!r}::DOUBLE AS eta FROM every),
i2 AS (SELECT row, col, w, h, xi {series(projection.FROM_PLANE, 'sin', 'cosh', '-')} AS xi, eta {series(projection.FROM_PLANE, 'cos', 'sinh', '-')} AS eta FROM i1),
i3 AS (SELECT *, asin(sin(xi) / cosh(eta)) AS chi, radians(33) + atan2(sinh(eta), cos(xi)) AS lam FROM i2),
i4 AS (SELECT row, col, w, h, lam, chi {chi} AS phi FROM i3),
back AS (SELECT * FROM (SELECT row, col, w, h, floor(({_Y0} - 6378137 * ln(tan(pi() / 4 + phi / 2))) / {_SC})::INT AS r, floor((lam * 6378137 - {_X0}) / {_SC})::INT AS c FROM i4) WHERE r BETWEEN 0 AND h - 1 AND c BETWEEN 0 AND w - 1)"""


def oracle_sql() -> dict[str, str]:
    base = lambda k: f"WITH RECURSIVE {_OBS}, {_box(k)}"
    ch = lambda k: f"{base(k)}, {_change(k, _FIRST, _SECOND)}"
    null = _change(3, "pass_idx IN (0, 2)", "pass_idx IN (1, 3)", "nl")
    stored = " SELECT row, col, signed, change_db FROM "
    det, sens = f"{ch(3)}, {_detected(BALANCED)}", f"{ch(3)}, {_detected(detect.PRESETS['Sensitive'])}"
    spots = f"{det}, {_events()}, {_spots_sql()}"
    grey = lambda m: f"(1 + round_even((greatest(least(10 * log10({m}), 0), -25) + 25) / 25 * 254, 0))::SMALLINT"
    rgb = "CASE WHEN increased THEN 0 ELSE 255 END AS r, CASE WHEN increased THEN 200 ELSE 59 END AS g, CASE WHEN increased THEN 255 ELSE 48 END AS b"
    thousands = lambda n: f"format('{{:,}}', round_even({n}, 0)::BIGINT)"
    out = {
        "q01_pixel_change": ch(1) + stored + "ch",
        "q02_pixel_change_smooth3": ch(3) + stored + "ch",
        "q03_pixel_change_smooth5": ch(5) + stored + "ch",
        "q04_null_change": f"{base(3)}, {null}{stored}nl",
        "q05_pixel_events": f"{base(3)}, {_events()} SELECT * FROM ev",
        "q06_overview": f"{ch(3)} SELECT row // 4 AS block_row, col // 4 AS block_col, {grey('avg(vv1)')} AS before, {grey('avg(vv2)')} AS after FROM ch GROUP BY 1, 2",
        "q07_one_band": f"{base(3)}, {_change(3, _FIRST, _SECOND, bands=('vv',))}, {_detected(detect.PRESETS['Sensitive'], bands=1)} SELECT row, col, signed, change_db, increased FROM det_f",
        "q08_candidates": f"{det} SELECT row, col, signed, change_db, increased FROM det_f",
        "q09_detected": f"{det} SELECT row, col, increased, label FROM det",
        "q10_detected_sensitive": f"{sens} SELECT row, col, increased, label FROM det",
        "q11_spots": f"{spots} SELECT label AS spot_id, round({_lat_sql('row')}, 6) AS latitude, round({_lon_sql('col')}, 6) AS longitude, round(area_m2, 2) AS area_m2, round(change_db, 4) AS change_db, direction, times_changed, seen, round(row, 4) AS row, round(col, 4) AS col, n_pixels FROM spots",
        "q12_spot_csv": f"{spots} SELECT label AS spot_id, printf('%.6f,%.6f,%.0f,%.2f,%s,%d,\"%s\"', {_lat_sql('row')}, {_lon_sql('col')}, area_m2, change_db, direction, times_changed, seen) AS line FROM spots",
        "q13_captions": f"{spots} SELECT label AS spot_id, '<b>' || CASE WHEN change_db < 0 THEN 'Signal decreased' ELSE 'Signal increased' END || printf('</b> by %.1f dB over ', abs(change_db)) || {thousands('area_m2')} || ' m²<br>Change seen ' || times_changed || CASE WHEN times_changed = 1 THEN ' time' ELSE ' times' END || ' between passes' || CASE WHEN times_changed > 0 THEN ':<br>' || seen_html ELSE '' END AS caption, CASE WHEN change_db < 0 THEN '#ff3b30' ELSE '#00c8ff' END AS colour FROM spots",
        "q14_summary": f"{det}, {null}, {_detected(BALANCED, 'nl', 'nd')} SELECT round((SELECT sum({_km2('row')}) FROM ch), 6) AS analysed_km2, round(coalesce((SELECT sum({_km2('row')}) FROM det WHERE increased), 0), 6) AS increase_km2, round(coalesce((SELECT sum({_km2('row')}) FROM det WHERE NOT increased), 0), 6) AS decrease_km2, round(coalesce((SELECT sum({_km2('row')}) FROM nd), 0), 6) AS noise_km2, (SELECT count(DISTINCT label) FROM det) AS spots, (SELECT count(DISTINCT label) FROM nd) AS noise_spots",
        "q15_looks": f"WITH {_OBS}, p AS (SELECT a.vv AS v1, a.vh AS h1, b.vv AS v2, b.vh AS h2 FROM obs a JOIN obs b ON b.pass_idx = a.pass_idx + 1 AND a.r = b.r AND a.c = b.c WHERE b.pass_idx < 4), x AS (SELECT ln(v1 / v2) AS q FROM p UNION ALL SELECT ln(h1 / h2) FROM p) SELECT count(*) AS n, round(quantile_cont(q, 0.25), 9) AS q25, round(quantile_cont(q, 0.75), 9) AS q75 FROM x",
        "q16_mosaic": "WITH wd AS (SELECT CASE WHEN max(l_partkey) > 10000 THEN 100 WHEN max(l_partkey) > 1000 THEN 50 ELSE 20 END AS w FROM lineitem), raw AS (SELECT (l_linenumber - 1)::INT AS pass_idx, l_orderkey % 5 AS s, (l_partkey // w)::INT AS row, (l_partkey % w)::INT AS col, avg(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END) AS vv, avg(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END) AS vh FROM lineitem, wd GROUP BY 1, 2, 3, 4), k AS (SELECT *, row_number() OVER (PARTITION BY pass_idx, row, col ORDER BY s) AS n FROM raw WHERE vv > 0 AND vh > 0) SELECT pass_idx, row, col, round(vv, 4) AS vv, round(vh, 4) AS vh FROM k WHERE n = 1",
        "q17_scenes": f"WITH {_ITEMS} SELECT 'S' || seq AS id, day::VARCHAR AS day, orbit, CASE WHEN orbit % 2 = 0 THEN 'ascending' ELSE 'descending' END AS orbit_state, seq, 'file:/vv/' || seq AS vv, 'file:/vh/' || seq AS vh, 2 AS n_hrefs, west, south + 40 AS north FROM it",
        "q18_orbits": f"WITH {_ITEMS}, {_SIDES}, {_ORBITS} SELECT orbit, round(coverage, 6) AS coverage, before, after, gap_days FROM orb",
        "q19_best_orbit": f"WITH {_ITEMS}, {_SIDES}, {_ORBITS} SELECT orbit, before, after FROM orb ORDER BY coverage > 0.98 DESC, CASE WHEN coverage > 0.98 THEN 0 ELSE coverage END DESC, gap_days, least(before, after) DESC, orbit LIMIT 1",
        "q20_selected_days": f"WITH {_ITEMS}, {_SIDES}, k AS (SELECT *, dense_rank() OVER (PARTITION BY orbit, side ORDER BY day DESC) AS n FROM sd WHERE side IS NOT NULL AND orbit % 2 = 0) SELECT orbit, side, day::VARCHAR AS day, count(*) AS n_scenes, min(seq) AS first_seq FROM k WHERE n <= 3 GROUP BY 1, 2, 3",
        "q21_scene_windows": f"WITH {_ITEMS}, wn AS (SELECT i AS tile_id, (i % 4) * 25 AS x, (i // 4) * 25 AS y FROM range(16) t(i)) SELECT tile_id, count(*) AS n_scenes, min(seq) AS first_seq FROM it JOIN wn ON west <= x + 25 AND west + 40 >= x AND south <= y + 25 AND south + 40 >= y GROUP BY 1",
        "q22_grid": f"WITH {_OBS}, g AS (SELECT (i // w)::INT AS row, (i % w)::INT AS col, w FROM dim, range(100000) t(i) WHERE i < w * h) SELECT row, col, round({_lat_sql('row')}, 8) AS latitude, round({_lon_sql('col')}, 8) AS longitude, round({_km2('row')}, 10) AS km2, row // 16 * ((w + 15) // 16) + col // 16 AS tile_id FROM g",
        "q23_tiles": f"WITH {_OBS}, t AS (SELECT i AS tile_id, (i % ((w + 15) // 16)) * 16 AS col, (i // ((w + 15) // 16)) * 16 AS row, w, h FROM dim, range(10000) t(i) WHERE i < ((w + 15) // 16) * ((h + 15) // 16)) SELECT tile_id, col, row, least(16, w - col) AS width, least(16, h - row) AS height FROM t",
        "q24_edges": f"{det} SELECT row, col FROM det d WHERE (SELECT count(*) FROM det x WHERE abs(x.row - d.row) + abs(x.col - d.col) = 1) < 4",
        "q25_painted": f"{det}, m AS (SELECT DISTINCT increased, row // 2 AS r, col // 2 AS c FROM det), e AS (SELECT *, (SELECT count(*) FROM m x WHERE x.increased = m.increased AND abs(x.r - m.r) + abs(x.c - m.c) = 1) < 4 AS rim FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY increased DESC) AS n, CASE WHEN increased THEN [0, 200, 255] ELSE [255, 59, 48] END AS rgb FROM e) SELECT r AS out_row, c AS out_col, increased, " + ", ".join(f"floor(CASE WHEN rim THEN rgb[{i}] * 0.6::DOUBLE ELSE 17.5::DOUBLE + rgb[{i}] * 0.75::DOUBLE END)::INT AS {n}" for i, n in ((1, "r"), (2, "g"), (3, "b"))) + " FROM k WHERE n = 1",
        "q26_overlay": f"{det} SELECT row, col, {rgb}, 255 AS a FROM det",
        "q28_date_labels": "WITH u AS (SELECT user_id, min(ts)::DATE AS f, max(ts)::DATE AS l, count(DISTINCT ts::DATE) AS n FROM events GROUP BY 1) SELECT user_id, CASE WHEN f = l THEN strftime(f, '%-d %b %Y') ELSE CASE WHEN year(f) = year(l) THEN strftime(f, '%-d %b') ELSE strftime(f, '%-d %b %Y') END || ' – ' || strftime(l, '%-d %b %Y') END AS span, strftime(f, '%-d %b %Y') AS first_day, l - f AS gap, greatest(90, 30 + n * 12) AS lookback FROM u",
        "q29_sizes": f"WITH x AS (SELECT o_orderkey, coalesce((SELECT min(v) FROM (SELECT unnest({list(labels.NICE)}) AS v) WHERE v >= floor(o_totalprice) / 7), {labels.LONGEST}) AS bar, o_orderpriority AS p FROM orders) SELECT o_orderkey, bar, CASE WHEN bar >= 1000 THEN (bar // 1000) || ' km' ELSE bar || ' m' END AS bar_label, 59 AS green, '&lt;a &amp; &#x27;' || p || '&quot;&gt;' AS escaped FROM x",
        "q30_pass_history": f"WITH {_OBS} SELECT a.pass_idx, a.r AS row, a.c AS col, round_even(10 * log10((b.vv + b.vh) / (a.vv + a.vh)) * 100, 0)::INT AS step_db FROM obs a JOIN obs b ON b.pass_idx = a.pass_idx + 1 AND a.r = b.r AND a.c = b.c",
        "q31_threshold_table": f"{ch(3)} SELECT name, round(-2 * ln(alpha), 9) AS threshold, min_db, greatest(1, ceil(m / 100))::BIGINT AS min_pixels, (SELECT count(*) FROM ch WHERE signed <> -32768 AND abs(signed::INT) / 100.0::DOUBLE > -2 * ln(alpha) AND abs(change_db::INT) / 100.0::DOUBLE >= min_db) AS pixels FROM (VALUES ('Sensitive', 1e-3::DOUBLE, 1.5::DOUBLE, 100.0), ('Balanced', 1e-5::DOUBLE, 3.0::DOUBLE, 400.0), ('Strict', 1e-7::DOUBLE, 6.0::DOUBLE, 2000.0)) t(name, alpha, min_db, m)",
        "q33_drawn_bounds": f"WITH {_ITEMS} SELECT seq, west, south, west + 40 AS east, south + 40 AS north FROM it",
        "q35_download": f"WITH {_ITEMS}, {_SIDES}, k AS (SELECT orbit, side, day, dense_rank() OVER (PARTITION BY orbit, side ORDER BY day DESC) AS n FROM sd WHERE side IS NOT NULL AND orbit % 2 = 0), d AS (SELECT DISTINCT orbit, side, day FROM k WHERE n <= 3) SELECT orbit, count(*) AS reads, round(2e6::DOUBLE * 2 * count(*) * 3.2::DOUBLE / 1e6::DOUBLE, 3) AS mb FROM d GROUP BY 1",
    }
    out["q32_areas"] = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {b[0]}::DOUBLE, {b[1]}::DOUBLE, {b[2]}::DOUBLE, {b[3]}::DOUBLE)" for n, b in grids.AREAS.items()) + ") t(name, west, south, east, north)"
    out["q32_areas"] = f"SELECT *, round((east - west) * 111.32::DOUBLE * cos(radians((south + north) / 2)) * (north - south) * 110.57::DOUBLE, 6) AS km2, (ceil((radians(east) - radians(west)) * 6378137 / s) * ceil(6378137 * (ln(tan(pi() / 4 + radians(north) / 2)) - ln(tan(pi() / 4 + radians(south) / 2))) / s))::BIGINT AS pixels FROM (SELECT *, 10 / cos(radians((south + north) / 2)) AS s FROM ({out['q32_areas']}))"
    out["q32_areas"] = f"WITH dl AS ({out['q35_download']}) SELECT * EXCLUDE (s, reads), round(pixels * 2 * reads * 3.2::DOUBLE / 1e6::DOUBLE, 3) AS mb FROM ({out['q32_areas']}), (SELECT orbit, reads FROM dl)"
    out["q34_stream_events"] = out["q30_pass_history"]
    km2_spots = f"{sens}, sp AS (SELECT label, count(*) AS n_pixels, sum({_km2('row')} * 1e6::DOUBLE) AS area, avg(row) AS r, avg(col) AS c FROM det GROUP BY 1)"
    out["q27_label_places"] = f"""{km2_spots}, o AS (SELECT label, (c + 0.5::DOUBLE) * 20 + 6 AS x, (r + 0.5::DOUBLE) * 20 AS y, row_number() OVER (ORDER BY round(area, 3) DESC, label) AS n FROM sp QUALIFY n <= 150),
        f(n, placed) AS (SELECT 0, []::STRUCT(spot_id BIGINT, x DOUBLE, y DOUBLE)[] UNION ALL SELECT f.n + 1, CASE WHEN len(list_filter(placed, lambda p: abs(p.x - o.x) < 66 AND abs(p.y - o.y) < 48)) = 0
            THEN list_append(placed, {{'spot_id': o.label, 'x': o.x, 'y': o.y}}) ELSE placed END FROM f JOIN o ON o.n = f.n + 1)
        SELECT p.spot_id AS spot_id, round(p.x, 4) AS x, round(p.y, 4) AS y FROM (SELECT unnest(placed) AS p FROM (SELECT placed FROM f ORDER BY n DESC LIMIT 1))"""
    out["q38_largest_spots"] = f"{km2_spots} SELECT label AS spot_id, n_pixels, round(area, 2) AS area_m2 FROM sp ORDER BY round(area, 3) DESC, label LIMIT 10"
    out["q36_tilted_windows"] = f"""WITH {_ITEMS}, wn AS (SELECT i AS tile_id, (i % 4) * 25 AS p, (i // 4) * 25 AS q FROM range(16) t(i)),
        e AS (SELECT seq, west + a AS x, south + b AS y, west + c AS u, south + d AS v FROM it, (VALUES (10, 0, 40, 10), (40, 10, 30, 40), (30, 40, 0, 30), (0, 30, 10, 0)) z(a, b, c, d)),
        t AS (SELECT tile_id, seq, p, q, x, y, u, v, [(u - x) * (q - y) - (v - y) * (p - x), (u - x) * (q - y) - (v - y) * (p + 25 - x), (u - x) * (q + 25 - y) - (v - y) * (p - x), (u - x) * (q + 25 - y) - (v - y) * (p + 25 - x)] AS s FROM e, wn),
        m AS (SELECT tile_id, seq, bool_or(greatest(x, u) >= p AND least(x, u) <= p + 25 AND greatest(y, v) >= q AND least(y, v) <= q + 25 AND list_min(s) <= 0 AND list_max(s) >= 0) AS crosses,
            count(*) FILTER ((y > q) <> (v > q) AND p < (u - x) * (q - y) / (v - y) + x) % 2 = 1 AS holds FROM t GROUP BY ALL)
        SELECT tile_id, count(*) AS n_scenes, min(seq) AS first_seq FROM m WHERE crosses OR holds GROUP BY 1"""
    out["q37_explicit_orbit"] = f"WITH {_ITEMS}, {_SIDES} SELECT orbit, side, count(*) AS n_scenes, count(DISTINCT day) AS days, min(seq) AS first_seq FROM sd WHERE side IS NOT NULL AND orbit = 7 GROUP BY 1, 2"
    out["q39_full_windows"] = f"""WITH {_OBS}, dn AS (SELECT (l_linenumber - 1)::INT AS pass_idx, (l_partkey // w)::INT AS r, (l_partkey % w)::INT AS c, avg(l_extendedprice) AS vv, avg(l_quantity) AS vh FROM lineitem, wd WHERE l_linenumber >= 4 GROUP BY 1, 2, 3),
        k AS (SELECT pass_idx, r + dr AS r, c + dc AS c, sum(vv) AS vv, sum(vh) AS vh FROM dn, range(-1, 2) a(dr), range(-1, 2) b(dc) GROUP BY 1, 2, 3 HAVING count(*) = 9),
        p AS (SELECT a.vv AS v1, b.vv AS v2, a.vh AS h1, b.vh AS h2 FROM k a JOIN k b ON b.pass_idx = a.pass_idx + 1 AND a.r = b.r AND a.c = b.c),
        x AS (SELECT ln(v1 / v2) AS q FROM p UNION ALL SELECT ln(h1 / h2) FROM p) SELECT count(*) AS n, round(quantile_cont(q, 0.25), 9) AS q25, round(quantile_cont(q, 0.75), 9) AS q75 FROM x"""
    out["q40_finite_samples"] = "WITH x AS (SELECT ln(o_totalprice / 1e5::DOUBLE) AS q FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0) SELECT count(*) AS n, round(quantile_cont(q, 0.25), 9) AS q25, round(quantile_cont(q, 0.75), 9) AS q75 FROM x"
    beta = "list_sum(list_transform(range(n, 2 * n), lambda j: factorial((2 * n - 1)::INT)::DOUBLE / (factorial(j::INT)::DOUBLE * factorial((2 * n - 1 - j)::INT)::DOUBLE) * pow(x, j) * pow(1 - x, 2 * n - 1 - j)))"
    out["q41_looks_table"] = f"""WITH RECURSIVE ln AS (SELECT n, count(*) AS orders FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY 1),
        b(n, k, lo, hi) AS (SELECT n, 0, 0.0::DOUBLE, 60.0::DOUBLE FROM ln UNION ALL
        SELECT n, k + 1, CASE WHEN below THEN mid ELSE lo END, CASE WHEN below THEN hi ELSE mid END FROM (SELECT n, k, lo, hi, mid, {beta} < 0.75 AS below FROM (SELECT *, (lo + hi) / 2 AS mid, 1 / (1 + exp(-(lo + hi) / 2)) AS x FROM b WHERE k < 80)))
        SELECT n, orders, round(lo + hi, 8) AS iqr, n::DOUBLE AS looks FROM b JOIN ln USING (n) WHERE k = 80"""
    out["q42_sample_windows"] = f"WITH {_OBS}, s AS (SELECT w, h, least(256, h, w) AS side FROM dim), a AS (SELECT DISTINCT greatest(0, floor(f * h)::INT - side // 2) AS r FROM s, (VALUES (0.3::DOUBLE), (0.7::DOUBLE)) t(f)), b AS (SELECT DISTINCT greatest(0, floor(f * w)::INT - side // 2) AS c FROM s, (VALUES (0.3::DOUBLE), (0.7::DOUBLE)) t(f)) SELECT r AS row, c AS col, least(side, h - r) AS height, least(side, w - c) AS width FROM a, b, s"
    merc = lambda v: f"(6378137 * ln(tan(pi() / 4 + radians({v}) / 2)))"
    out["q44_fitted_areas"] = f"""WITH bx AS (SELECT s_suppkey AS seq, ((s_suppkey * 37) % 120 - 60)::DOUBLE AS lon, ((s_suppkey * 53) % 100 - 50)::DOUBLE AS lat, (s_suppkey % 7) * (s_suppkey % 5) * 0.125::DOUBLE AS dx, (s_suppkey % 11) * 0.0625::DOUBLE AS dy FROM supplier),
        a AS (SELECT *, (west + east) / 2 AS x, (south + north) / 2 AS y, (east - west) AS sx, (north - south) AS sy FROM (SELECT seq, lon - dx AS west, lat - dy AS south, lon + dx AS east, lat + dy AS north FROM bx)),
        g AS (SELECT *, greatest(sx, 4 / (111.32::DOUBLE * cos(radians(y)))) AS gx, greatest(sy, 4 / 110.57::DOUBLE) AS gy, 10 / cos(radians(y)) AS s FROM a),
        p AS (SELECT *, 3e7::DOUBLE / (ceil((radians(x + gx / 2) - radians(x - gx / 2)) * 6378137 / s) * ceil(({merc('y + gy / 2')} - {merc('y - gy / 2')}) / s)) AS room FROM g),
        f AS (SELECT *, CASE WHEN room < 1 THEN 0.99::DOUBLE * sqrt(room) ELSE 1 END AS k FROM p)
        SELECT seq, round(x - gx * k / 2, 5) AS west, round(y - gy * k / 2, 5) AS south, round(x + gx * k / 2, 5) AS east, round(y + gy * k / 2, 5) AS north,
            CASE WHEN room < 1 THEN 'Too big for a 10 m analysis, so trimmed to the central area.' WHEN gx > sx OR gy > sy THEN 'Enlarged to at least 4 km across.' END AS note FROM f"""
    tiles = lambda out_width: f"""m AS (SELECT *, {out_width} AS ow, 2 * pi() * 6378137 AS world FROM sz),
        n AS (SELECT *, 0.5::DOUBLE + {_X0} / world AS l, 0.5::DOUBLE - {_Y0} / world AS t, w * {_SC} / world AS dx, h * {_SC} / world AS dy FROM m),
        z AS (SELECT *, unnest(range(0, least(19, greatest(0, ceil(log2(ow / 256 / dx))))::BIGINT + 1)) AS zoom FROM n),
        r AS (SELECT *, floor(l * pow(2, zoom))::BIGINT AS x1, floor((l + dx) * pow(2, zoom) - 1e-6::DOUBLE / 256)::BIGINT AS x2, floor(t * pow(2, zoom))::BIGINT AS y1, floor((t + dy) * pow(2, zoom) - 1e-6::DOUBLE / 256)::BIGINT AS y2 FROM z),
        best AS (SELECT * FROM r WHERE (x2 - x1 + 1) * (y2 - y1 + 1) <= 144 OR zoom = 0 ORDER BY zoom DESC LIMIT 1)"""  # noqa: E731
    size = "sz AS (SELECT w, h, round_even(w * f, 0)::BIGINT AS width, round_even(h * f, 0)::BIGINT AS height FROM (SELECT w, h, least(greatest(w, h, 1400), 2400) / greatest(w, h)::DOUBLE AS f FROM dim))"
    out["q45_web_tiles"] = f"WITH {_OBS}, {size}, {tiles('width')}, ux AS (SELECT *, unnest(range(x1, x2 + 1)) AS x FROM best) SELECT width, height, zoom, x, unnest(range(y1, y2 + 1)) AS y FROM ux"
    out["q46_result_round_trip"] = out["q01_pixel_change"]
    blob = '[1, {"bands": ["vv", "vh"], "bounds": [30.2, 50.5, 30.3, 50.6], "end": "2026-08-04", "images": 3, "label": "%s", "looks": 4.4, "orbit": null, "orbit_pass": null, "smooth": 3, "start": "2026-07-04"}]'
    out["q47_saved_results"] = f"{ch(1)} SELECT place, substr(sha1(replace('" + blob + "', '%s', label)), 1, 16) AS key, label, CASE label WHEN 'first' THEN (SELECT count(*) FROM ch) ELSE (SELECT count(*) FROM ch WHERE change_db > 0) END AS pixels FROM (VALUES (1, 'second'), (2, 'first')) t(place, label)"
    texts = "[CASE WHEN s >= e THEN 'The start must lie before the end.' END, CASE WHEN e > DATE '2016-11-01' THEN 'The end lies in the future.' END, CASE WHEN s < DATE '2014-10-01' THEN 'There are no images before October 2014.' END, CASE WHEN o_custkey % 6 NOT IN (1, 3, 5) THEN 'The filter is 1, 3 or 5 pixels wide.' END, CASE WHEN o_orderkey % 23 NOT BETWEEN 1 AND 20 THEN 'Between 1 and 20 images a side.' END]"
    out["q48_request_problems"] = f"WITH a AS (SELECT o_orderkey, o_custkey, s, s + (o_custkey % 90 - 10)::INT AS e FROM (SELECT *, o_orderdate::DATE + 7200 AS s FROM orders)), p AS (SELECT o_orderkey, list_filter({texts}, lambda x: x IS NOT NULL) AS ps FROM a) SELECT o_orderkey, unnest(CASE WHEN len(ps) = 0 THEN [NULL] ELSE ps END) AS problem FROM p"
    out["q49_catalogue_search"] = "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, 'S' || o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= DATE '1995-01-20' AND o_orderdate < DATE '1995-03-01'"
    out["q50_signed_links"] = f"WITH {_ITEMS}, l AS (SELECT seq, CASE seq % 5 WHEN 0 THEN '/local/' || seq WHEN 1 THEN 'https://h/' || seq || '?x=1' WHEN 2 THEN 's3://bucket/' || seq ELSE 'http://h/' || seq END AS link FROM it) SELECT seq, link, CASE WHEN seq % 5 IN (0, 2) THEN link ELSE link || CASE WHEN seq % 5 = 1 THEN '&' ELSE '?' END || CASE WHEN seq % 70 > 55 THEN 'sig=2' ELSE 'sig=1' END END AS signed FROM l"
    out["q51_places"] = "SELECT r_name AS query, n_name AS name, n_nationkey * 5.25::DOUBLE - 60 AS west, n_nationkey * 2.5::DOUBLE - 30 AS south, n_nationkey * 5.25::DOUBLE - 55.5::DOUBLE AS east, n_nationkey * 2.5::DOUBLE - 28 AS north FROM nation JOIN region ON n_regionkey = r_regionkey"
    listed = "string_agg(strftime(day, '%-d %b'), ', ' ORDER BY day) FILTER (side = '{0}') || strftime(max(day) FILTER (side = '{0}'), ' %Y') AS {0}"
    out["q52_plan_gaps"] = f"WITH {_ITEMS}, {_SIDES}, k AS (SELECT DISTINCT orbit, side, day, dense_rank() OVER (PARTITION BY orbit, side ORDER BY day DESC) AS n FROM sd WHERE side IS NOT NULL) SELECT orbit, greatest(DATE '1998-06-01' - max(day) FILTER (side = 'before'), DATE '1998-09-01' - max(day) FILTER (side = 'after'))::BIGINT AS gap, {listed.format('before')}, {listed.format('after')} FROM k WHERE n <= 3 GROUP BY 1"
    out["q53_newest_drawing"] = f"WITH {_ITEMS}, n AS (SELECT * FROM it QUALIFY row_number() OVER (PARTITION BY orbit ORDER BY day DESC, seq DESC) = 1) SELECT orbit, CASE WHEN seq % 5 <> 0 THEN west END AS west, CASE WHEN seq % 5 <> 0 THEN south END AS south, CASE WHEN seq % 5 <> 0 THEN west + 40 END AS east, CASE WHEN seq % 5 <> 0 THEN south + 40 END AS north FROM n"
    out["q54_unusable_pixels"] = out["q16_mosaic"].replace("WHERE vv > 0 AND vh > 0", "WHERE vv > 0 AND vh > 0 AND " + " AND ".join(f"(row * 3 + col + s) % {k} <> 0" for k in (5, 7, 11, 13, 17)))
    scale = f"coalesce((SELECT min(v) FROM (SELECT unnest({list(labels.NICE)}) AS v) WHERE v >= width * 0.15::DOUBLE * metres), {labels.LONGEST})"
    out["q55_legend"] = f"SELECT width, metres, n_name AS title, '2026-07-04 → 2026-08-04' AS dates, CASE WHEN bar >= 1000 THEN (bar // 1000) || ' km' ELSE bar || ' m' END AS scale, 'Balanced (≥3 dB, ≥400 m², noise chance < 1 in 100,000)' AS detection, n_spots || CASE WHEN n_spots = 1 THEN ' changed spot' ELSE ' changed spots' END AS spots FROM (SELECT *, {scale} AS bar FROM (SELECT n_name, n_nationkey * 64 + 800 AS width, [1.0::DOUBLE, 10.0::DOUBLE, 37.0::DOUBLE, 900.0::DOUBLE][n_nationkey % 4 + 1] AS metres, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_spots FROM nation))"
    out["q56_badges"] = out["q13_captions"].replace("SELECT label AS spot_id, ", "SELECT label AS spot_id, round(col * 2, 4) AS x, round(row * 2, 4) AS y, times_changed AS times, ") + " ORDER BY round(area_m2, 3) DESC, label LIMIT 300"
    level = out["q06_overview"]
    out["q57_backscatter"] = f"SELECT block_row AS row, block_col AS col, after AS r, after AS g, after AS b, CASE WHEN after > 0 THEN 255 ELSE 0 END AS a FROM ({level})"
    out["q58_radar_background"] = f"""WITH RECURSIVE {_OBS}, ov AS ({level}), ax AS (SELECT 'r' AS a, h * 2 AS n_out, (h + 3) // 4 AS n_in, 0.0::DOUBLE AS start, h / 4.0::DOUBLE / (h * 2) AS step FROM dim UNION ALL SELECT 'c', w * 2, (w + 3) // 4, 0.0, w / 4.0::DOUBLE / (w * 2) FROM dim),
        {_taps('greatest(1 - abs(x), 0)', 1)}
        SELECT out_row, out_col, round(coalesce(grey, 0), 6) AS grey FROM (SELECT (i // (w * 2))::INT AS out_row, (i % (w * 2))::INT AS out_col FROM dim, range(400000) t(i) WHERE i < w * h * 4)
        LEFT JOIN (SELECT r.out AS out_row, c.out AS out_col, sum(before * r.weight * c.weight) AS grey FROM ov JOIN tp r ON r.a = 'r' AND r.src = block_row JOIN tp c ON c.a = 'c' AND c.src = block_col GROUP BY 1, 2) USING (out_row, out_col)"""
    out["q59_tile_background"] = f"""WITH {_OBS}, sz AS (SELECT w, h FROM dim), {tiles('64')}, ax AS (SELECT 'r' AS a, 32 AS n_out, (y2 - y1 + 1) * 256 AS n_in, (t * pow(2, zoom) - y1) * 256 AS start, dy * pow(2, zoom) * 256 / 32 AS step, y1 AS first FROM best UNION ALL SELECT 'c', 64, (x2 - x1 + 1) * 256, (l * pow(2, zoom) - x1) * 256, dx * pow(2, zoom) * 256 / 64, x1 FROM best),
        {_taps('CASE WHEN x = 0 THEN 1 WHEN abs(x) < 3 THEN sin(pi() * x) / (pi() * x) * (sin(pi() * x / 3) / (pi() * x / 3)) ELSE 0 END', 3)},
        pr AS (SELECT out, src + first * 256 AS src, weight, tp.a FROM tp JOIN ax USING (a))
        SELECT out_row, out_col, round(greatest(least(r, 255), 0), 6) AS r, round(greatest(least(g, 255), 0), 6) AS g, round(greatest(least(b, 255), 0), 6) AS b FROM (SELECT y.out AS out_row, x.out AS out_col, sum(x.weight * y.weight * (x.src % 256)) AS r, sum(x.weight * y.weight * (y.src % 256)) AS g, sum(x.weight * y.weight * ((x.src // 256 + y.src // 256) % 256)) AS b FROM pr x JOIN pr y ON x.a = 'c' AND y.a = 'r' GROUP BY 1, 2)"""
    metres = f"({_SC} * cos(radians(({_LAT}::DOUBLE + degrees(2 * atan(exp(({_Y0} - h * {_SC}) / 6378137)) - pi() / 2)) / 2)) / 2)"
    marked = lambda name, up: f"{name} AS (SELECT *, (SELECT count(*) FROM m x WHERE x.increased = m.increased AND abs(x.r - m.r) + abs(x.c - m.c) = 1) < 4 AS rim FROM m WHERE increased = {up})"
    shade = lambda under, t, colour: f"CASE WHEN {t}.rim THEN {colour} * 0.6::DOUBLE WHEN {t}.r IS NOT NULL THEN {under} * 0.25::DOUBLE + {colour} * 0.75::DOUBLE ELSE {under} END"
    rows = out["q58_radar_background"].replace(f"WITH RECURSIVE {_OBS}, ov AS ({level})", f"{ch(3)}, ov AS ({level[len(ch(3)):]})")
    cut = rows.index("SELECT out_row, out_col, round(coalesce(grey, 0), 6) AS grey")
    sides = ", ".join(f"({', '.join(map(str, e))})" for e in ((0, -1, -0.6, 0.6), (-0.6, 0.6, 0, 0.2), (0, 0.2, 0.6, 0.6), (0.6, 0.6, 0, -1)))
    out["q66_picture"] = f"""{rows[:cut].replace('sum(before', 'sum(after').rstrip()},
        bg AS ({rows[cut:].replace('sum(before', 'sum(after')}), {_detected(BALANCED)},
        m AS (SELECT DISTINCT increased, row * 2 + a AS r, col * 2 + b AS c FROM det, range(2) x(a), range(2) y(b)), {marked('dn', 'false')}, {marked('up', 'true')},
        pt AS (SELECT out_row, out_col, {', '.join(f"{shade(shade('floor(grey + 0.5::DOUBLE)', 'dn', d), 'up', u)} AS {n}" for n, d, u in (('r', 255, 0), ('g', 59, 200), ('b', 48, 255)))} FROM bg LEFT JOIN dn ON dn.r = out_row AND dn.c = out_col LEFT JOIN up ON up.r = out_row AND up.c = out_col),
        sz AS (SELECT w * 2 AS ow, h * 2 AS oh, w * 2 / 60.0::DOUBLE AS s, greatest(1, w * 2 // 140) AS u, w * 2 * 3 // 5 AS lft, {metres} AS mpp FROM dim),
        ed AS (SELECT (ow - 2 * s) + a * s AS x, 1.6::DOUBLE * s + b * s AS y, (ow - 2 * s) + c * s AS u, 1.6::DOUBLE * s + d * s AS v FROM sz, (VALUES {sides}) t(a, b, c, d)),
        ar AS (SELECT p.out_row, p.out_col FROM bg p JOIN ed ON (y > out_row + 0.5::DOUBLE) <> (v > out_row + 0.5::DOUBLE) AND out_col + 0.5::DOUBLE < (u - x) * (out_row + 0.5::DOUBLE - y) / (v - y) + x GROUP BY 1, 2 HAVING count(*) % 2 = 1),
        ac AS (SELECT *, (SELECT count(*) FROM ar x WHERE abs(x.out_row - ar.out_row) + abs(x.out_col - ar.out_col) = 1) < 4 AS rim FROM ar),
        bar AS (SELECT *, least(floor(coalesce((SELECT min(v) FROM (SELECT unnest({list(labels.NICE)}) AS v) WHERE v >= ow * 0.15::DOUBLE * mpp), {labels.LONGEST}) / mpp), ow - lft) AS len FROM sz),
        pn AS (SELECT (oh + i // ow)::INT AS out_row, (i % ow)::INT AS out_col, i // ow AS r, i % ow AS c, u, lft, len FROM bar, range(1000000) t(i) WHERE i < ow * 12 * u),
        pk AS (SELECT out_row, out_col, CASE WHEN c >= lft AND c < lft + 2 * u AND r >= u AND r < 3 * u THEN [255, 59, 48] WHEN c >= lft AND c < lft + 2 * u AND r >= 4 * u AND r < 6 * u THEN [0, 200, 255] WHEN c >= lft AND c < lft + len AND r >= 8 * u AND r < 9 * u THEN [0, 0, 0] ELSE [255, 255, 255] END AS k FROM pn)
        SELECT out_row, out_col, {', '.join(f'CASE WHEN ac.rim THEN 0 WHEN ac.out_row IS NOT NULL THEN 255 ELSE floor({n}) END::INT AS {n}' for n in 'rgb')} FROM pt LEFT JOIN ac USING (out_row, out_col) UNION ALL SELECT out_row, out_col, k[1], k[2], k[3] FROM pk"""
    out["q67_sql_functions"] = f"{ch(1)}, {_detected(detect.Detection(1e-3, 0.0, 0.0))} SELECT label, count(*) AS n_pixels, min(signed) AS lowest, max(signed) AS highest FROM det GROUP BY 1"
    out["q60_polygon_cover"] = f"WITH {_AREAS}, {_COVER}, k AS (SELECT orbit, sum(wide * high) FILTER (n > 0) / 10000 AS c FROM wd GROUP BY 1) SELECT orbit, round(coalesce(c, 0), 8) AS coverage FROM (SELECT DISTINCT orbit FROM sup) LEFT JOIN k USING (orbit)"
    out["q61_polygon_windows"] = f"""WITH {_AREAS}, wn AS (SELECT i AS tile_id, (i % 20) * 5 AS p, (i // 20) * 5 AS q FROM range(400) t(i)),
        s AS (SELECT *, [(u - x) * (q - y) - (v - y) * (p - x), (u - x) * (q - y) - (v - y) * (p + 4 - x), (u - x) * (q + 4 - y) - (v - y) * (p - x), (u - x) * (q + 4 - y) - (v - y) * (p + 4 - x)] AS s FROM ed, wn),
        m AS (SELECT tile_id, seq, part, bool_or(greatest(x, u) >= p AND least(x, u) <= p + 4 AND greatest(y, v) >= q AND least(y, v) <= q + 4 AND list_min(s) <= 0 AND list_max(s) >= 0) AS crosses,
            count(*) FILTER ((y > q) <> (v > q) AND p < (u - x) * (q - y) / (v - y) + x) % 2 = 1 AS holds FROM s GROUP BY tile_id, seq, part)
        SELECT tile_id, count(DISTINCT seq) AS n_scenes, min(seq) AS first_seq FROM m WHERE crosses OR holds GROUP BY 1"""
    out["q64_mosaic_rounds"] = out["q16_mosaic"]
    out["q65_result_windows"] = out["q01_pixel_change"].replace(" SELECT row, col, signed, change_db FROM ch", " SELECT part, row, col, signed, change_db FROM ch, (SELECT 'middle' AS part, h // 3 AS a, w // 3 AS b, 9 AS n FROM dim UNION ALL SELECT 'corner', h - 4, w - 5, 100 FROM dim) WHERE row >= a AND row < a + n AND col >= b AND col < b + n")
    out["q62_utm_and_back"] = f"""WITH {_OBS}, {_utm_sql()}
        SELECT o.pass_idx, b.row, b.col, round(o.vv, 4) AS vv, round(o.vh, 4) AS vh FROM back b JOIN there t ON t.row = b.r AND t.col = b.c JOIN obs o ON o.r = t.r AND o.c = t.c"""
    out["q63_image_windows"] = f"WITH {_OBS} SELECT pass_idx, polarisation, r AS row, c AS col, round(value, 4) AS value FROM (SELECT pass_idx, r, c, unnest(['vv', 'vh']) AS polarisation, unnest([vv, vh]) AS value FROM obs), dim WHERE r >= h // 4 AND r < 3 * h // 4 AND c >= w // 4 AND c < 3 * w // 4"
    return out
