"""Star-schema tables as stand-ins for an archive: line items as pixels, orders as scenes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import RADIUS, Grid

#: Line numbers 1-4 are the passes before, 5-7 those after.
N_BEFORE, N_PASSES = 4, 7
PASS_DAYS = [f"2026-{m:02d}-{d:02d}" for m, d in ((6, 16), (6, 22), (6, 28), (7, 4), (7, 22), (7, 28), (8, 3))]
SOUTH_WEST = (30.2, 50.5)
AOI = (0.0, 0.0, 100.0, 100.0)
START, END, LOOKBACK = "1998-06-01", "1998-09-01", 90


def grid_of(spark: SparkSession, sf_dir: str) -> Grid:
    """Width by the number of parts, and height to hold them all; 10 m pixels north-east of SOUTH_WEST."""
    top = spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg(F.max("l_partkey")).first()[0]
    width = 100 if top > 10_000 else 50 if top > 1_000 else 20
    lon, lat = SOUTH_WEST
    return Grid(math.radians(lon) * RADIUS, RADIUS * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)), 10 / math.cos(math.radians(lat)), width, top // width + 1)


def raw_obs(spark: SparkSession, sf_dir: str, width: int) -> DataFrame:
    """pass_idx, scene_seq, row, col, vv, vh: one row per line item's scene; a scene may lack a band."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price = lambda status: F.avg(F.when(F.col("l_linestatus") == status, F.col("l_extendedprice")))
    key = [(F.col("l_linenumber") - 1).cast("int").alias("pass_idx"), (F.col("l_orderkey") % 5).alias("scene_seq"), F.floor(F.col("l_partkey") / width).cast("int").alias("row"), (F.col("l_partkey") % width).cast("int").alias("col")]
    return items.groupBy(*key).agg(price("F").alias("vv"), price("O").alias("vh"))


def obs(spark: SparkSession, sf_dir: str, width: int, planted: bool = True) -> DataFrame:
    """pass_idx, row, col, vv, vh with both bands; planted: a lasting decrease and a passing increase."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price = lambda status: F.avg(F.when(F.col("l_linestatus") == status, F.col("l_extendedprice")))
    key = [(F.col("l_linenumber") - 1).cast("int").alias("pass_idx"), F.floor(F.col("l_partkey") / width).cast("int").alias("row"), (F.col("l_partkey") % width).cast("int").alias("col")]
    got = items.groupBy(*key).agg(price("F").alias("vv"), price("O").alias("vh")).where("vv is not null and vh is not null")
    if not planted:
        return got
    patch = F.col("row").between(2, 5) & F.col("col").between(5, 11) & (F.col("pass_idx") >= 4)
    busy = F.col("row").between(1, 3) & F.col("col").between(14, 17) & F.col("pass_idx").isin(4, 6)
    factor = F.when(patch, 10**-0.7).otherwise(1.0) * F.when(busy, 10.0).otherwise(1.0)
    return got.select("pass_idx", "row", "col", (F.col("vv") * factor).alias("vv"), (F.col("vh") * factor).alias("vh"))


def items(spark: SparkSession, sf_dir: str, by_day: bool = False) -> DataFrame:
    """seq, item: orders as catalogue features in JSON; some lack a band or have another mode. by_day: day as text too,
    and the items of a day in one task."""
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    o = orders.join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    o = o.repartition(day) if by_day else o.repartition(spark.sparkContext.defaultParallelism)  # one file is read by one task, which would also write and parse all JSON
    west, south = (((F.col("o_custkey") * k) % 100 - 20).cast("double") for k in (37, 53))
    ring = F.array(*[F.array(west + dx, south + dy) for dx, dy in ((0, 0), (40, 0), (40, 40), (0, 40), (0, 0))])
    seq = F.col("o_orderkey")
    properties = F.struct(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"), F.col("c_nationkey").alias("sat:relative_orbit"),
        F.when(F.col("c_nationkey") % 2 == 0, "Ascending").otherwise("DESCENDING").alias("sat:orbit_state"),
        F.when(seq % 13 == 0, "EW").when(seq % 3 == 0, "IW").alias("sar:instrument_mode"),
    )
    href = lambda b: F.struct(F.concat(F.lit(f"file:/{b}/"), seq.cast("string")).alias("href"))
    assets = F.when(seq % 17 == 0, F.create_map(F.lit("vv"), href("vv"))).otherwise(F.create_map(F.lit("vv"), href("vv"), F.lit("VH"), href("vh"), F.lit("thumb"), href("t")))
    feature = F.struct(F.concat(F.lit("S"), seq.cast("string")).alias("id"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), properties.alias("properties"), assets.alias("assets"))
    return o.select(*[day] * by_day, seq.alias("seq"), F.to_json(feature).alias("item"))


#: Parts of the areas of `polygon_items` by supplier number modulo 3, about their south-west corner; rings after a part's first are holes.
SHAPES = {
    0: [[[(10, 0), (40, 10), (30, 40), (0, 30)], [(15, 15), (25, 15), (25, 25), (15, 25)]]],
    1: [[[(0, 0), (30, 5), (5, 30)]], [[(50, 20), (70, 25), (65, 45), (45, 40)], [(55, 30), (60, 30), (58, 36)]]],
    2: [[[(0, 0), (40, 0), (20, 15), (40, 40), (0, 40)]]],
}


def polygon_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, item: suppliers as catalogue features with areas that are tilted, have holes or consist of parts."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    seq = F.col("s_suppkey")
    west, south = (((seq * k) % 100 - 20).cast("double") for k in (37, 53))
    ring = lambda points: F.array(*[F.array(west + x, south + y) for x, y in [*points, points[0]]])
    parts = {k: F.array(*[F.array(*map(ring, part)) for part in shape]) for k, shape in SHAPES.items()}
    geometry = F.when(seq % 3 == 1, F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), parts[1].alias("coordinates"))))
    for k in (0, 2):
        geometry = geometry.when(seq % 3 == k, F.to_json(F.struct(F.lit("Polygon").alias("type"), parts[k][0].alias("coordinates"))))
    text = F.format_string('{"id": "S%d", "geometry": %s, "properties": {"datetime": "1998-05-01T00:00:00Z", "sat:relative_orbit": %d, "sat:orbit_state": "ascending"}, "assets": {"vv": {"href": "v"}, "vh": {"href": "h"}}}', seq, geometry, F.col("s_nationkey"))
    return s.select(seq.alias("seq"), text.alias("item"))


def dense_obs(spark: SparkSession, sf_dir: str, width: int) -> DataFrame:
    """pass_idx, row, col, vv, vh from prices and quantities: present wherever a part was sold in a line of that number."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = [(F.col("l_linenumber") - 1).cast("int").alias("pass_idx"), F.floor(F.col("l_partkey") / width).cast("int").alias("row"), (F.col("l_partkey") % width).cast("int").alias("col")]
    return items.groupBy(*key).agg(F.avg("l_extendedprice").alias("vv"), F.avg("l_quantity").alias("vh"))


def catalogue_files(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """The features of `items` as a folder of text files a day, which `offline_catalogue` answers from."""
    items(spark, sf_dir, by_day=True).select("day", F.col("item").alias("value")).write.partitionBy("day").text(folder)
    return folder


def offline_catalogue(method: str, url: str, body: dict | None) -> dict:
    """A catalogue without a network, from files in a folder that all executors share: at most forty items a page; later
    pages come by link, every other one by GET. A link says where its page begins (number of the page, day, file of the
    day, byte), so a page reads its own items only."""
    import datetime as dt
    import glob
    import json

    folder, question = (url, None) if method == "POST" else url.split("?")
    span = body["datetime"].split("/") if question is None else question.split("/")[:2]
    first, last = (dt.date.fromisoformat(t[:10]) for t in span)
    token = body.get("token") if question is None else question.split("/", 2)[2]
    page, day, file, at = token.split("/") if token else (0, first, 0, 0)
    page, day, file, at = int(page), dt.date.fromisoformat(str(day)), int(file), int(at)
    features = []
    while day <= last and len(features) < 40:
        files = sorted(glob.glob(f"{folder.removeprefix('file://')}/day={day}/part-*"))
        if file == len(files):
            day, file = day + dt.timedelta(days=1), 0
            continue
        with open(files[file], "rb") as f:
            f.seek(at)
            while len(features) < 40 and (line := f.readline()):
                features.append(json.loads(line))
            at = f.tell()
        if len(features) < 40:
            file, at = file + 1, 0
    reply = {"features": features, "links": [{"rel": "self", "href": url}]}
    if len(features) == 40:  # the page after the last item may be empty
        place = f"{page + 1}/{day}/{file}/{at}"
        by_get = {"rel": "next", "href": f"{folder}?{first}/{last}/{place}"}
        by_post = {"rel": "next", "method": "POST", "href": folder, "body": {"token": place, "datetime": f"{first}/{last}"}}
        reply["links"].append(by_get if page % 2 else by_post)
    return reply
