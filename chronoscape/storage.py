"""Tables in the folder that all executors share, and the versioned result store."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from dataclasses import asdict
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from .functions.grid import Grid

VERSION = 1
TABLES = ("pixel_change", "pixel_events", "overview")
#: The partition column of tables laid out by tile.
TILE = "tile"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. In a local session that names none, a temporary one serves."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='chronoscape-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends at files that survive lost executors."""
    path = f"{shared_dir(df.sparkSession)}/chronoscape/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def cache_key(params) -> str:
    """16 hex digits that name an analysis; the label is part of it, detection settings are not."""
    blob = json.dumps([VERSION, asdict(params)], sort_keys=True, default=str)
    return hashlib.sha1(blob.encode()).hexdigest()[:16]


class Store:
    """Results as folders of Parquet tables with a one-row header, keyed by parameters and versioned."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def save(self, params, header: dict, tables: dict[str, DataFrame], grid: Grid | None = None, tile: int = 1024) -> str:
        """The header goes last: a result without one was never finished and is not listed.

        With a grid, tables of pixels (row, col) are laid out by tile (a folder and a file each, which a tile's pixels
        bound), so that windows can be loaded on their own; `layout` in the header says so."""
        path = f"{self.root}/{cache_key(params)}"
        for name, df in tables.items():
            if grid is not None and {"row", "col"} <= set(df.columns):
                laid = df.withColumn(TILE, grid.tile_id(F.col("row"), F.col("col"), tile))
                laid.repartition(TILE).write.mode("overwrite").partitionBy(TILE).parquet(f"{path}/{name}")
            else:
                df.write.mode("overwrite").parquet(f"{path}/{name}")
        if grid is not None:
            header = header | {"layout": asdict(grid) | {"tile": tile}}
        row = (VERSION, params.label, json.dumps(asdict(params), default=str), json.dumps(header, default=str))
        self.spark.createDataFrame([row], "version int, label string, params string, header string").coalesce(1).write.mode("overwrite").parquet(f"{path}/header")
        return path

    def has(self, params) -> bool:
        fs, p = self._fs(f"{self.root}/{cache_key(params)}/header/_SUCCESS")
        return fs.exists(p)

    def load(self, params) -> tuple[dict, dict[str, DataFrame]]:
        path = f"{self.root}/{cache_key(params)}"
        head = self.spark.read.parquet(f"{path}/header").first()
        if head.version != VERSION:
            raise ValueError(f"saved by version {head.version}; this is version {VERSION}")
        found = {}
        for name in TABLES:
            fs, p = self._fs(f"{path}/{name}")
            if fs.exists(p):
                found[name] = self.spark.read.parquet(f"{path}/{name}").drop(TILE)
        return json.loads(head.header), found

    def load_windows(self, params, name: str, windows: DataFrame) -> DataFrame:
        """The pixels of a table laid out by tile that lie in the windows (row, col, height, width and other columns, which
        are kept), once a window.

        Windows are turned into the tiles they meet and joined on the tile, which the table is partitioned by: Spark
        learns the tiles from the windows and lists no other folder."""
        path = f"{self.root}/{cache_key(params)}"
        layout = json.loads(self.spark.read.parquet(f"{path}/header").first().header).get("layout")
        if layout is None:
            raise ValueError("the result is not laid out by tile")
        size = layout["tile"]
        across = -(-layout["width"] // size)
        span = lambda start, length, most: F.explode(F.sequence(F.greatest(F.floor(F.col(start) / size), F.lit(0)), F.least(F.floor((F.col(start) + F.col(length) - 1) / size), F.lit((most - 1) // size))))
        meets = (F.col("height") > 0) & (F.col("width") > 0) & (F.col("row") < layout["height"]) & (F.col("col") < layout["width"]) & (F.col("row") + F.col("height") > 0) & (F.col("col") + F.col("width") > 0)
        met = windows.where(meets).withColumn("_tr", span("row", "height", layout["height"])).withColumn("_tc", span("col", "width", layout["width"]))
        others = [c for c in windows.columns if c not in ("row", "col", "height", "width")]
        met = met.select(*others, *[F.col(c).alias(f"_{c}") for c in ("row", "col", "height", "width")], (F.col("_tr") * across + F.col("_tc")).alias("_tile")).where("_tile >= 0")  # a filter on the windows' side is what tells Spark to prune by it
        tiles = met.select(F.col("_tile").alias(TILE)).distinct()
        if across * -(-layout["height"] // size) <= 100_000:  # as many rows at most, of a number each
            tiles = F.broadcast(tiles)
        pixels = self.spark.read.parquet(f"{path}/{name}")
        inside = (F.col("row") >= F.col("_row")) & (F.col("row") < F.col("_row") + F.col("_height")) & (F.col("col") >= F.col("_col")) & (F.col("col") < F.col("_col") + F.col("_width"))
        got = pixels.join(tiles, TILE, "left_semi").join(met, F.col(TILE) == F.col("_tile")).where(inside)
        return got.select(*others, *[c for c in pixels.columns if c != TILE and c not in others])

    def saved(self) -> DataFrame:
        """key, label, params, modified of readable results of this version, newest first."""
        empty = self.spark.createDataFrame([], "key string, label string, params string, modified timestamp")
        fs, p = self._fs(self.root)
        if not fs.exists(p) or not fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/*/header/_SUCCESS")):
            return empty
        heads = self.spark.read.option("pathGlobFilter", "*.parquet").parquet(f"{self.root}/*/header")
        heads = heads.where(F.col("version") == VERSION).select(F.element_at(F.split("_metadata.file_path", "/"), -3).alias("key"), "label", "params", F.col("_metadata.file_modification_time").alias("modified"))
        return heads.orderBy(F.desc("modified"))

    def delete_all(self) -> None:
        fs, p = self._fs(self.root)
        if fs.exists(p):
            fs.delete(p, True)
