"""Detection on stored results: thresholds, patches, spots and the summary."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, stats
from ..functions.grid import PIXEL_M, Grid
from ..storage import materialize
from . import components

#: Share of a patch's pixels that must show a pass-to-pass change for the patch to have it.
SHARE = 0.3


@dataclass(frozen=True)
class Detection:
    """A change is significant at alpha, at least min_db large, and part of a patch of min_area_m2."""

    alpha: float = 1e-5
    min_db: float = 3.0
    min_area_m2: float = 400

    @property
    def min_pixels(self) -> int:
        return max(1, math.ceil(self.min_area_m2 / PIXEL_M**2))


PRESETS = {"Sensitive": Detection(1e-3, 1.5, 100), "Balanced": Detection(), "Strict": Detection(1e-7, 6.0, 2000)}


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, d.alpha, d.min_db, float(d.min_area_m2)) for n, d in PRESETS.items()], "name string, alpha double, min_db double, min_area_m2 double")


def candidates(change: DataFrame, det: Detection, bands: int = 2) -> DataFrame:
    """Pixels beyond both thresholds, on the stored (rounded) values, with increased."""
    stat, _, valid = stats.decode(F.col("signed"))
    over = valid & (stat > stats.chi2_threshold(det.alpha, bands)) & (F.abs(F.col("change_db") / 100.0) >= det.min_db)
    return change.where(over).select("row", "col", "signed", "change_db", (F.col("change_db") > 0).alias("increased"))


def detect(change: DataFrame, det: Detection = Detection(), bands: int = 2) -> DataFrame:
    """candidates in patches of enough pixels, with label; patches join pixels of either direction."""
    labelled = materialize(components.label(candidates(change, det, bands)), "labelled")
    large = labelled.groupBy("label").count().where(F.col("count") >= det.min_pixels)
    return labelled.join(large, "label", "left_semi")


def spots(found: DataFrame, events: DataFrame | None, grid: Grid, pass_days: list) -> DataFrame:
    """One row per patch: place, area, mean change, and the pairs of passes between which it was seen to change.

    pass_days: the selected days in order. A pair counts if SHARE of the patch's pixels show it.
    """
    pairs = len(pass_days) - 1
    lit = lambda d: F.to_date(F.lit(str(d)))
    when = [F.concat(labels.day_label(lit(a)), F.lit(" → "), labels.day_label(lit(b))) for a, b in zip(pass_days, pass_days[1:], strict=False)]
    seen = found.withColumn("events", F.lit(0).cast("long")) if events is None else found.join(events, ["row", "col"], "left").fillna(0, ["events"])
    shares = [F.avg(F.expr(f"cast(shiftright(events, {i}) & 1 as int)")).alias(f"share_{i}") for i in range(pairs)]
    agg = seen.groupBy("label").agg(
        F.count("*").alias("n_pixels"), F.sum(grid.pixel_km2(F.col("row")) * 1e6).alias("area_m2"), (F.sum("change_db") / (F.count("*") * 100.0)).alias("change_db"),
        F.avg("row").alias("row"), F.avg("col").alias("col"), *shares,
    )
    kept = F.array_compact(F.array(*[F.when(F.col(f"share_{i}") >= SHARE, w) for i, w in enumerate(when)])) if pairs > 0 else F.array().cast("array<string>")
    return agg.select(
        F.col("label").alias("spot_id"), grid.latitude(F.col("row")).alias("latitude"), grid.longitude(F.col("col")).alias("longitude"), "area_m2", "change_db",
        F.when(F.col("change_db") < 0, "decrease").otherwise("increase").alias("direction"), F.size(kept).alias("times_changed"), kept.alias("when"), "row", "col", "n_pixels",
    )


def largest_first(found: DataFrame, most: int | None = None) -> DataFrame:
    """By falling area, to a thousandth of a square metre so that sums in another order do not tell; then by name."""
    ordered = found.orderBy(F.desc(F.round("area_m2", 3)), "spot_id")
    return ordered if most is None else ordered.limit(most)


def summarise(change: DataFrame, found: DataFrame, null: DataFrame | None, noise: DataFrame | None, grid: Grid) -> DataFrame:
    """One row: analysed, increase and decrease areas in km2, spots; noise figures are null without a null comparison."""
    km2 = grid.pixel_km2(F.col("row"))
    up, down = F.when(F.col("increased"), km2), F.when(~F.col("increased"), km2)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    one = change.where(F.col("signed") != stats.NODATA).agg(zero(F.sum(km2)).alias("analysed_km2"))
    two = found.agg(zero(F.sum(up)).alias("increase_km2"), zero(F.sum(down)).alias("decrease_km2"), F.count_distinct("label").alias("spots"))
    if null is None:
        three = one.sparkSession.createDataFrame([(None, None)], "noise_km2 double, noise_spots long")
    else:
        three = noise.agg(zero(F.sum(km2)).alias("noise_km2"), F.count_distinct("label").alias("noise_spots"))
    return one.crossJoin(two).crossJoin(three)  # one row each


def spot_lines(found: DataFrame) -> DataFrame:
    """line: the rows of the CSV export (without its header), in order of spot."""
    text = F.format_string("%.6f,%.6f,%.0f,%.2f,%s,%d,\"%s\"", "latitude", "longitude", "area_m2", "change_db", "direction", "times_changed", F.array_join("when", "; "))
    return found.select("spot_id", "area_m2", text.alias("line"))


HEADER = "latitude,longitude,area_m2,change_db,direction,times_changed,when"


def write_csv(found: DataFrame, path: str) -> None:
    """Header and lines, largest spot first, as one text file; spots are few (patches, not pixels)."""
    spark = found.sparkSession
    lines = spot_lines(found).select(F.lit(1).alias("part"), "area_m2", "spot_id", "line")
    head = spark.createDataFrame([(0, 0.0, 0, HEADER)], "part int, area_m2 double, spot_id long, line string")
    head.unionByName(lines).orderBy("part", F.desc("area_m2"), "spot_id").select("line").coalesce(1).write.mode("overwrite").text(path)
