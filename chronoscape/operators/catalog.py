"""Catalogue items to scenes, and the plan: which passes of which orbit an analysis uses.

scenes: id string, day date, orbit int, orbit_state string, seq long (catalogue order), geometry
struct<type string, coordinates array<array<array<array<double>>>>> (polygons of rings, whether type is Polygon or
MultiPolygon; null for others), hrefs map<string,string>.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import Grid
from ..functions.labels import lookback_days
from ..storage import materialize
from . import cover

ITEM = (
    "id string, geometry struct<type:string,coordinates:string>, "
    "properties struct<datetime:string,`sat:relative_orbit`:int,`sat:orbit_state`:string,`sar:instrument_mode`:string>, assets map<string,struct<href:string>>"
)
BANDS = ("VV", "VH")
#: Compressed bytes of one pixel of one band of one pass, for estimates.
PIXEL_BYTES = 3.2
#: From this share on, a better cover no longer decides between orbits.
FULL = 0.98


def once(df: DataFrame, value: Column, *keep: str) -> DataFrame:
    """df's columns `keep` and the fields of the struct `value`, which is made once a row: filters on its fields, which
    would otherwise each repeat what makes them, stay above the generator."""
    return df.select(*keep, F.explode(F.array(value)).alias("_one")).select(*keep, "_one.*")


def scenes(items: DataFrame) -> DataFrame:
    """items (seq long, item string: a catalogue feature as JSON) to scenes; other modes and single bands go."""
    parsed = once(items, F.from_json("item", ITEM), "seq")
    upper = F.transform_keys("assets", lambda k, v: F.upper(k))
    hrefs = F.map_filter(F.transform_values(upper, lambda k, v: v["href"]), lambda k, v: k.isin(*BANDS))
    p = F.col("properties")
    got = parsed.withColumn("hrefs", hrefs).where((F.coalesce(p["sar:instrument_mode"], F.lit("IW")) == "IW") & (F.size("hrefs") == len(BANDS)))
    state = F.lower(F.coalesce(p["sat:orbit_state"], F.lit("")))
    shape = F.struct(F.col("geometry.type").alias("type"), cover.polygons_of(F.col("geometry.type"), F.col("geometry.coordinates")).alias("coordinates"))
    fields = F.struct("id", F.to_date(F.substring(p["datetime"], 1, 10)).alias("day"), p["sat:relative_orbit"].alias("orbit"), state.alias("orbit_state"), "seq", shape.alias("geometry"), "hrefs")
    return once(got, fields)


def footprint_box(geometry: Column) -> dict[str, Column]:
    ring = F.flatten(F.flatten(geometry["coordinates"]))
    x, y = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    return {"west": F.array_min(x), "south": F.array_min(y), "east": F.array_max(x), "north": F.array_max(y)}


def search(found: DataFrame, bounds: tuple, start, end) -> DataFrame:
    """Scenes from start up to, not including, end whose footprint's box meets the bounds."""
    west, south, east, north = bounds
    box = footprint_box(F.col("geometry"))
    meets = (box["west"] <= east) & (box["east"] >= west) & (box["south"] <= north) & (box["north"] >= south)
    return found.where((F.col("day") >= F.lit(str(start)).cast("date")) & (F.col("day") < F.lit(str(end)).cast("date")) & meets)


@dataclass(frozen=True)
class Request:
    """What a plan is made for; images: passes wanted on each side."""

    bounds: tuple
    start: str
    end: str
    images: int = 3
    orbit_pass: str | None = None
    orbit: int | None = None
    lookback: int | None = None

    @property
    def days_back(self) -> int:
        return self.lookback if self.lookback is not None else lookback_days(self.images)


def sides(found: DataFrame, request: Request) -> DataFrame:
    """The scenes of both windows with side: before [start - lookback, start], after (start, end]."""
    day, start, end = F.col("day"), F.to_date(F.lit(request.start)), F.to_date(F.lit(request.end))
    side = F.when((day >= F.date_sub(start, request.days_back)) & (day <= start), "before").when((day > start) & (day <= end), "after")
    got = found.withColumn("side", side).where("side is not null")
    if request.orbit_pass:
        got = got.where(F.col("orbit_state") == request.orbit_pass.lower())
    if request.orbit is not None:
        got = got.where(F.col("orbit") == request.orbit)
    return got


def coverage(found: DataFrame, bounds: tuple, cells: int = 8) -> DataFrame:
    """orbit, side, coverage of the bounds by the union of the footprints: holes and all parts count."""
    return cover.covered(found.select("orbit", "side", F.col("geometry.coordinates").alias("polygons")), ["orbit", "side"], bounds, cells)


def orbits(found: DataFrame, request: Request) -> DataFrame:
    """orbit, coverage (the lesser of the sides), before, after (days) and gap_days of orbits seen on both sides.

    All days and scenes of the windows count, not only those that will be selected. The items are read once.
    """
    found = materialize(found.select("orbit", "side", "day", "geometry"), "sides")
    days = found.groupBy("orbit").pivot("side", ["before", "after"]).agg(F.count_distinct("day").alias("n"), F.max("day").alias("last")).where("before_n > 0 and after_n > 0")
    cover = coverage(found, request.bounds).groupBy("orbit").agg(F.min("coverage").alias("coverage"))
    gap = F.datediff(F.lit(request.start).cast("date"), "before_last") + F.datediff(F.lit(request.end).cast("date"), "after_last")
    return days.join(cover, "orbit").select("orbit", "coverage", F.col("before_n").alias("before"), F.col("after_n").alias("after"), gap.alias("gap_days"))


def best_orbit(table: DataFrame) -> DataFrame:
    """The one row of the orbit with full cover, or else most; then nearest to the dates, then most passes, then least."""
    full = F.col("coverage") > FULL
    order = [F.desc(full), F.desc(F.when(full, 0.0).otherwise(F.col("coverage"))), F.asc("gap_days"), F.desc(F.least("before", "after")), F.asc("orbit")]
    return table.orderBy(*order).limit(1)


def select_days(found: DataFrame, orbit: int | None, images: int) -> DataFrame:
    """The scenes of the latest `images` days on each side (of one orbit, or of each)."""
    own = found if orbit is None else found.where(F.col("orbit") == orbit)
    days = own.select("orbit", "side", "day").distinct()
    rank = F.row_number().over(Window.partitionBy("orbit", "side").orderBy(F.desc("day")))
    latest = days.withColumn("_r", rank).where(F.col("_r") <= images).drop("_r")
    return own.join(latest, ["orbit", "side", "day"], "left_semi")


@dataclass(frozen=True)
class Plan:
    orbit: int
    orbit_state: str
    before: list
    after: list
    all_before: list
    table: DataFrame
    scenes: DataFrame
    download_mb: float


NO_ORBIT = "No orbit has passes both up to the start date and between start and end. Try a longer range of dates."


def make_plan(found: DataFrame, request: Request, grid: Grid | None = None, bands: int = 2) -> Plan:
    """Search, choose the orbit and its days. What reaches the driver is one row and a few dozen dates."""
    back = Request(**{**request.__dict__})
    first = pd.Timestamp(back.start) - pd.Timedelta(days=back.days_back)
    window = search(found, request.bounds, first.date(), (pd.Timestamp(back.end) + pd.Timedelta(days=1)).date())
    both = sides(window, request)
    table = orbits(both, request)
    best = best_orbit(table).first()
    if best is None:
        raise ValueError(NO_ORBIT)
    own = both.where(F.col("orbit") == best.orbit)
    days = own.groupBy("side").agg(F.array_sort(F.collect_set("day")).alias("days")).collect()
    by = {r.side: r.days for r in days}
    state = own.where("side = 'before'").orderBy("seq").select("orbit_state").first().orbit_state
    before, after = by["before"][-request.images :], by["after"][-request.images :]
    size = (grid or Grid.over(request.bounds)).pixels
    return Plan(best.orbit, state, before, after, by["before"], table, select_days(both, best.orbit, request.images), size * bands * (len(before) + len(after)) * PIXEL_BYTES / 1e6)


def notes(plan: Plan, request: Request, big_mb: float = 500) -> list[str]:
    """What a user should know before running: old images, too few images, a large download."""
    latest = {"start": (request.start, plan.before), "end": (request.end, plan.after)}
    age, date = max(((pd.Timestamp(day) - pd.Timestamp(days[-1])).days, which) for which, (day, days) in latest.items())
    out = [f"The newest image for the {date} date was taken {age} days earlier."] if age > 14 else []
    windows = {"before": f"up to {request.start}", "after": f"between {request.start} and {request.end}"}
    out += [f"{len(days)} of the {request.images} images wanted were found {windows[side]}." for side, days in (("before", plan.before), ("after", plan.after)) if len(days) < request.images]
    if plan.download_mb > big_mb:
        out.append(f"About {plan.download_mb:,.0f} MB have to be read; a smaller area or fewer images need less.")
    return out
