"""The analysis as one plan: pixels in, stored result out; detection is a second, cheap plan over the result."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.grid import Grid
from ..operators import change, detect
from ..storage import Store, materialize


@dataclass(frozen=True)
class Params:
    """bounds: west, south, east, north. looks: None to measure them. The label is part of a result's identity."""

    label: str
    bounds: tuple
    start: str
    end: str
    images: int = 3
    smooth: int = 3
    orbit_pass: str | None = None
    orbit: int | None = None
    looks: float | None = None
    bands: tuple = ("vv", "vh")


def problems(p: Params, today: dt.date, most_pixels: float = 30e6, most_images: int = 20) -> list[str]:
    """What is wrong with a request, in words."""
    west, south, east, north = p.bounds
    start, end = dt.date.fromisoformat(p.start), dt.date.fromisoformat(p.end)
    checks = (
        (start >= end, "The start must lie before the end."), (end > today, "The end lies in the future."), (start < dt.date(2014, 10, 1), "There are no images before October 2014."),
        (not p.bands, "Choose a band."), (west >= east or south >= north, "The area has no extent."), (p.smooth not in (1, 3, 5), "The filter is 1, 3 or 5 pixels wide."),
        (not 1 <= p.images <= most_images, f"Between 1 and {most_images} images a side."),
        (west < east and south < north and Grid.over(p.bounds).pixels > most_pixels, "The area is too large."),
    )
    return [text for bad, text in checks if bad]


@dataclass
class Result:
    params: Params
    grid: Grid
    pass_days: list
    n_before: int
    looks: float
    pixel_change: DataFrame
    pixel_events: DataFrame
    overview: DataFrame | None

    def comparison(self, name: str) -> DataFrame | None:
        if name == "null" and self.n_before < 2:
            return None
        return self.pixel_change.where(F.col("comparison") == name)


def run(obs: DataFrame, params: Params, pass_days: list, n_before: int, grid: Grid, store: Store | None = None, progress: Callable[[float, str], None] = lambda share, text: None, all_before: DataFrame | None = None) -> Result:
    """Compare the passes after with those before; obs has one row per selected pass and pixel (see `mosaic`).

    all_before: every pass of the orbit up to the start, for measuring looks; by default the selected ones.
    """
    if store and store.has(params):
        header, tables = store.load(params)
        return Result(params, Grid(**header["grid"]), header["days"], header["n_before"], header["looks"], tables["pixel_change"], tables["pixel_events"], tables.get("overview"))
    size, bands, h, w = params.smooth, params.bands, grid.height, grid.width
    looks = params.looks or stats.NOMINAL_LOOKS * size * size
    if params.looks is None:
        progress(0.1, "measuring looks")
        before = all_before if all_before is not None else obs.where(F.col("pass_idx") < n_before)
        looks = change.measure_looks(before, size, h, w, bands) or looks
    progress(0.3, "comparing passes")
    found = change.pixel_change(obs, n_before, looks, size, h, w, bands, lambda sums: materialize(sums, "sums"))
    if found["change"].isEmpty():
        raise ValueError("No pixel has data on both sides.")
    stacked = None
    for name, df in found.items():
        part = df.select(F.lit(name).alias("comparison"), "row", "col", "signed", "change_db")
        stacked = part if stacked is None else stacked.unionByName(part)
    tables = {"pixel_change": stacked, "pixel_events": change.pixel_events(obs, n_before, looks, size, h, w, bands)}
    if "vv" in bands:
        tables["overview"] = change.overview(found["change"])
    progress(0.8, "storing")
    if store:
        store.save(params, {"grid": grid.__dict__, "days": [str(d) for d in pass_days], "n_before": n_before, "looks": looks}, tables, grid)
        return run(obs, params, pass_days, n_before, grid, store)
    tables = {k: materialize(v, k) for k, v in tables.items()}
    return Result(params, grid, [str(d) for d in pass_days], n_before, looks, tables["pixel_change"], tables["pixel_events"], tables.get("overview"))


def report(result: Result, det: detect.Detection = detect.Detection()) -> dict[str, DataFrame]:
    """flagged, spots and summary under the given detection settings."""
    bands = len(result.params.bands)
    now, null = result.comparison("change"), result.comparison("null")
    flagged = materialize(detect.detect(now, det, bands), "flagged")
    noise = detect.detect(null, det, bands) if null is not None else None
    return {"flagged": flagged, "spots": detect.spots(flagged, result.pixel_events, result.grid, result.pass_days), "summary": detect.summarise(now, flagged, null, noise, result.grid)}
