"""End to end on a synthetic archive with known truth, against a plain numpy model."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoscape.functions import stats
from chronoscape.functions.grid import Grid
from chronoscape.operators import change, components, detect, neighbourhood, present
from chronoscape.plans import analysis
from chronoscape.storage import Store
from chronoscape.streaming import passes

H, W, N, NB = 40, 60, 6, 3
LOOKS = 5.0
DAYS = ["2026-06-22", "2026-06-28", "2026-07-04", "2026-07-22", "2026-07-28", "2026-08-03"]
GRID = Grid(3_361_000.0, 6_540_000.0, 15.7, W, H)


def archive(missing=0.1):
    rng = np.random.default_rng(42)
    mean = 10 ** rng.uniform(-2, 0, (2, H, W))
    x = rng.gamma(LOOKS, 1 / LOOKS, (N, 2, H, W)) * mean
    x[3:, :, 5:15, 10:20] *= 10**-0.7
    x[3, :, 25:32, 40:48] *= 10
    x[5, :, 25:32, 40:48] *= 10
    x[:, :, rng.random((H, W)) < missing / 2] = np.nan
    x[rng.random((N, H, W))[:, None].repeat(2, 1) < missing] = np.nan
    return x


@pytest.fixture(scope="module")
def data(spark):
    import pandas as pd

    x = archive()
    i, r, c = np.nonzero(np.isfinite(x[:, 0]))
    pdf = pd.DataFrame({"pass_idx": i.astype(np.int32), "row": r.astype(np.int32), "col": c.astype(np.int32), "vv": x[i, 0, r, c], "vh": x[i, 1, r, c]})
    return x, spark.createDataFrame(pdf).repartition(3)


def window_sum(a, k):
    m = k // 2
    p = np.pad(a, m)
    return sum(p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(k) for j in range(k))


def model(x, first, second, k, looks):
    ok, means, counts = np.ones((H, W), bool), [], []
    for side in (first, second):
        seen = np.isfinite(x[side, 0])
        n = window_sum(seen.sum(0).astype(float), k)
        counts.append(n / k**2)
        means.append([window_sum(np.nan_to_num(x[side, b]).sum(0), k) / np.maximum(n, 1e-9) for b in range(2)])
        ok &= seen.sum(0) > 0
    l1, l2 = counts[0] * looks, counts[1] * looks
    q = 0
    with np.errstate(all="ignore"):
        for a, b in zip(*means):
            p = (l1 * a + l2 * b) / (l1 + l2)
            q = q + np.maximum(2 * ((l1 + l2) * np.log(p) - l1 * np.log(a) - l2 * np.log(b)) / (1 + (1 / l1 + 1 / l2 - 1 / (l1 + l2)) / 6), 0)
        db = 10 * np.log10(sum(means[1]) / sum(means[0]))
    return ok, q, db


def as_array(df, column, fill):
    out = np.full((H, W), fill)
    for r in df.select("row", "col", column).collect():
        out[r.row, r.col] = r[column]
    return out


@pytest.mark.parametrize("k", [1, 3, 5])
def test_change_and_null_equal_the_model(data, k):
    x, obs = data
    got = change.pixel_change(obs, NB, LOOKS * k * k, k, H, W)
    for name, first, second in (("change", [0, 1, 2], [3, 4, 5]), ("null", [0, 2], [1])):
        ok, q, db = model(x, first, second, k, LOOKS * k * k)
        signed = np.where(ok, np.rint(np.minimum(q, 320) * 100 * np.where(db > 0, 1, -1)), -32768)
        assert np.abs(as_array(got[name], "signed", -32768) - signed).max() <= 1
        assert np.abs(as_array(got[name], "change_db", -32768) - np.where(ok, np.rint(np.clip(db, -300, 300) * 100), -32768)).max() <= 1


def test_events_equal_the_model(data):
    x, obs = data
    got = as_array(change.pixel_events(obs, NB, LOOKS * 9, 3, H, W), "events", 0)
    want = np.zeros((H, W), int)
    both = np.isfinite(x[:NB, 0]).any(0) & np.isfinite(x[NB:, 0]).any(0)
    for i in range(N - 1):
        ok, q, db = model(x, [i], [i + 1], 3, LOOKS * 9)
        want |= (ok & both & (q > stats.chi2_threshold(1e-3, 2)) & (np.abs(db) >= 2)).astype(int) << i
    assert (got == want).all() and want.any()


def components_of(mask):
    label, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask)):
        if not label[start]:
            n += 1
            stack = [start]
            label[start] = n
            while stack:
                r, c = stack.pop()
                for i in range(max(0, r - 1), min(mask.shape[0], r + 2)):
                    for j in range(max(0, c - 1), min(mask.shape[1], c + 2)):
                        if mask[i, j] and not label[i, j]:
                            label[i, j] = n
                            stack.append((i, j))
    return label


@pytest.mark.parametrize("kind", ["sparse", "dense", "snake", "empty"])
def test_patches_equal_flood_fill(spark, kind):
    rng = np.random.default_rng(5)
    mask = {"sparse": rng.random((30, 150)) < 0.2, "dense": rng.random((30, 150)) < 0.45, "empty": np.zeros((3, 3), bool), "snake": np.zeros((30, 150), bool)}[kind]
    if kind == "snake":
        mask[::2] = True
        mask[1::4, -1], mask[3::4, 0] = True, True
    rows = [(int(r), int(c)) for r, c in zip(*np.nonzero(mask))]
    got = components.label(spark.createDataFrame(rows, "row int, col int")).collect()
    want = components_of(mask)
    assert len(got) == len(rows)
    pairs = {(int(want[r.row, r.col]), r.label) for r in got}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert [b for _, b in sorted(pairs)] == sorted(b for _, b in pairs)  # names in raster order


def test_patches_across_tiles(spark, monkeypatch):
    rng = np.random.default_rng(12)
    mask = rng.random((40, 50)) < 0.42
    points = [(int(r), int(c)) for r, c in zip(*np.nonzero(mask))]
    want, left = {}, set(points)
    for p in sorted(points):  # raster order, so each patch is named by its first pixel
        if p in left:
            left.remove(p)
            todo = [p]
            while todo:
                r, c = todo.pop()
                want[r, c] = (p[0] << 32) + p[1]
                near = {(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
                left -= near
                todo += near
    for side in (7, 16, 1024):
        monkeypatch.setattr(components, "TILE", side)
        got = {(r.row, r.col): r.label for r in components.label(spark.createDataFrame(points, "row int, col int").repartition(3)).collect()}
        assert got == want


def test_edges_equal_the_model(spark):
    mask = np.random.default_rng(6).random((20, 20)) < 0.7
    pad = np.pad(mask, 1)
    want = mask & ~(pad[:-2, 1:-1] & pad[2:, 1:-1] & pad[1:-1, :-2] & pad[1:-1, 2:])
    rows = [(int(r), int(c)) for r, c in zip(*np.nonzero(mask))]
    got = neighbourhood.edges(spark.createDataFrame(rows, "row int, col int"), 20, 20).collect()
    assert {(r.row, r.col) for r in got} == set(zip(*map(list, np.nonzero(want))))


@pytest.fixture(scope="module")
def result(spark, data, tmp_path_factory):
    store = Store(spark, f"file://{tmp_path_factory.mktemp('store')}")
    params = analysis.Params("Field <1>", (30.2, 50.5, 30.26, 50.54), "2026-07-04", "2026-08-04", looks=LOOKS * 9)
    return store, params, analysis.run(data[1], params, DAYS, NB, GRID, store)


def test_planted_changes_are_found(result):
    found = analysis.report(result[2])
    spots = detect.largest_first(found["spots"]).collect()
    assert len(spots) == 2
    patch, busy = spots
    assert patch.direction == "decrease" and patch.change_db == pytest.approx(-7, abs=0.8) and patch.times_changed == 1 and list(patch.when) == ["4 Jul 2026 → 22 Jul 2026"]
    assert busy.direction == "increase" and busy.times_changed == 3
    row = found["summary"].first()
    assert row.spots == 2 and row.noise_spots == 0 and row.noise_km2 == 0 and row.decrease_km2 == pytest.approx(patch.area_m2 / 1e6, rel=0.1)
    strict = analysis.report(result[2], detect.PRESETS["Strict"])["flagged"].count()
    assert strict <= found["flagged"].count() <= analysis.report(result[2], detect.PRESETS["Sensitive"])["flagged"].count()


def test_results_are_stored_and_versioned(result, data, monkeypatch):
    store, params, first = result
    again = analysis.run(data[1].limit(0), params, [], 0, GRID, store)  # nothing is computed
    assert sorted(map(tuple, again.pixel_change.collect())) == sorted(map(tuple, first.pixel_change.collect())) and again.pass_days == DAYS
    assert [r.label for r in store.saved().collect()] == ["Field <1>"]
    import chronoscape.storage as storage

    monkeypatch.setattr(storage, "VERSION", 2)
    assert store.saved().count() == 0 and not store.has(params)


def test_exports(result, tmp_path):
    found = analysis.report(result[2])
    detect.write_csv(found["spots"], f"file://{tmp_path}/csv")
    lines = next(tmp_path.glob("csv/part-*.txt")).read_text().splitlines()
    assert lines[0] == detect.HEADER and len(lines) == 3 and lines[1].endswith('"4 Jul 2026 → 22 Jul 2026"')
    page = present.html_map("Field <1>", found["spots"], GRID)
    assert "Field &lt;1&gt;" in page and page.count('"times"') == 2
    assert present.overlay_png(found["flagged"], GRID).startswith(b"\x89PNG")
    places = present.place_labels(found["spots"], 20, 30)
    assert places.count() == 2 and present.place_labels(found["spots"], 0.01, 30).count() == 1
    text = present.legend("A", "a", "b", "Balanced", detect.Detection(), 2, 1.0, 1400)
    assert text["scale"] == "250 m" and text["spots"] == "2 changed spots" and "1 in 100,000" in text["detection"]


def test_overview_levels(data):
    got = change.overview(change.pixel_change(data[1], NB, LOOKS * 9, 3, H, W)["change"]).collect()
    assert len(got) == 150 and all(1 <= r.before <= 255 for r in got)


def test_looks_are_measured(data):
    x, obs = data
    got = change.measure_looks(obs.where(F.col("pass_idx") < NB), 1, H, W)
    assert got == pytest.approx(LOOKS, rel=0.15)
    assert change.measure_looks(obs.where("pass_idx = 0"), 1, H, W) is None


def test_no_data_and_single_pass(spark, data):
    params = analysis.Params("x", (30.2, 50.5, 30.26, 50.54), "2026-07-04", "2026-08-04", looks=5.0)
    with pytest.raises(ValueError):
        analysis.run(data[1].limit(0), params, DAYS, NB, GRID)
    assert "null" not in change.pixel_change(data[1], 1, 5.0, 1, H, W)
    empty = data[1].limit(0)
    assert change.pixel_events(empty, NB, 5.0, 3, H, W).count() == 0


def test_request_checks():
    today = dt.date(2026, 8, 10)
    good = analysis.Params("x", (30.2, 50.5, 30.26, 50.54), "2026-07-04", "2026-08-04")
    assert analysis.problems(good, today) == []
    from dataclasses import replace

    for bad in (replace(good, start="2026-08-05"), replace(good, end="2027-01-01"), replace(good, start="2014-01-01"), replace(good, bands=()), replace(good, bounds=(1, 1, 0, 0)), replace(good, images=21), replace(good, bounds=(0, 0, 20, 20))):
        assert analysis.problems(bad, today)


def test_streamed_passes(spark, data):
    obs = data[1].where("row < 4")
    got = {(r.pass_idx, r.row, r.col): r.step_db for r in passes.replay(obs, N).collect()}
    x = np.nansum(data[0], 1)
    want = {(i, r, c): round(1000 * math.log10(x[i + 1, r, c] / x[i, r, c])) for i in range(N - 1) for r in range(4) for c in range(W) if x[i, r, c] > 0 and x[i + 1, r, c] > 0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1 for k in want)


def test_replayed_passes_are_worked_out_once(spark):
    """Passes in several files each: every pixel's passes still come in order, and obs is not worked out for each pass."""
    n_passes, side = 5, 70
    worked_out = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            worked_out.add(len(batch))
            yield batch.assign(vv=10.0 ** (batch["pass_idx"] * batch["col"] % 7), vh=0.0)

    cells = spark.range(n_passes * side * side, numPartitions=7).selectExpr(f"int(id % {n_passes}) AS pass_idx", f"int(id / {n_passes * side}) AS row", f"int(id / {n_passes} % {side}) AS col").where("(row + col + pass_idx) % 11 > 0")
    obs = cells.mapInPandas(counted, "pass_idx int, row int, col int, vv double, vh double")
    got = {(r.pass_idx, r.row, r.col): r.step_db for r in passes.replay(obs, n_passes).collect()}
    seen = {(r.pass_idx, r.row, r.col) for r in cells.collect()}
    level = lambda p, c: p * c % 7
    assert got == {(p, r, c): 1000 * (level(p + 1, c) - level(p, c)) for p, r, c in seen if (p + 1, r, c) in seen}
    assert worked_out.value == len(seen)
