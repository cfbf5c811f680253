"""The change test: sums per side, comparison, pass-to-pass events, the no-change check and the overview.

`obs` is (pass_idx, row, col, vv, vh): one row per pass and pixel, absent where there is no data. `passes` is
(pass_idx, side, grp) with grp 0 and 1 for even and odd passes before and 2 for those after; a few dozen rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from .neighbourhood import window_sums


def number_passes(days_before: list, days_after: list) -> list[tuple]:
    """Rows pass_idx, day, side, grp of the selected days, oldest first."""
    before = [(i, d, "before", i % 2) for i, d in enumerate(sorted(days_before))]
    return before + [(len(before) + i, d, "after", 2) for i, d in enumerate(sorted(days_after))]


def group_sums(obs: DataFrame, n_before: int, bands: tuple[str, ...]) -> DataFrame:
    """row, col and for each group g the sums {band}_{g} and the number of passes n_{g}, from one aggregation."""
    grp = F.when(F.col("pass_idx") >= n_before, 2).otherwise(F.col("pass_idx") % 2)
    tagged = obs.withColumn("_g", grp)
    sums = [F.sum(F.when(F.col("_g") == g, F.col(b)).otherwise(0.0)).alias(f"{b}_{g}") for g in range(3) for b in bands]
    return tagged.groupBy("row", "col").agg(*sums, *[F.sum((F.col("_g") == g).cast("int")).alias(f"n_{g}") for g in range(3)])


def smoothed(sums: DataFrame, size: int, height: int, width: int, bands: tuple[str, ...]) -> DataFrame:
    """The sums over windows, n_{g} likewise, and own_{g}: the pixel's own number of passes.

    The window mean is linear, so passes are added up before the windows are: one neighbour shuffle whatever the
    number of passes.
    """
    counts = [f"n_{g}" for g in range(3)]
    got = window_sums(sums, [f"{b}_{g}" for g in range(3) for b in bands] + counts, size, height, width, own=counts)
    return got.drop("centre").withColumnsRenamed({f"own_n_{g}": f"own_{g}" for g in range(3)})


def compare(side: DataFrame, first: tuple[int, ...], second: tuple[int, ...], looks: float, size: int, bands: tuple[str, ...]) -> DataFrame:
    """row, col, signed, change_db for pixels seen in both unions of groups, and the means before and after."""
    add = lambda name, groups: sum((F.col(f"{name}_{g}") for g in groups[1:]), F.col(f"{name}_{groups[0]}"))
    n1, n2 = add("n", first), add("n", second)
    scale = looks / (size * size)
    seen = side.where((add("own", first) > 0) & (add("own", second) > 0))
    means = {f"{b}_before": add(b, first) / n1 for b in bands} | {f"{b}_after": add(b, second) / n2 for b in bands}
    seen = seen.withColumns({**means, "_l1": n1 * scale, "_l2": n2 * scale})
    stat = sum((stats.likelihood_ratio(F.col(f"{b}_before"), F.col(f"{b}_after"), F.col("_l1"), F.col("_l2")) for b in bands[1:]), stats.likelihood_ratio(F.col(f"{bands[0]}_before"), F.col(f"{bands[0]}_after"), F.col("_l1"), F.col("_l2")))
    span = lambda when: sum((F.col(f"{b}_{when}") for b in bands[1:]), F.col(f"{bands[0]}_{when}"))
    db = stats.decibels(span("before"), span("after"))
    return seen.withColumns({"_stat": stat, "_db": db}).select("row", "col", stats.encode_statistic(F.col("_stat"), F.col("_db")).alias("signed"), stats.encode_db(F.col("_db")).alias("change_db"), *means)


def pixel_change(obs: DataFrame, n_before: int, looks: float, size: int, height: int, width: int, bands=("vv", "vh"), keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """'change' (before and after) and, with two passes before, 'null' (even and odd before): results of `compare`.

    Both come from the same window sums; keep them (written, say) where both are wanted.
    """
    side = keep(smoothed(group_sums(obs, n_before, bands), size, height, width, bands))
    found = {"change": compare(side, (0, 1), (2,), looks, size, bands)}
    if n_before >= 2:
        found["null"] = compare(side, (0,), (1,), looks, size, bands)
    return found


def pixel_events(obs: DataFrame, n_before: int, looks: float, size: int, height: int, width: int, bands=("vv", "vh"), alpha: float = stats.PASS_ALPHA, min_db: float = stats.PASS_MIN_DB) -> DataFrame:
    """row, col, events: bit i is set where pass i + 1 clearly differs from pass i; only pixels seen on both sides.

    Only neighbours in the list of passes are compared, and only where the pixel itself was seen in both.
    """
    each = window_sums(obs.withColumn("n", F.lit(1)), [*bands, "n"], size, height, width, ["pass_idx"]).drop("centre")
    later = each.select((F.col("pass_idx") - 1).alias("pass_idx"), "row", "col", *[F.col(c).alias(f"{c}_next") for c in (*bands, "n")])
    pairs = each.join(later, ["pass_idx", "row", "col"])
    scale = looks / (size * size)
    test = None
    for b in bands:
        one = stats.likelihood_ratio(F.col(b) / F.col("n"), F.col(f"{b}_next") / F.col("n_next"), F.col("n") * scale, F.col("n_next") * scale)
        test = one if test is None else test + one
    span = lambda end: sum((F.col(f"{b}{end}") / F.col(f"n{end}") for b in bands[1:]), F.col(f"{bands[0]}{end}") / F.col(f"n{end}"))
    clear = (test > stats.chi2_threshold(alpha, len(bands))) & (F.abs(stats.decibels(span(""), span("_next"))) >= min_db)
    bits = pairs.where(clear).groupBy("row", "col").agg(F.bit_or(F.expr("shiftleft(1L, pass_idx)")).alias("events"))
    seen = obs.groupBy("row", "col").agg(F.max((F.col("pass_idx") < n_before).cast("int")).alias("b"), F.max((F.col("pass_idx") >= n_before).cast("int")).alias("a")).where("a + b = 2")
    return bits.join(seen.select("row", "col"), ["row", "col"], "left_semi")


def overview(change: DataFrame, factor: int = 4, band: str = "vv") -> DataFrame:
    """block_row, block_col, before, after: block means from -25 dB to 0 dB as 1 to 255."""
    def level(mean):
        db = F.log10(mean) * 10
        return (F.rint((F.greatest(F.least(db, F.lit(0.0)), F.lit(-25.0)) + 25) / 25 * 254) + 1).cast("smallint")

    block = [F.floor(F.col(c) / factor).cast("int").alias(f"block_{c}") for c in ("row", "col")]
    means = change.groupBy(*block).agg(F.avg(f"{band}_before").alias("b"), F.avg(f"{band}_after").alias("a"))
    return means.select("block_row", "block_col", level(F.col("b")).alias("before"), level(F.col("a")).alias("after"))


def log_ratios(obs: DataFrame, size: int, height: int, width: int, bands=("vv", "vh"), last: int = 4) -> DataFrame:
    """log_ratio of neighbouring passes, bands stacked, where the whole window was seen in both; obs: passes before.

    Of the passes the `last` latest count; windows that reach over the edge of the grid are left out.
    """
    latest = obs.agg(F.max("pass_idx")).first()[0]
    if latest is None:
        return obs.sparkSession.createDataFrame([], "log_ratio double")
    recent = obs.where(F.col("pass_idx") > latest - last)
    each = window_sums(recent.withColumn("n", F.lit(1)), [*bands, "n"], size, height, width, ["pass_idx"]).where(F.col("n") == size * size)
    later = each.select((F.col("pass_idx") - 1).alias("pass_idx"), "row", "col", *[F.col(b).alias(f"{b}_next") for b in bands])
    pairs = each.join(later, ["pass_idx", "row", "col"])
    return pairs.select(F.explode(F.array(*[F.ln(F.col(b) / F.col(f"{b}_next")) for b in bands])).alias("log_ratio"))


def sample_windows(height: int, width: int, size: int = 256) -> list[tuple[int, int, int, int]]:
    """(row, col, height, width) of the up to four windows in which looks are measured."""
    side = min(size, height, width)
    starts = lambda n: {max(0, int(f * n) - side // 2) for f in (0.3, 0.7)}
    return sorted((r, c, min(side, height - r), min(side, width - c)) for r in starts(height) for c in starts(width))


def measure_looks(obs_before: DataFrame, size: int, height: int, width: int, bands=("vv", "vh"), least: int = 1000) -> float | None:
    """Looks of a single smoothed pass, measured on unchanged ground; None where there are too few samples."""
    samples = None
    for r, c, h, w in sample_windows(height, width):
        cut = obs_before.where(F.col("row").between(r, r + h - 1) & F.col("col").between(c, c + w - 1)).withColumns({"row": F.col("row") - r, "col": F.col("col") - c})
        got = log_ratios(cut, size, h, w, bands)
        samples = got if samples is None else samples.unionByName(got)
    row = stats.quartiles(samples).first()
    return stats.looks_from_iqr(row.q75 - row.q25) if row.n >= least else None
