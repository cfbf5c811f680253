"""Statistics of speckled intensities: the change test as column expressions, its thresholds and the looks estimate."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import drop_table, materialize

# Storage scale, cap and no-data code of the statistic; nominal looks; single-pass thresholds.
SCALE, CAP, NODATA = 100, 320, -32768
DB_CAP = 300
NOMINAL_LOOKS = 4.4
PASS_ALPHA, PASS_MIN_DB = 1e-3, 2.0


def likelihood_ratio(mean1: Column, mean2: Column, looks1: Column, looks2: Column) -> Column:
    """-2 log of the likelihood ratio for equal means of two gamma samples, Bartlett-corrected, never negative."""
    looks = looks1 + looks2
    pooled = (looks1 * mean1 + looks2 * mean2) / looks
    raw = (looks * F.ln(pooled) - looks1 * F.ln(mean1) - looks2 * F.ln(mean2)) * 2
    factor = ((F.lit(1.0) / looks1 + F.lit(1.0) / looks2 - F.lit(1.0) / looks) / 6) + 1
    return F.greatest(raw / factor, F.lit(0.0))


def decibels(before: Column, after: Column) -> Column:
    return F.log10(after / before) * 10


def rounded(x: Column, places: int) -> Column:
    """Half away from zero, as SQL engines round doubles: of the product with a power of ten, and not, as Spark does, of
    the shortest decimal number that reads back as x. The two may part where x lies halfway."""
    scaled = F.abs(x) * 10.0**places
    whole = F.floor(scaled)
    return F.signum(x) * (whole + F.when(scaled - whole >= 0.5, 1).otherwise(0)) / 10.0**places


def encode_statistic(stat: Column, change_db: Column) -> Column:
    """Hundredths, capped, negative unless the signal rose; rounded half to even."""
    sign = F.when(change_db > 0, F.lit(1)).otherwise(F.lit(-1))
    return F.rint(F.least(stat, F.lit(float(CAP))) * SCALE * sign).cast("smallint")


def encode_db(change_db: Column) -> Column:
    return F.rint(F.greatest(F.least(change_db, F.lit(float(DB_CAP))), F.lit(-float(DB_CAP))) * SCALE).cast("smallint")


def decode(signed: Column) -> tuple[Column, Column, Column]:
    """(statistic, increased, valid) of the stored number."""
    return F.abs(signed.cast("int")) / float(SCALE), signed > 0, signed != NODATA


def chi2_threshold(alpha: float, dof: int) -> float:
    """Upper chi-square quantile for one or two bands."""
    if not 0 < alpha < 1:
        raise ValueError(f"alpha must lie between 0 and 1: {alpha}")
    if dof == 2:
        return -2 * math.log(alpha)
    if dof == 1:
        return NormalDist().inv_cdf(alpha / 2) ** 2
    raise ValueError(f"one or two bands, not {dof}")


def _beta_upper(x: float, a: float) -> float:
    """Regularised incomplete beta function I_x(a, a), by its continued fraction (x <= 1/2 mirrored)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > 0.5:
        return 1 - _beta_upper(1 - x, a)
    front = math.exp(math.lgamma(2 * a) - 2 * math.lgamma(a) + a * math.log(x) + a * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - 2 * a * x / (a + 1), tiny)
    f = d
    for m in range(1, 2000):
        for num in (m * (a - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (2 * a + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def log_ratio_iqr(looks: float) -> float:
    """Interquartile range of the log ratio of two unchanged single looks averages: twice the log of an F quantile.

    F(2L, 2L) = B / (1 - B) with B ~ Beta(L, L), whose upper quartile is found by bisection on the logit.
    """
    lo, hi = 0.0, 60.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _beta_upper(1 / (1 + math.exp(-mid)), looks) < 0.75 else (lo, mid)
    return lo + hi


def looks_from_iqr(iqr: float, least: float = 0.5, most: float = 200.0) -> float:
    """Number of looks whose log ratios scatter as observed; kept within bounds."""
    if iqr >= log_ratio_iqr(least):
        return least
    if iqr <= log_ratio_iqr(most):
        return most
    for _ in range(100):
        mid = (least + most) / 2
        least, most = (mid, most) if log_ratio_iqr(mid) > iqr else (least, mid)
    return (least + most) / 2


def order_values(samples: DataFrame, column: str, ranks: list[int], bins: int = 1 << 12, few: int = 1 << 14) -> list[float]:
    """The values at the given places (from 0) of the samples in order, exactly, without a sort.

    Each round counts the values of an interval in `bins` equal parts and goes on with the parts that hold a wanted
    place, until at most `few` values are left there, which are looked at as they are. What reaches the driver is
    counts and those few; samples should be a written table, as it is read once a round."""
    x, found = F.col(column), {}
    ends = samples.agg(F.min(x).alias("low"), F.max(x).alias("high")).first()
    open_ = [(ends.low, ends.high, 0, sorted(set(ranks)))]  # the interval, the number of values below it, its places
    while open_:
        flat = [o for o in open_ if o[0] == o[1]]
        found |= {r: low for low, _, _, own in flat for r in own}
        open_ = [o for o in open_ if o[0] != o[1]]
        parts = None
        for k, (low, high, _, _) in enumerate(open_):
            at = F.least(F.floor((x / 2 - low / 2) / (high / 2 - low / 2) * bins), F.lit(bins - 1)).cast("int")  # halves: no overflow
            one = samples.where(x.between(low, high)).groupBy(F.lit(k).alias("k"), at.alias("part")).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))
            parts = one if parts is None else parts.unionByName(one)
        rows = sorted(parts.collect(), key=lambda r: (r.k, r.part)) if parts is not None else []
        following = []
        for k, (_, _, below, own) in enumerate(open_):
            for r in (r for r in rows if r.k == k):
                inside = [p for p in own if below <= p < below + r.n]
                if inside and r.n <= few and r.low != r.high:
                    values = sorted(v[0] for v in samples.where(x.between(r.low, r.high)).select(x).collect())
                    found |= {p: values[p - below] for p in inside}
                elif inside:
                    following.append((r.low, r.high, below, inside))
                below += r.n
        open_ = following
    return [found[r] for r in ranks]


def quartiles(samples: DataFrame, column: str = "log_ratio") -> DataFrame:
    """n, q25, q75 (exact, interpolated) of the finite values; null quartiles where there are none."""
    x = F.col(column).cast("double")
    finite = materialize(samples.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))).select(x.alias("x")), "samples")
    n = finite.count()
    row: tuple = (n, None, None)
    if n:
        # between two neighbours: rank (n - 1) p lies a share of the way from one to the next
        exact = [(n - 1) * p for p in (0.25, 0.75)]
        low, high = [math.floor(p) for p in exact], [math.ceil(p) for p in exact]
        v = dict(zip(low + high, order_values(finite, "x", low + high)))
        row = (n, *[v[a] if v[a] == v[b] else (b - p) * v[a] + (p - a) * v[b] for p, a, b in zip(exact, low, high)])
    drop_table(finite)
    return samples.sparkSession.createDataFrame([row], "n long, q25 double, q75 double")


def estimate_looks(samples: DataFrame, column: str = "log_ratio", least_samples: int = 100) -> float:
    row = quartiles(samples, column).first()
    if row.n < least_samples:
        raise ValueError(f"{row.n} samples are too few to estimate looks; {least_samples} are needed")
    return looks_from_iqr(row.q75 - row.q25)
