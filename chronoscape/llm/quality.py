"""Robust multivariate outliers: minimum-covariance-determinant estimates per language and source.

`text_stats` counts words, symbols and repeats in whole texts. `mcd_outliers` turns the counts into a vector of
transformed ratios and fits, for every (language, source) group, the mean and covariance of the h = 75 % of rows with
the least determinant, by concentration steps from a robust start and from random subsets of rows. Rows beyond a
quantile of the squared Mahalanobis distance are outliers. The ratios are ones that vary from text to text; counts that
are zero in most texts (repeated lines and words) have no ellipsoid, and the base rules judge them.

A concentration step is one aggregation: each row's distance under the present estimate is rounded to a bucket
(1/32 of a power of two), and counts, sums and cross products are added up by (group, start, bucket), which combines
on the map side however large a group is. The buckets below the h-quantile are then the next subset. The rows never
meet; only a few hundred sums per group do, and those stay in Spark. A step counts if its determinant is less than the
one before; a start whose determinant no longer falls is done. After two steps the best two starts of a group go on.

Distances are scaled so that their h-quantile is that of chi-square, and the limit is the quantile of the F
distribution for the rows that a group's estimate rests on, so that small groups reject only what is far out. Groups
with fewer than `min_rows` rows (5 for each feature) are pooled by language, those still small are pooled together; a
pool still smaller rejects nothing. Rows that fail the base rules do not enter the estimates.

Defined results: null text has no words and fails the base rules; null language or source is a value of its own;
features that do not vary get a variance just above zero, so equal rows have distance 0; repeated rows each count; an
empty table gives an empty result; other columns are ignored, and `keep_good` passes them through.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize, private, row_key, sized

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
PUNCTUATION = b"!?\"'()+,-./:;=@[\\]^_`{}~"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct")


def repeated_words(w: list[bytes]) -> int:
    """How many words stand in a 3-word window that the text holds twice or more."""
    tri = list(zip(w, w[1:], w[2:], strict=False))
    if len(set(tri)) == len(tri):
        return 0
    count = Counter(tri)
    total, covered = 0, 0  # covered: words before this one are counted already
    for i, t in enumerate(tri):
        if count[t] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def one_text(text: str | None) -> tuple[int, ...]:
    b = (text or "").encode()
    size = lambda cut: len(b) - len(b.translate(None, cut))
    w = b.split()  # bytes split at exactly \x20 and \x09-\x0D
    seen, lines, again = set(), 0, 0
    for line in b.split(b"\n"):
        if line.strip():
            lines += 1
            again += line in seen
            seen.add(line)
    spaces = size(SPACE)
    return len(w), len(text or "") - spaces, size(SYMBOLS), again, repeated_words(w), lines, size(UPPER), size(PUNCTUATION)


def text_stats(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the kept columns and STATS of every whole text."""

    def run(batches):
        for batch in batches:
            cols = list(zip(*map(one_text, batch.column(1).to_pylist()), strict=True)) or [()] * len(STATS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *[pa.array(c, pa.int64()) for c in cols]], names=["doc_id", *keep, *STATS])

    got = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[F.col(c).cast("string") for c in keep])
    return got.mapInArrow(run, ", ".join(["doc_id long", *[f"{c} string" for c in keep], *[f"{c} long" for c in STATS]]))


# The transformed statistics.
FEATURES = (
    "ln(greatest(word_chars, 1) / greatest(n_words, 1d))", "sqrt((n_symbols + n_punct) / greatest(word_chars, 1d))",
    "sqrt(n_upper / greatest(word_chars, 1d))", "ln(greatest(n_words, 1) / greatest(n_lines, 1d))",
)
P = len(FEATURES)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
#: Added to each variance, against singular estimates; a thousandth squared, far below any ratio's own scatter.
RIDGE = 1e-6


def chi2_cdf(x: float, dof: int) -> float:
    """By the series of the lower incomplete gamma function."""
    a, y = dof / 2, x / 2
    if y <= 0:
        return 0.0
    if y > a + 40:
        return 1.0 - 1e-16
    term = total = 1 / a
    n = a
    while term > total * 1e-17:
        n += 1
        term *= y / n
        total += term
    return total * math.exp(-y + a * math.log(y) - math.lgamma(a))


def chi2_quantile(p: float, dof: int) -> float:
    lo, hi = 0.0, 4.0 * dof + 100
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, dof) < p else (lo, mid)
    return (lo + hi) / 2


def _beta_tail(f: float, d1: float, d2: float) -> float:
    """The chance that an F variable with d1 and d2 degrees exceeds f, by the incomplete beta's continued fraction."""

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
        got = d
        for m in range(1, 500):
            for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + step * d or 1e-300), 1 + step / c or 1e-300
                got *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return got

    a, b, x = d2 / 2, d1 / 2, d2 / (d2 + d1 * f)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def distance_limit(rows: float, beyond: float, p: int = P) -> float:
    """What a squared distance from an estimate of so many rows exceeds with the chance `beyond`."""
    free = max(rows - p + 1, 3.0)
    lo, hi = 0.0, 1.0
    while _beta_tail(hi, p, free) > beyond:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _beta_tail(mid, p, free) > beyond else (lo, mid)
    return hi * p * (free + p - 1) / free


def _distance(x: str = "x") -> Column:
    """Squared Mahalanobis distance of the array x under the columns mean and inv (upper triangle, doubled off it)."""
    dev = [F.col(x)[i] - F.col("mean")[i] for i in range(P)]
    total = F.lit(0.0)
    for k, (i, j) in enumerate(PAIRS):
        total = total + F.col("inv")[k] * dev[i] * dev[j]
    return F.greatest(total, F.lit(0.0))


def _invert(n: np.ndarray, sums: np.ndarray, prods: np.ndarray):
    """Mean, inverse (triangle) and log determinant of each row's covariance."""
    mean = sums / n[:, None]
    cov = np.zeros((len(n), P, P))
    for k, (i, j) in enumerate(PAIRS):
        cov[:, i, j] = cov[:, j, i] = prods[:, k] / n - mean[:, i] * mean[:, j]
    cov += RIDGE * np.eye(P)
    inv = np.linalg.inv(cov)
    tri = np.stack([inv[:, i, j] * (1 if i == j else 2) for i, j in PAIRS], 1) if len(n) else np.zeros((0, len(PAIRS)))
    return mean, tri, np.linalg.slogdet(cov)[1] if len(n) else np.zeros(0)


MODEL = "group_key string, init int, mean array<double>, inv array<double>, logdet double"


def _fit(sums: DataFrame) -> DataFrame:
    """Estimates (MODEL) from rows group_key, init, n, s (sums), q (products)."""

    def run(batches):
        for b in batches:
            n = b.column("n").to_numpy(zero_copy_only=False).astype(float)
            s = np.array(b.column("s").to_pylist(), float).reshape(-1, P)
            q = np.array(b.column("q").to_pylist(), float).reshape(-1, len(PAIRS))
            mean, inv, det = _invert(n, s, q)
            yield pa.RecordBatch.from_arrays([b.column("group_key"), b.column("init"), pa.array(mean.tolist(), pa.list_(pa.float64())), pa.array(inv.tolist(), pa.list_(pa.float64())), pa.array(det)], names=["group_key", "init", "mean", "inv", "logdet"])

    return sums.mapInArrow(run, MODEL)


def _bucket(d: Column) -> Column:
    return F.floor(F.log2(d + 1e-9) * 32).cast("int")


def _sums() -> list[Column]:
    x = F.col("x")
    return [F.count("*").alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(P)], *[F.sum(x[i] * x[j]).alias(f"q{k}") for k, (i, j) in enumerate(PAIRS)]]


def _merged() -> list[Column]:
    return [F.sum("n").alias("n"), F.array(*[F.sum(f"s{i}") for i in range(P)]).alias("s"), F.array(*[F.sum(f"q{k}") for k in range(len(PAIRS))]).alias("q")]


def _step(rows: DataFrame, model: DataFrame, h: float) -> DataFrame:
    """One concentration step: the estimates of the h nearest rows under the present ones."""
    cells = rows.join(model, "group_key").groupBy("group_key", "init", _bucket(_distance()).alias("bucket")).agg(*_sums())
    own = Window.partitionBy("group_key", "init")
    cells = cells.withColumn("below", F.coalesce(F.sum("n").over(own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("n").over(own))
    return _fit(cells.where(F.col("below") < h * F.col("all")).groupBy("group_key", "init").agg(*_merged()))


def _starts(rows: DataFrame, random_starts: int) -> DataFrame:
    """MODEL: medians and interquartile ranges without correlation, and estimates of about 5 * P random rows each.

    A row is drawn by the hash of its values, so that a lost task draws the same rows again.
    """
    cells = rows.select("group_key", F.posexplode("x").alias("feature", "v")).groupBy("group_key", "feature", F.floor(F.col("v") * 500).alias("cell")).count()
    own = Window.partitionBy("group_key", "feature")
    upto = (F.sum("count").over(own.orderBy("cell")) / F.sum("count").over(own)).alias("share")
    at = lambda q: F.min(F.when(F.col("share") >= q, (F.col("cell") + 0.5) / 500))
    q = cells.select("group_key", "feature", "cell", upto).groupBy("group_key", "feature").agg(F.array(at(0.25), at(0.5), at(0.75)).alias("q"))
    q = q.groupBy("group_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "q"))), lambda t: t["q"]).alias("q"))  # P values
    inv = F.array(*[1 / (F.pow((F.col("q")[i][2] - F.col("q")[i][0]) / 1.349, F.lit(2.0)) + RIDGE) if i == j else F.lit(0.0) for i, j in PAIRS])
    robust = q.select("group_key", F.lit(0).alias("init"), F.transform("q", lambda t: t[1]).alias("mean"), inv.alias("inv"), F.lit(float("inf")).alias("logdet"))
    draw = F.pmod(F.xxhash64("x", "init"), F.col("rows")) < 5 * P
    drawn = rows.withColumn("init", F.explode(F.array(*map(F.lit, range(1, random_starts + 1))))).where(draw)
    random = _fit(drawn.groupBy("group_key", "init").agg(*_sums()).groupBy("group_key", "init").agg(*_merged()))
    return robust.unionByName(random.withColumn("logdet", F.lit(float("inf"))))


def mcd_outliers(stats: DataFrame, h: float = 0.75, confidence: float = 1 - 1e-7, steps: int = 20, random_starts: int = 4, min_rows: int = 5 * P) -> DataFrame:
    """stats (doc_id, lang, source, base_failed, STATS) with distance (squared, scaled), its limit, and kept."""
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in ("lang", "source"))
    counts = stats.where("not base_failed").groupBy(lang.alias("g_lang"), source.alias("g_source")).agg(F.count("*").alias("n"))
    by_lang = F.sum(F.when(F.col("n") < min_rows, F.col("n")).otherwise(0)).over(Window.partitionBy("g_lang"))
    named = F.when(F.col("n") >= min_rows, F.concat_ws("\x1f", "g_lang", "g_source")).when(by_lang >= min_rows, F.col("g_lang")).otherwise("*")
    groups = materialize(counts.select("g_lang", "g_source", "n", named.alias("group_key")), "quality-groups")
    total = groups.groupBy("group_key").agg(F.sum("n").alias("rows"))
    groups = sized(materialize(groups.join(total, "group_key").select("g_lang", "g_source", "group_key", "rows"), "quality-groups"))
    keyed = stats.withColumns({"g_lang": lang, "g_source": source}).join(groups, ["g_lang", "g_source"], "left").withColumn("x", F.array(*map(F.expr, FEATURES)))
    rows = materialize(keyed.where("not base_failed").select("group_key", "rows", "x"), "quality-rows")

    model = materialize(_starts(rows, random_starts).withColumn("fell", F.lit(True)), "quality-model")
    for turn in range(steps):
        moving = model.where("fell")
        if moving.isEmpty():
            break
        new = _step(rows.drop("rows"), sized(moving.select("group_key", "init", "mean", "inv")), h)
        was = moving.select("group_key", "init", F.struct("mean", "inv", "logdet").alias("was"))
        lower = F.col("logdet") < F.col("was.logdet") - 1e-9
        now = new.join(was, ["group_key", "init"]).select("group_key", "init", *[F.when(lower, F.col(c)).otherwise(F.col(f"was.{c}")).alias(c) for c in ("mean", "inv", "logdet")], lower.alias("fell"))
        now = now.unionByName(model.where("not fell"))
        if turn == 1:
            best = Window.partitionBy("group_key").orderBy("logdet", "init")  # a row for each start
            now = now.withColumn("place", F.row_number().over(best)).where("place <= 2").drop("place")
        before, model = model, materialize(now, "quality-model")
        drop_table(before)
    best = model.groupBy("group_key").agg(F.min_by(F.struct("mean", "inv"), F.struct("logdet", "init")).alias("m")).select("group_key", "m.*")
    best = sized(materialize(best, "quality-best"))

    cells = rows.join(best, "group_key").groupBy("group_key", _bucket(_distance()).alias("bucket")).agg(F.count("*").alias("n"))
    own = Window.partitionBy("group_key")
    share = F.sum("n").over(own.orderBy("bucket")) / F.sum("n").over(own)
    at_h = F.min(F.when(F.col("share") >= h, F.pow(F.lit(2.0), (F.col("bucket") + 0.5) / 32)))
    scale = cells.select("group_key", "bucket", "n", share.alias("share")).groupBy("group_key").agg((at_h / chi2_quantile(h, P)).alias("scale"), F.sum("n").alias("n"))

    def limits(batches):
        for b in batches:
            limit = [distance_limit(h * n, 1 - confidence) if n >= min_rows else math.inf for n in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(limit, pa.float64())], names=["group_key", "scale", "limit"])

    final = best.join(scale.mapInArrow(limits, "group_key string, scale double, `limit` double"), "group_key")
    final = sized(materialize(final, "quality-final"))
    judged = keyed.join(final, "group_key", "left").withColumn("distance", F.coalesce(_distance() / F.greatest("scale", F.lit(1e-12)), F.lit(0.0)))
    drop_table(model, rows)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= F.coalesce("limit", F.lit(math.inf)))).select(*stats.columns, "distance", "limit", "kept")


def quality_rules(docs: DataFrame, **options) -> DataFrame:
    """Stats, base rules and verdict of every row of docs (doc_id, text, lang, source)."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = materialize(text_stats(docs, "lang", "source").withColumn("base_failed", failed), "quality-stats")
    return mcd_outliers(stats, **options)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows that the rules reject; texts are not shuffled while the rejected rows can be broadcast."""
    key = row_key(docs)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    named = docs.select("doc_id", "text", "lang", "source", key.alias("row"))
    stats = materialize(text_stats(named, "lang", "source", "row").withColumn("base_failed", failed), "quality-stats")
    (gone,) = private(docs, "gone")
    rejected = mcd_outliers(stats, **options).where("not kept").select(F.col("row").cast("long").alias(gone)).distinct()
    return docs.join(sized(materialize(rejected, "quality-gone")), key == F.col(gone), "left_anti")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
