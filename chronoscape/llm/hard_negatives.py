"""Hard negatives by a distributed kNN join over Voronoi cells.

Vectors become whole numbers (floor of 256 times a component). A row s gets one more component, sqrt(M^2 - |s|^2) with
the largest norm M, and an anchor q gets zero: all augmented rows have length M, and the nearest of them are those of
the largest inner product. Pivots, fitted on a bounded sample of anchors, divide the space. For an anchor group (the
anchors in cell i, whose pivot is p, all within U of it) the inner product of a row differs from p.s by at most U * M.

* Positives: by label, the few rows next to each cell's pivot give a score that the k-th partner of every anchor of a
  group reaches; rows that cannot reach it are not sent to the group.
* Negatives: rows that cannot fall between the least score wanted by an anchor of the group and its best positive are
  not sent. What is sent is compared exactly, in slices of bounded size, and the slices' best rows are merged.

Bounds hold with equality for ties, so the result is exact; where nothing can be ruled out (directions at random in many
dimensions), every row goes to every group, of which there is one for 64 anchors up to 256 groups, one for 4,096 beyond.

Rows without vec_id, label or vector, or with a null or non-finite component, take no part. Repeated rows are rows of
their own: an anchor that occurs twice is mined twice, and each is the other's partner. Vectors of different lengths are
compared as if the shorter ended in zeros; an empty vector scores 0 with all. Components beyond 2^26 after scaling are
taken as 2^26, so that sums of products stay whole. Empty tables and tables without anchors give no rows. Columns other than those named are not read."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize, sized

LIMIT = 2**26
#: Most pivots, anchors a pivot, anchors the pivots are fitted on, anchors and rows compared at once.
PIVOTS, PER_PIVOT, SAMPLE, ANCHORS, ROWS = 256, 64, 4096, 4096, 8192
#: Room for rounding in bounds of scores.
SLACK = 1e-9


def prepare(vectors: DataFrame, flip: int = 7, classes: int = 10, anchor_every: int = 100, scale: float = 256.0) -> DataFrame:
    """row, vec_id, label, vec, anchor of the rows that take part. Labels of ids divisible by `flip` move on by one."""
    ok = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").dropna().where(ok)
    whole = lambda x: F.least(F.lit(float(LIMIT)), F.greatest(F.lit(-float(LIMIT)), F.floor(x.cast("double") * scale).cast("double"))).cast("long")
    return own.select(
        F.monotonically_increasing_id().alias("row"), "vec_id", F.when(F.col("vec_id") % flip == 0, (F.col("label") + 1) % classes).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", whole).alias("vec"), (F.col("vec_id") % anchor_every == 0).alias("anchor"),
    )


@dataclass
class Space:
    """What every task needs to place a vector: pivots in augmented space and the largest norm."""

    dim: int
    norm: float
    largest: float
    pivots: np.ndarray

    def whole(self, column: pa.Array) -> np.ndarray:
        """Rows of `dim` numbers, filled up with zeros."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        size = np.diff(column.offsets.to_numpy(zero_copy_only=False))
        flat = column.flatten().to_numpy(zero_copy_only=False)
        if len(size) and (size == self.dim).all():
            return flat.reshape(len(size), self.dim)
        out = np.zeros((len(size), self.dim), flat.dtype)
        out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
        return out

    def augment(self, v: np.ndarray, anchor: bool) -> np.ndarray:
        v = v.astype(float)
        rest = np.zeros(len(v)) if anchor else np.sqrt(np.maximum(0, self.norm**2 - (v * v).sum(1)))
        return np.column_stack((v, rest))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance to its pivot."""
        d = (x * x).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * x @ self.pivots.T
        cell = d.argmin(1)
        return cell, np.sqrt(((x - self.pivots[cell]) ** 2).sum(1))

    @property
    def slack(self) -> float:
        return 1 + SLACK * self.norm * self.norm

    @property
    def packed(self) -> str:
        """The narrowest numbers that hold every component."""
        return "<i2" if self.largest < 2**15 else "<i4"

    @property
    def exact(self) -> type:
        """Numbers in which sums of products are exact: doubles (fast) if the sums stay below 2^53."""
        return np.float64 if self.dim * self.largest**2 < 2**53 else np.int64


def fit_space(rows: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE, rounds: int = 5) -> Space | None:
    """Norms and sizes over all rows; pivots by farthest points and a few k-means rounds on at most `sample` anchors, those of the smallest hashes."""
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    most = F.greatest(F.abs(F.array_max("vec")), F.abs(F.array_min("vec")))
    s = rows.agg(F.max(square).alias("square"), F.max(most).alias("most"), F.max(F.size("vec")).alias("dim"), F.sum(F.col("anchor").cast("long")).alias("anchors")).first()
    if not s.anchors or not s.dim:
        return None if not s.anchors else Space(1, 1.0, 1.0, np.zeros((1, 2)))
    space = Space(s.dim, float(s.square) ** 0.5 or 1.0, float(s.most), np.zeros((1, s.dim + 1)))
    few = rows.where("anchor").orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id", "row").limit(sample).select("vec").toArrow().column(0)
    x = space.augment(space.whole(few), anchor=True)
    n = max(1, min(pivots, s.anchors // PER_PIVOT, len(x)))
    at, near = [0], ((x - x[0]) ** 2).sum(1)
    while len(at) < n and near.max() > 0:
        at.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[at[-1]]) ** 2).sum(1))
    space.pivots = x[at]
    for _ in range(rounds):
        cell, _ = space.place(x)
        space.pivots = np.array([x[cell == i].mean(0) if (cell == i).any() else p for i, p in enumerate(space.pivots)])
    return space


def placed(rows: DataFrame, space: Space) -> DataFrame:
    """row, label, anchor, cell and dist of every row; acell and adist of anchors, which are also placed as anchors."""

    def place(batches):
        for b in batches:
            v = space.whole(b.column(3))
            cell, dist = space.place(space.augment(v, False))
            acell, adist = space.place(space.augment(v, True))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(cell, pa.int32()), pa.array(dist), pa.array(acell, pa.int32()), pa.array(adist)], names=["row", "label", "anchor", "cell", "dist", "acell", "adist"])

    return rows.select("row", "label", "anchor", "vec").mapInArrow(place, "row long, label long, anchor boolean, cell int, dist double, acell int, adist double")


def reach_by_label(cells: DataFrame, space: Space, k: int) -> DataFrame:
    """label, n rows, and by cell (as float64 and int32 numbers): the least p.s of rows that may be among the k best of
    an anchor of that label there (infinite without anchors), and into how many parts its anchors are dealt.

    A label's group is at most k + 1 rows a cell and one row a cell of anchors, so it is bounded by the number of pivots."""
    first = F.row_number().over(Window.partitionBy("label", "cell").orderBy("dist"))
    near = cells.select("label", "cell", "dist", first.alias("place")).where(F.col("place") <= k + 1).groupBy("label", "cell").agg(F.sort_array(F.collect_list("dist")).alias("dists"))
    n = cells.groupBy("label").agg(F.count("*").alias("n"))
    own = cells.where("anchor").groupBy("label", "acell").agg(F.max("adist").alias("far"), F.count("*").alias("anchors"))
    stats = near.select("label", "cell", "dists", F.lit(None).cast("double").alias("far"), F.lit(None).cast("long").alias("anchors"))
    stats = stats.unionByName(own.select("label", F.col("acell").alias("cell"), F.lit(None).cast("array<double>").alias("dists"), "far", "anchors"))
    pivots, inner = space.pivots, space.pivots @ space.pivots.T

    def bound(table):
        label, least, parts = table.column("label")[0].as_py(), np.full(len(pivots), np.inf), np.ones(len(pivots), np.int32)
        near = [(c, d) for c, ds in zip(table.column("cell").to_pylist(), table.column("dists").to_pylist()) if ds for d in ds]
        cell, dist = np.array([c for c, _ in near], int), np.array([d for _, d in near])
        for c, far, anchors in zip(table.column("cell").to_pylist(), table.column("far").to_pylist(), table.column("anchors").to_pylist()):
            if far is not None:
                parts[c] = -(-anchors // ANCHORS)
                sure = inner[c, cell] - np.sqrt(inner[c, c]) * dist - far * space.norm  # what each of these rows scores at least, with any anchor of the group
                best = np.sort(sure)[::-1][k] if len(sure) > k else -np.inf  # the k-th besides the anchor itself
                least[c] = best - far * space.norm - space.slack
        return pa.table({"label": [label], "least": [least.astype("<f8").tobytes()], "parts": [parts.astype("<i4").tobytes()]})

    return stats.groupBy("label").applyInArrow(bound, "label long, least binary, parts binary").join(n, "label")


PIECE = "label long, cell int, part int, slice int, row long, vec_id long, own long, vec binary"


def _pieces(label, cell, part, piece, row, vec_id, own, vec) -> pa.RecordBatch:
    arrays = [pa.array(label, pa.int64()), pa.array(cell, pa.int32()), pa.array(part, pa.int32()), pa.array(piece, pa.int32()), pa.array(row, pa.int64()), pa.array(vec_id, pa.int64()), pa.array(own, pa.int64())]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([v.tobytes() for v in vec], pa.binary())], names=["label", "cell", "part", "slice", "row", "vec_id", "own", "vec"])


def _deal(row: np.ndarray, n: np.ndarray, seed: int) -> np.ndarray:
    """A number below n for each row, spread evenly."""
    x = (row.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(33)) % n.astype(np.uint64)).astype(np.int64)


def _spread(i: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of i as often as count says, with the numbers from 0 below count."""
    at = np.repeat(np.arange(len(i)), count)
    return i[at], np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)


def _matrix(column: pa.ChunkedArray, space: Space) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), space.packed).reshape(-1, space.dim).astype(space.exact)


def positives(rows: DataFrame, reach: DataFrame, space: Space, k: int) -> DataFrame:
    """row, anchor_id, label, positive, positive_id, positive_score, place of each anchor's k best other rows of its label."""
    met = rows.join(sized(reach), "label")  # labels without rows here have no anchors
    one = ["row", "vec_id", "label", "vec", "anchor", "least", "parts", "n"]

    def send(batches):
        for b in batches:
            v, label, row, vec_id = space.whole(b.column(3)), b.column(2).to_numpy(), b.column(0).to_numpy(), b.column(1).to_numpy()
            least = np.frombuffer(b"".join(b.column(5).to_pylist()), "<f8").reshape(len(v), -1)
            parts = np.frombuffer(b"".join(b.column(6).to_pylist()), "<i4").reshape(len(v), -1)
            slices = -(-b.column(7).to_numpy() // ROWS)
            i, cell = np.nonzero(space.augment(v, False) @ space.pivots.T >= least)
            at, part = _spread(np.arange(len(i)), parts[i, cell])
            i, cell, packed = i[at], cell[at], v.astype(space.packed)
            yield _pieces(label[i], cell, part, _deal(row[i], slices[i], 1), row[i], vec_id[i], label[i], packed[i])

    def ask(batches):
        for b in batches:
            v, label, row, vec_id = space.whole(b.column(3)), b.column(2).to_numpy(), b.column(0).to_numpy(), b.column(1).to_numpy()
            parts = np.frombuffer(b"".join(b.column(6).to_pylist()), "<i4").reshape(len(v), -1)
            cell = space.place(space.augment(v, True))[0]
            part = _deal(row, parts[np.arange(len(v)), cell], 2)
            i, piece = _spread(np.arange(len(v)), -(-b.column(7).to_numpy() // ROWS))
            yield _pieces(label[i], cell[i], part[i], piece, row[i], vec_id[i], label[i], v.astype(space.packed)[i])

    def best(anchors, others):
        if not anchors.num_rows or not others.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("row", "anchor_id", "label", "positive", "positive_id", "positive_score")})
        q, s = _matrix(anchors.column("vec"), space), _matrix(others.column("vec"), space)
        row, ids = others.column("row").to_numpy(), others.column("vec_id").to_numpy()
        order = np.lexsort((row, ids))  # the order of ties
        s, row, ids, own, found = s[order], row[order], ids[order], anchors.column("row").to_numpy(), []
        for a in range(0, len(q), 256):
            score = q[a : a + 256] @ s.T
            for j, line in enumerate(score):
                keep = min(k + 1, len(line))
                floor = np.partition(line, -keep)[-keep]
                i = np.flatnonzero(line >= floor)
                i = i[row[i] != own[a + j]]
                i = i[np.argsort(-line[i], kind="stable")[:k]]
                found.append((np.full(len(i), a + j), i, line[i].astype(np.int64)))
        a, i, score = (np.concatenate(x).astype(np.int64) for x in zip(*found))
        take = lambda name: anchors.column(name).to_numpy()[a]
        return pa.table({"row": own[a], "anchor_id": take("vec_id"), "label": take("own"), "positive": row[i], "positive_id": ids[i], "positive_score": score})

    key = ["label", "cell", "part", "slice"]
    sent, asked = met.select(one).mapInArrow(send, PIECE), met.where("anchor").select(one).mapInArrow(ask, PIECE)
    found = asked.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(best, "row long, anchor_id long, label long, positive long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id", "positive"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def negatives(rows: DataFrame, wanted: DataFrame, space: Space, k: int, low: int, n_rows: int) -> DataFrame:
    """The k best rows of other labels for each anchor and positive, with scores from low / 100 of the positive's up to it.

    wanted: row, label, acell, adist, parts and pairs (an array of at most a few (place, positive_id, positive_score)) of anchors."""
    least, most = F.array_min("pairs.positive_score"), F.array_max("pairs.positive_score")
    bounds = wanted.groupBy("acell").agg(F.min(low * least / 100).alias("least"), F.max(most).alias("most"), F.max("adist").alias("far"), F.count("*").alias("n")).collect()  # at most a row a pivot
    lowest, highest, parts = np.full(len(space.pivots), np.inf), np.full(len(space.pivots), -np.inf), np.ones(len(space.pivots), np.int64)
    for b in bounds:
        room = b.far * space.norm + space.slack
        lowest[b.acell], highest[b.acell], parts[b.acell] = b.least - room, b.most + room, -(-b.n // ANCHORS)
    slices = max(1, -(-n_rows // ROWS))

    def send(batches):
        for b in batches:
            v, row, vec_id, label = space.whole(b.column(3)), b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()
            score = space.augment(v, False) @ space.pivots.T
            i, cell = np.nonzero((score >= lowest) & (score <= highest))
            at, part = _spread(np.arange(len(i)), parts[cell])
            i, cell, packed = i[at], cell[at], v.astype(space.packed)
            yield _pieces(np.zeros(len(i), int), cell, part, _deal(row[i], np.full(len(i), slices), 3), row[i], vec_id[i], label[i], packed[i])

    def ask(batches):
        for b in batches:
            v, row, label, cell = space.whole(b.column(3)), b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(4).to_numpy()
            part = _deal(row, parts[cell], 4)
            i, piece = _spread(np.arange(len(v)), np.full(len(v), slices))
            out = _pieces(np.zeros(len(i), int), cell[i], part[i], piece, row[i], b.column(1).to_numpy()[i], label[i], v.astype(space.packed)[i])
            yield pa.RecordBatch.from_arrays([*out.columns, b.column(5).take(pa.array(i))], names=[*out.schema.names, "pairs"])

    def best(anchors, others):
        names = ("row", "anchor_id", "place", "positive_id", "positive_score", "negative", "negative_id", "negative_score")
        if not anchors.num_rows or not others.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        q, s = _matrix(anchors.column("vec"), space), _matrix(others.column("vec"), space)
        row, ids, label = others.column("row").to_numpy(), others.column("vec_id").to_numpy(), others.column("own").to_numpy()
        order = np.lexsort((row, ids))
        s, row, ids, label = s[order], row[order], ids[order], label[order]
        own, anchor_id, labels, pairs = anchors.column("row").to_pylist(), anchors.column("vec_id").to_pylist(), anchors.column("own").to_pylist(), anchors.column("pairs").to_pylist()
        found = []
        for a in range(0, len(q), 256):
            for j, line in enumerate(q[a : a + 256] @ s.T, a):
                scores = [p["positive_score"] for p in pairs[j]]
                i = np.flatnonzero((100 * line >= low * min(scores)) & (line <= max(scores)) & (label != labels[j]))
                i = i[np.argsort(-line[i], kind="stable")]
                score = line[i].astype(np.int64)
                for p in pairs[j]:
                    top = np.flatnonzero((100 * score >= low * p["positive_score"]) & (score <= p["positive_score"]))[:k]
                    found += [(own[j], anchor_id[j], p["place"], p["positive_id"], p["positive_score"], int(row[i[t]]), int(ids[i[t]]), int(score[t])) for t in top]
        return pa.table({n: pa.array([f[c] for f in found], pa.int64()) for c, n in enumerate(names)})

    key = ["label", "cell", "part", "slice"]
    sent = rows.select("row", "vec_id", "label", "vec").mapInArrow(send, PIECE)
    asked = rows.where("anchor").join(wanted.select("row", "acell", "pairs"), "row").select("row", "vec_id", "label", "vec", "acell", "pairs")
    asked = asked.mapInArrow(ask, PIECE + ", pairs array<struct<place: long, positive_id: long, positive_score: long>>")
    found = asked.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(best, "row long, anchor_id long, place long, positive_id long, positive_score long, negative long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id", "negative"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, positives_k: int = 5, negatives_k: int = 5, low: int = 80, pivots: int = PIVOTS, **options) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; `options` go to `prepare`."""
    rows = materialize(prepare(vectors, **options), "negatives-rows")
    space = fit_space(rows, pivots)
    if space is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    cells = materialize(placed(rows, space), "negatives-cells")
    reach = materialize(reach_by_label(cells, space, positives_k), "negatives-reach")
    good = positives(rows, reach, space, positives_k)
    pairs = F.collect_list(F.struct(F.col("place").cast("long").alias("place"), "positive_id", "positive_score")).alias("pairs")
    wanted = good.groupBy("row", "label").agg(pairs).join(cells.where("anchor").select("row", "acell", "adist"), "row")
    wanted = materialize(wanted, "negatives-wanted")
    n_rows = cells.count()
    drop_table(cells, reach)
    found = negatives(rows, wanted, space, negatives_k, low, n_rows)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
