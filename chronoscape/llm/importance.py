"""Target-distribution importance resampling over a written sparse matrix of documents by hashed-feature buckets.

Words are runs of ASCII digits, letters (A-Z lower-cased) and everything beyond ASCII; features are all runs of 1 to
`ngram` words joined by one space, and a feature's bucket is the crc32 of its bytes modulo `buckets`. Documents become
CSR blocks (row pointers, bucket numbers, counts) in a written table. Column sums of the blocks are the two
distributions; a bucket's gain is the floored log ratio of the smoothed shares, in thousandths; a document's weight is
the product of its row with the gains. A Gumbel number from doc_id is added, so that the highest scores are a draw
without replacement in proportion to exp(weight / 1000).

Null and empty texts have no features: weight 0. A null doc_id is hashed like an empty one and loses ties. Repeated rows
are drawn one by one. Empty tables: with no target the shares are the smoothing alone; with no documents no rows. Texts
of any length are cut into features piece by piece, and blocks end at a number of entries, so memory does not depend on
the length of a text beyond the text itself. Only `doc_id` and `text` are read; other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _LOWER, CHUNK, drop_table, materialize, text_chunks

BUCKETS = 10_000
#: A block ends after this many entries; one document has at most `buckets`.
ENTRIES = 1 << 18

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & np.uint32(1), (_CRC >> np.uint32(1)) ^ np.uint32(0xEDB88320), _CRC >> np.uint32(1))

BLOCK = "doc_id array<long>, n_words array<long>, n_features array<long>, indptr binary, indices binary, counts binary"


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 64) -> np.ndarray:
    """The crc32 of each slice of data: byte by byte for all slices at once; slices of over `most` bytes one at a time."""
    size = ends - starts
    order = np.argsort(size, kind="stable")
    at, n = starts[order], size[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for j in range(int(min(n[-1], most)) if len(n) else 0):
        k = np.searchsorted(n, j, "right")
        c = crc[k:]
        crc[k:] = _CRC[(c ^ data[at[k:] + j]) & np.uint32(255)] ^ (c >> np.uint32(8))
    crc = ~crc
    for i in range(int(np.searchsorted(n, most, "right")), len(n)):
        crc[i] = zlib.crc32(data[at[i] : at[i] + n[i]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _spans(offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and row of each word."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def _runs(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, ngram: int, known: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Row and crc32 of every run of 1 to ngram words of one row that ends after the first `known` words."""
    rows, crcs = [row[known:]], [crc32(lower, starts[known:], ends[known:])]
    if ngram > 1 and len(starts):
        size = ends - starts
        joined = np.full(int(size.sum()) + len(size), 32, np.uint8)
        to = np.cumsum(size + 1) - size - 1
        k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        joined[np.repeat(to, size) + k] = lower[np.repeat(starts, size) + k]
        for m in range(2, ngram + 1):
            i = np.flatnonzero(row[: len(row) - m + 1] == row[m - 1 :])
            i = i[i + m - 1 >= known]
            rows.append(row[i])
            crcs.append(crc32(joined, to[i], to[i + m - 1] + size[i + m - 1]))
    return np.concatenate(rows), np.concatenate(crcs)


def _long_text(data: np.ndarray, ngram: int, piece: int) -> Iterator[tuple[int, np.ndarray]]:
    """Number of words and crc32 of features, piece by piece; pieces end between words."""
    at, tail = 0, np.zeros(0, np.uint8)
    while at < len(data):
        stop = min(at + piece, len(data))
        if stop < len(data):
            gaps = np.flatnonzero(~_WORD[data[at:stop]])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
            else:  # within one long word: to its end
                while stop < len(data):
                    gaps = np.flatnonzero(~_WORD[data[stop : stop + piece]])
                    if len(gaps):
                        stop += int(gaps[0])
                        break
                    stop = min(stop + piece, len(data))
        lower = np.concatenate((tail, _LOWER[data[at:stop]]))
        starts, ends, row = _spans(np.array([0, len(lower)]), lower)
        known = int(np.searchsorted(starts, len(tail)))
        yield len(starts) - known, _runs(lower, starts, ends, row, ngram, known)[1]
        tail = np.zeros(0, np.uint8)
        if ngram > 1 and len(starts):
            tail = np.append(lower[starts[-(ngram - 1) :][0] : ends[-1]], np.uint8(32))
        at = stop


def _rows(column: pa.Array, ngram: int, buckets: int, piece: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: words a row, row of each entry, bucket, count; entries in order."""
    for _, offs, data in text_chunks(column, piece):
        n = len(offs) - 1
        if n == 1 and len(data) > piece:
            n_words, sums = 0, np.zeros(buckets, np.int64)
            for w, crc in _long_text(data, ngram, piece):
                n_words += w
                sums += np.bincount(crc % np.uint32(buckets), minlength=buckets)
            at = np.flatnonzero(sums)
            yield np.array([n_words]), np.zeros(len(at), np.int64), at, sums[at]
        else:
            starts, ends, row = _spans(offs, data)
            of, crc = _runs(_LOWER[data], starts, ends, row, ngram)
            key, count = np.unique(of * buckets + (crc % np.uint32(buckets)).astype(np.int64), return_counts=True)
            yield np.bincount(row, minlength=n), key // buckets, key % buckets, count


def csr_blocks(docs: DataFrame, ngram: int = 1, buckets: int = BUCKETS, entries: int = ENTRIES, piece: int = CHUNK) -> DataFrame:
    """The matrix of documents (rows) by buckets as CSR blocks: indptr as int64, indices as int32, counts as int64, little-endian."""

    def block(ids, rows):
        words, ptr, at, count = [], [np.zeros(1, np.int64)], [], []
        features, base = [], 0
        for w, of, b, c in rows:
            cut = np.searchsorted(of, np.arange(len(w) + 1))
            words.append(w)
            features.append(np.add.reduceat(np.append(c, 0), cut[:-1]) * (cut[1:] > cut[:-1]))
            ptr.append(cut[1:] + base)
            at.append(b.astype("<i4"))
            count.append(c.astype("<i8"))
            base += len(b)
        one = lambda parts, kind: np.concatenate(parts).astype(kind)
        cells = [[ids], [one(words, "<i8")], [one(features, "<i8")], [one(ptr, "<i8").tobytes()], [one(at, "<i4").tobytes()], [one(count, "<i8").tobytes()]]
        kinds = [pa.list_(pa.int64())] * 3 + [pa.binary()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names=["doc_id", "n_words", "n_features", "indptr", "indices", "counts"])

    def make(batches):
        for batch in batches:
            ids, first, have, rows = batch.column(0), 0, 0, []
            for r in _rows(batch.column(1), ngram, buckets, piece):
                rows.append(r)
                have += len(r[2])
                if have >= entries:
                    n = sum(len(x[0]) for x in rows)
                    yield block(ids.slice(first, n).to_pylist(), rows)
                    first, have, rows = first + n, 0, []
            if rows:
                yield block(ids.slice(first).to_pylist(), rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(make, BLOCK)


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket: summed in every task, then by bucket. `buckets` bounds what reaches the driver."""

    def add(batches):
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for at, count in zip(batch.column(0), batch.column(1)):
                np.add.at(sums, np.frombuffer(at.as_buffer(), "<i4"), np.frombuffer(count.as_buffer(), "<i8"))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["bucket", "n"])

    rows = blocks.select("indices", "counts").mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of target and source shares with one added to every bucket, floored."""
    k = len(source)
    ratio = (target + 1.0) * (float(source.sum()) + k) / ((source + 1.0) * (float(target.sum()) + k))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def scores(blocks: DataFrame, gain: np.ndarray, seed: str) -> DataFrame:
    """doc_id, n_words, n_features, weight (sparse matrix times gains) and score (weight plus Gumbel noise) of every row."""

    def multiply(batches):
        for batch in batches:
            for ids, words, features, ptr, at, count in zip(*batch.columns):
                keys = ids.as_py()
                ptr, value = np.frombuffer(ptr.as_buffer(), "<i8"), gain[np.frombuffer(at.as_buffer(), "<i4")] * np.frombuffer(count.as_buffer(), "<i8")
                total = np.concatenate(([0], np.cumsum(value)))
                weight = total[ptr[1:]] - total[ptr[:-1]]
                h = [int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16) for k in keys]
                noise = [math.floor(-1000 * math.log(-math.log((x + 0.5) / 4294967296))) for x in h]
                columns = [pa.array(keys, pa.int64()), words.values, features.values, pa.array(weight), pa.array(weight + np.array(noise, np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight", "score"])

    return blocks.mapInArrow(multiply, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(scored: DataFrame) -> DataFrame:
    """The rows with their place (`rank`, from 1) by score, ties to the smaller doc_id, among rows where `fit` holds.

    A sort by ranges whose parts are counted: no task holds more than a part."""
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    parts = materialize(scored.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "importance-ranges")
    counts = parts.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # a row a partition
    before, total = {}, 0
    for r in counts:
        before[r.part], total = total, total + r.n
    starts = scored.sparkSession.createDataFrame(list(before.items()), "part int, before long")
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.join(F.broadcast(starts), "part").withColumn("rank", F.when(F.col("fit"), within + F.col("before")))


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), min_words: int = 20, ngram: int = 1, buckets: int = BUCKETS, seed: str = "2024") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document. Of the N documents of at least `min_words` words, the
    floor(share * N) highest scores are drawn, in the order of `rank`; it is null for all others."""
    blocks = materialize(csr_blocks(docs, ngram, buckets), "importance-matrix")
    aim = csr_blocks(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), ngram, buckets)
    gain = gains(column_sums(blocks, buckets), column_sums(aim, buckets))
    scored = scores(blocks, gain, seed).withColumn("fit", F.col("n_words") >= min_words).withColumn("row", F.monotonically_increasing_id())
    scored = materialize(scored, "importance-scores")
    drop_table(blocks)
    most = scored.where("fit").count() * share[0] // share[1]
    rank = F.when(F.col("rank") <= most, F.col("rank")).cast("long").alias("rank")
    return ranked(scored).select("doc_id", "n_features", "weight", "score", rank)


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The documents that `resample` draws, all columns kept. Rows that share a doc_id come together if one is drawn; rows without doc_id are not returned."""
    own = resample(docs, target, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(own, docs["doc_id"].cast("long") == F.col("__drawn"), "left_semi")
