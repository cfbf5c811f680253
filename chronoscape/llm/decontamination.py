"""Benchmark decontamination by pigeonhole edit matching.

A test item of m bytes (lower-cased, words joined by single blanks) is leaked by a text that holds a passage within
k = floor(error_rate * m) edits of it. Of k + 1 pieces of the item, at least one then stands in the passage unchanged.
Rolling hashes of each text are looked up among the hashes of the pieces' first bytes; a hit that is a whole piece is
a candidate, and around it Myers' bit-parallel search verifies the item. Items too short for an edit (k = 0) are
searched as they are, between word boundaries.

The benchmark is the query set: its items go to the executors as one broadcast of at most `block_bytes` of item text,
which is measured; a larger benchmark is taken in blocks of that size, each against all texts in a scan of its own. No
side grows with the corpus and nothing is shuffled.

Defined results: null or blank texts and items match nothing; items that repeat match each on their own; a document row
gives at most one row per item row, the best match (least distance, then first); a repeated document repeats its rows;
empty tables give empty results; columns besides doc_id, text and item_id, text are ignored, and `remove_leaks` passes
a document's other columns through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, materialize, mix, powers, prefix_hashes, private, row_key, sized

MATCHES = "doc_id long, item_id long, distance int, start_word int, end_word int"
_MAP = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def normalise(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased and every run of other ASCII than letters and digits as one blank."""
    return b" ".join((text or "").encode().translate(_MAP).split())


def myers(pattern: bytes, text: bytes, limit: int, masks: dict[int, int] | None = None) -> tuple[int, int] | None:
    """Least edit distance of the pattern to a substring of text, if at most limit, and the first end it has there."""
    m = len(pattern)
    masks = masks if masks is not None else pattern_masks(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, limit + 1, -1
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, i + 1
    return (best, end) if best <= limit else None


def pattern_masks(pattern: bytes) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


#: A piece is looked up by its first so many bytes: the most of these that it has.
SIZES = (16, 12, 8, 4, 2)
_BITS = 22


def hashes(data: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of all strings of q bytes."""
    c = prefix_hashes(data)
    return mix((c[q:] - c[:-q]) * powers(len(data))[1][: len(data) - q + 1])


class Matcher:
    """Finds the items of one block in normalised texts. Items and texts have a blank before and after them."""

    def __init__(self, items: list[tuple[int, bytes]], error_rate: float):
        self.items, self.error_rate = items, error_rate
        self.masks: dict[int, dict[int, int]] = {}
        found: dict[int, list[tuple[bytes, int, int, int]]] = {}
        for n, (_, item) in enumerate(items):
            k = self.edits(item)
            # an item that allows no edit keeps its blanks, and so its word boundaries
            cuts = [1 + round(i * (len(item) - 2) / (k + 1)) for i in range(k + 2)] if k else [0, len(item)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                q = next(q for q in SIZES if q <= b - a)
                found.setdefault(q, []).append((item[a : a + q], n, a, b - a))
        self.pieces = {}
        for q, rows in found.items():
            h = hashes(np.frombuffer(b"".join(x[0] for x in rows), np.uint8), q)[::q]
            order = np.argsort(h, kind="stable")
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.pieces[q] = (h[order], np.array([x[1:] for x in rows])[order], bitmap)

    def edits(self, item: bytes) -> int:
        return int(self.error_rate * (len(item) - 2))

    def hits(self, text: bytes) -> list[tuple[int, int]]:
        """(item, where in the text it would start) of all pieces that the text holds, in order of places."""
        data, out = np.frombuffer(text, np.uint8), set()
        for q, (known, piece, bitmap) in self.pieces.items():
            for at in range(0, len(data) - q + 1, CHUNK):
                h = hashes(data[at : at + CHUNK + q - 1], q)
                may = np.flatnonzero(bitmap[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
                lo, hi = np.searchsorted(known, h[may], "left"), np.searchsorted(known, h[may], "right")
                for i in np.flatnonzero(hi > lo):
                    p = at + int(may[i])
                    for n, a, size in piece[lo[i] : hi[i]].tolist():
                        if text[p : p + size] == self.items[n][1][a : a + size]:
                            out.add((p - a, n))
        return [(n, s) for s, n in sorted(out)]

    def __call__(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(item, distance, first byte, end byte) of the best match of each item that the text leaks, without blanks."""
        spans: dict[int, list[list[int]]] = {}
        found: dict[int, tuple[int, int, int]] = {}
        for n, s in self.hits(text):
            item = self.items[n][1]
            k = self.edits(item)
            if n in found and found[n][0] == 0:
                continue
            size = len(item) - 2
            if not k or s >= -1 and text.startswith(item[1:-1], s + 1):
                found[n] = (0, s + 1, s + 1 + size)
                continue
            own = spans.setdefault(n, [])
            lo, hi = max(0, s + 1 - k), min(len(text), s + 1 + size + k)
            if own and lo <= own[-1][1]:
                own[-1][1] = max(own[-1][1], hi)
            else:
                own.append([lo, hi])
        for n, windows in spans.items():
            if n in found:
                continue
            item, k = self.items[n][1][1:-1], self.edits(self.items[n][1])
            masks = self.masks.get(n) or self.masks.setdefault(n, pattern_masks(item))
            for lo, hi in windows:
                limit = min(k, found[n][0] - 1 if n in found else len(item))
                if limit >= 0 and (got := myers(item, text[lo:hi], limit, masks)):
                    distance, end = got[0], lo + got[1]
                    # the same search backwards gives the start
                    low = max(0, end - len(item) - distance)
                    back = myers(item[::-1], text[low:end][::-1], distance)
                    found[n] = (distance, end - back[1] if back else low, end)
        return [(n, *x) for n, x in sorted(found.items())]


def blocks(bench: DataFrame, block_bytes: int):
    """The benchmark's (item_id, normalised text between blanks) in blocks of at most about block_bytes."""
    rows = bench.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // block_bytes)
    for i in range(parts):
        got = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i).toArrow()
        items = [(i, b" " + n + b" ") for i, t in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True) if (n := normalise(t))]
        if items:
            yield sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def leaks(docs: DataFrame, bench: DataFrame, error_rate: float = 0.05, block_bytes: int = 64 << 20) -> DataFrame:
    """Rows of MATCHES: the items that each row of docs (doc_id, text) leaks."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for items in blocks(bench, block_bytes):
        sent = spark.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            match = Matcher(sent.value, error_rate)
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if text and (text := normalise(text)):
                        text = b" " + text + b" "
                        rows += [(doc, match.items[n][0], d, text.count(b" ", 1, s), text.count(b" ", 1, e) + 1) for n, d, s, e in match(text)]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), *(pa.int32(),) * 3), strict=True)], names=[c.split()[0] for c in MATCHES.split(", ")])

        got = texts.mapInArrow(run, MATCHES)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], MATCHES)


def remove_leaks(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """docs without the rows that leak an item, by their own text: rows without doc_id, or that share one, stay or go
    each on its own. Columns pass through, and texts are not shuffled while the rows that go can be broadcast."""
    key = row_key(docs)
    flagged = leaks(docs.select(key.alias("doc_id"), F.col("text")), bench, **options).select("doc_id").distinct()
    (gone,) = private(docs, "gone")
    flagged = sized(materialize(flagged.withColumnRenamed("doc_id", gone), "leaks-gone"))
    return docs.join(flagged, key == F.col(gone), "left_anti")
