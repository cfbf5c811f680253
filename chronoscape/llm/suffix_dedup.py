"""Repeated byte strings by blockwise suffix sorting with a difference-cover sample.

Every byte covered by a `length`-byte string that also starts anywhere else is found, exactly. Sorting all suffixes of
a corpus is out of reach of one machine, and most suffixes are unique, so the work is cut down by content first:

1. Each window of `length` bytes has an anchor: the 50-byte string in it with the least hash (the leftmost of equals).
   Equal windows have equal anchors at equal offsets, so only anchors that occur twice matter. An anchor's context is
   what its windows can reach, 150 bytes before it and 150 after it.
2. Occurrences of an anchor with equal contexts repeat each other whole; counting (anchor, context) hashes settles
   them, however many copies there are. What remains are contexts that differ, near the ends of repeated passages.
3. Their suffixes are sorted in blocks: one bucket (an anchor, and an offset before it) at a time, by the first 32
   bytes, and only within ties by the precomputed rank of the sample suffix that follows and then by the tail. Contexts
   are aligned at the anchor, so two suffixes of one bucket always have the same residue and the multiples of 32 are a
   difference cover. Neighbours that agree on `length` bytes are repeats. Memory is that of one block.
4. A bucket of more than `bucket_rows` contexts is split by longer prefixes before it is sorted: the windows of half as
   many places share more bytes, and only contexts that agree on these can repeat in them. Halving goes on for buckets
   still too large, down to single places, where the shared bytes are the whole window. Contexts that are equal in all
   that the windows of a run of places cover repeat there and go on as one, which others may repeat.

Defined results: null text is empty; texts under `length` bytes lose nothing; repeated rows repeat each other; texts
are judged as bytes, and bytes that are left are joined even inside a character; empty tables give empty results;
columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import BROADCAST_BYTES, CHUNK, drop_table, materialize, may_hold, mix, powers, prefix_hashes, sized, text_chunks

LENGTH, KMER = 200, 50
REACH = LENGTH - KMER
STEP = 32
SLOT = 352  # a context of at most 350 bytes, in multiples of STEP
#: Bytes in which anchors are sought at once; longer texts are taken in overlapping parts.
PART = 4 << 20
RUNS = "array<struct<start:long,end:long>>"
_INDEX = np.uint64((1 << 24) - 1)


def signed(x: int) -> int:
    return x - (x >> 63 << 64)


def anchors_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 64-bit hashes of the anchors of all windows that lie within one text."""
    n = len(data) - KMER + 1
    if n < REACH + 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    c = prefix_hashes(data)
    h = mix((c[KMER:] - c[:-KMER]) * powers(len(data))[1][:n])
    key = (h & ~_INDEX) | np.arange(n, dtype=np.uint64)
    low, width = key, 1
    while width * 2 <= REACH + 1:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = REACH + 1 - width
    low = np.minimum(low[: len(low) - rest], low[rest:])
    starts = np.concatenate([np.arange(a, b - LENGTH + 1) for a, b in zip(offs, offs[1:], strict=False) if b - a >= LENGTH] or [np.zeros(0, np.int64)])
    at = np.unique((low[starts] & _INDEX).astype(np.int64))
    return at, h[at]


def parts_of(offs: np.ndarray, data: np.ndarray, most: int | None = None):
    """(first byte, offsets, bytes) to seek anchors in: the chunk, or overlapping parts of one long text."""
    most = most or PART
    if len(data) <= most:
        yield 0, offs, data
        return
    for i in range(0, max(1, len(data) - LENGTH + 1), most):
        part = data[i : i + most + LENGTH - 1]
        yield i, np.array([0, len(part)]), part


def text_key() -> list:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")]


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, pos, anchor, context of every anchor, each once."""
    most = PART

    def run(batches):
        for batch in batches:
            doc, key = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, offs, data in text_chunks(batch.column(2), min(CHUNK, most)):
                raw, last = data.tobytes(), -1
                for begin, own, part in parts_of(offs, data, most):
                    at, h = anchors_of(part, own)
                    new = at + begin > last  # places grow with the windows: a part's first may be the last of the part before
                    at, h = at[new] + begin, h[new]
                    last = int(at[-1]) if len(at) else last
                    row = np.searchsorted(offs, at, "right") - 1
                    lo, hi = np.maximum(offs[row], at - REACH), np.minimum(offs[row + 1], at + LENGTH)
                    context = [signed(xxh3_64_intdigest(raw[a:b], c)) for a, b, c in zip(lo.tolist(), hi.tolist(), (at - lo).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([doc[first + i] for i in row.tolist()], pa.int64()), pa.array([key[first + i] for i in row.tolist()], pa.int64()), pa.array(at - offs[row]), pa.array(h.view(np.int64)), pa.array(context, pa.int64())], names=["doc_id", "text_hash", "pos", "anchor", "context"])

    return docs.select(*text_key()).mapInArrow(run, "doc_id long, text_hash long, pos long, anchor long, context long")


def refine(group: np.ndarray, key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows by key within their groups; the new groups of equals, and the rows that are not alone in theirs."""
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    new = np.concatenate(([True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])))
    ident = np.cumsum(new)
    keep = ~(new & np.concatenate((new[1:], [True])))
    return ident[keep], rows[order[keep]]


def ranks(cols: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of rows by several columns."""
    order = np.lexsort(cols[::-1])
    new = np.zeros(len(order), bool)
    for c in cols:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def sort_block(bucket: np.ndarray, left: np.ndarray, raws: list[bytes], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For contexts (bytes with the anchor at left): which windows, by their place in [lo, hi), repeat within a bucket."""
    m = len(raws)
    text = np.zeros((m, SLOT), np.uint8)
    size = np.fromiter(map(len, raws), np.int64, m)
    for i, raw in enumerate(raws):
        text[i, REACH - left[i] : REACH - left[i] + len(raw)] = np.frombuffer(raw, np.uint8)
    word = lambda j: np.ascontiguousarray(text[:, j : j + 8]).view(">u8")[:, 0].astype(np.uint64)
    r32 = {s: ranks([word(s + d) for d in range(0, STEP, 8)]) for s in range(0, SLOT, STEP)}
    sample = {s: ranks([r32[s + d] for d in range(0, 160, STEP)]) for s in range(0, SLOT - 160 + 1, STEP)}
    _, own = np.unique(bucket, return_inverse=True)
    out = np.zeros((m, REACH + 1), bool)
    for j in range(int(lo.min()), int(hi.max())):
        rows = np.flatnonzero((lo <= j) & (j < hi) & (REACH - left <= j) & (REACH - left + size >= j + LENGTH))
        group = own[rows]
        s = -(-j // STEP) * STEP
        keys = [lambda d=d: word(j + d) for d in range(0, STEP, 8)] + [lambda: sample[s]] + [lambda d=d: word(j + d) for d in range(160, LENGTH, 8)]
        for key in keys:
            if not len(rows):
                break
            group, rows = refine(group, key()[rows], rows)
        out[rows, j] = True
    return out


def runs_of(dup: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs [first, end) of true places."""
    edge = np.diff(np.concatenate(([0], dup.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


SPANS = "doc_id long, text_hash long, start long, end long"


DEALT = "doc_id long, text_hash long, pos long, n long, anchor long, left long, raw binary, bucket long, lo int, hi int"
_FIELDS = [c.split()[0] for c in DEALT.split(", ")]


def split(contexts: DataFrame, width: int) -> DataFrame:
    """Contexts (DEALT) dealt anew by runs of `width` places and the bytes that all windows of a run share, with reach: a
    hash of all bytes that its windows cover, or null where the context lacks some of them.

    A window that starts at a place of [f, f + width) holds the bytes from place f + width - 1 to f + LENGTH; a context
    without all of them has no window there.
    """

    def run(batches):
        kinds = [pa.int64()] * 6 + [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        for batch in batches:
            out = []
            for row in zip(*[batch.column(c).to_pylist() for c in _FIELDS], strict=True):
                anchor, left, raw, lo, hi = row[4], row[5], row[6], row[8], row[9]
                shift = REACH - left  # the place of the context's first byte
                for f in range(lo, hi, width):
                    g = min(f + width, hi)
                    a, b = g - 1 - shift, f + LENGTH - shift
                    if a >= 0 and b <= len(raw):
                        key = (anchor ^ (f << 20)) & (2**64 - 1)
                        c, d = f - shift, g - 1 + LENGTH - shift
                        reach = signed(xxh3_64_intdigest(raw[c:d], key)) if c >= 0 and d <= len(raw) else None
                        out.append((*row[:7], signed(xxh3_64_intdigest(raw[a:b], key)), f, g, reach))
            cols = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[*_FIELDS, "reach"])

    return contexts.select(*_FIELDS).mapInArrow(run, f"{DEALT}, reach long")


def settle(contexts: DataFrame, block_rows: int = 4096) -> DataFrame:
    """Spans (SPANS) that repeat, of contexts (DEALT), bucket by bucket."""

    def run(batches):
        held: list[tuple] = []

        def flush(rows):
            of = lambda k: np.array([r[k] for r in rows])
            dup = sort_block(of(7), of(5), [r[6] for r in rows], of(8), of(9))
            out = [(r[0], r[1], r[2] - REACH + a, r[2] - REACH + b - 1 + LENGTH) for r, d in zip(rows, dup, strict=True) if r[3] == 1 and d.any() for a, b in runs_of(d)]
            cols = list(zip(*out, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "text_hash", "start", "end"])

        for batch in batches:
            held += zip(*[batch.column(c).to_pylist() for c in _FIELDS], strict=True)
            if len(held) > block_rows:  # all but the last bucket, which may go on
                cut = len(held)
                while cut and held[cut - 1][7] == held[-1][7]:
                    cut -= 1
                if cut:
                    yield flush(held[:cut])
                    held = held[cut:]
        if held:
            yield flush(held)

    return contexts.select(*_FIELDS).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, SPANS)


def settle_equal(dealt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans (SPANS) of the runs (of split) that others equal in all that their windows cover, and the runs (DEALT) that are
    left: one for each that differs, which stands for its equals and is settled if it has any."""
    same = ["bucket", "reach"]
    cells = dealt.where("reach is not null").groupBy(*same).agg(F.count("*").alias("rows"), F.min(F.struct("doc_id", "text_hash", "pos")).alias("one"))
    cells = materialize(cells.where("rows > 1"), "suffix-equal")
    marked = dealt.join(sized(cells), same, "left")
    start, end = F.col("pos") - REACH + F.col("lo"), F.col("pos") - REACH + F.col("hi") - 1 + LENGTH
    spans = marked.where("rows > 1 and n = 1").select("doc_id", "text_hash", start.alias("start"), end.alias("end"))
    stands = F.col("rows").isNull() | F.struct("doc_id", "text_hash", "pos").eqNullSafe(F.col("one"))
    n = F.when(F.col("rows").isNull(), F.col("n")).otherwise(F.greatest(F.col("n"), F.lit(2).cast("long")))
    return spans, marked.where(stands).withColumn("n", n).select(*_FIELDS)


def settle_buckets(contexts: DataFrame, bucket_rows: int) -> DataFrame:
    """Spans (SPANS) that repeat, of contexts (DEALT, a bucket an anchor): buckets that are too large are split.

    Of a common passage's contexts, only the runs that the passage's end lies in are split further: the others share all
    that their windows cover, or nothing. So a halving leaves about one run a context, whatever its width."""
    spans, width = None, REACH + 1
    while True:
        # a bucket of one context has nothing to repeat it
        rows = contexts.groupBy("bucket").agg(F.count("*").alias("rows")).where("rows > 1")
        rows = materialize(rows, "suffix-buckets")
        small = settle(contexts.join(sized(rows.where(F.col("rows") <= bucket_rows)), "bucket", "left_semi"))
        spans = small if spans is None else spans.unionByName(small)
        large = rows.where(F.col("rows") > bucket_rows)
        if large.isEmpty():
            return spans
        width = -(-width // 2)
        large = contexts.join(sized(materialize(large, "suffix-large")), "bucket", "left_semi")
        dealt = materialize(split(large, width), "suffix-split")
        equal, contexts = settle_equal(dealt)
        contexts = materialize(contexts, "suffix-left")
        spans = spans.unionByName(materialize(equal, "suffix-settled"))
        drop_table(dealt)


def repeated_spans(docs: DataFrame, bucket_rows: int = 4_096, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, text_hash, runs: the maximal runs of bytes covered by repeated windows, for texts that have any."""
    all_anchors = materialize(anchors(docs), "suffix-anchors")
    often = all_anchors.groupBy("anchor").agg(F.count("*").alias("n"), F.min("context").alias("lo"), F.max("context").alias("hi")).where("n > 1")
    often = materialize(often.select("anchor", (F.col("lo") != F.col("hi")).alias("mixed")), "suffix-often")
    found = materialize(all_anchors.join(often, "anchor"), "suffix-found")
    drop_table(all_anchors)
    cells = found.where("mixed").groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", "pos")).alias("one"))
    cells = materialize(cells.select("anchor", "context", "n", "one.*"), "suffix-cells")

    # What repeats with its whole context.
    alone = cells.where("n = 1").select("anchor", "context")
    whole = found.where("not mixed").select("doc_id", "text_hash", "pos").unionByName(found.where("mixed").join(alone, ["anchor", "context"], "left_anti").select("doc_id", "text_hash", "pos"))
    whole = whole.select("doc_id", "text_hash", F.greatest(F.col("pos") - REACH, F.lit(0)).alias("start"), (F.col("pos") + LENGTH).alias("end"))

    # The contexts that differ.
    wanted = cells.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_list(F.struct("pos", "anchor", "n")).alias("at"))
    wanted = materialize(wanted, "suffix-wanted")
    near = sized(wanted, most_bytes=most_bytes)

    def fetch(batches):
        kinds = [pa.int64()] * 6 + [pa.binary(), pa.int64(), pa.int32(), pa.int32()]
        for batch in batches:
            for doc, key, text, at in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                raw = text.encode()
                rows = [(doc, key, x["pos"], x["n"], x["anchor"], min(x["pos"], REACH), raw[max(0, x["pos"] - REACH) : x["pos"] + LENGTH], x["anchor"], 0, REACH + 1) for x in at]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=_FIELDS)

    base = docs.select(*text_key())
    if near is wanted:  # a shuffle: texts of which nothing is wanted stay where they are
        base = may_hold(base, "text_hash", wanted, "_hash").where("may_hold")
    contexts = base.join(near, base.doc_id.eqNullSafe(F.col("_id")) & (base.text_hash == F.col("_hash"))).select("doc_id", "text_hash", "text", "at").mapInArrow(fetch, DEALT)
    # a repeated row is fetched with its twin; its anchors have n > 1, and equal contexts say nothing new
    contexts = materialize(contexts.dropDuplicates(["doc_id", "text_hash", "pos", "anchor"]), "suffix-contexts")
    spans = whole.unionByName(settle_buckets(contexts, bucket_rows))

    def merge(batches):
        for batch in batches:
            out = []
            for spans_ in batch.column(2).to_pylist():
                runs: list[list[int]] = []
                for s, e in sorted((x["start"], x["end"]) for x in spans_):
                    if runs and s <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], e)
                    else:
                        runs.append([s, e])
                out.append([{"start": s, "end": e} for s, e in runs])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "text_hash", "runs"])

    by_text = spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return materialize(by_text.mapInArrow(merge, f"doc_id long, text_hash long, runs {RUNS}"), "suffix-runs")


def remove_repeats(docs: DataFrame, found: DataFrame, keep_text: bool = True, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left) of every row of docs."""

    def run(batches):
        for batch in batches:
            rows = []
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw, at, parts, n = text.encode(), 0, [], 0
                for x in runs or ():
                    e = min(x["end"], len(raw))
                    parts.append(raw[at : x["start"]])
                    n += e - x["start"]
                    at = e
                left = b"".join(parts) + raw[at:]
                rows.append((len(raw), n, len(runs or ()), hashlib.sha256(left).hexdigest(), left))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(),) * 3 + (pa.string(), pa.binary())
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)][: 5 if keep_text else 4]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(arrays) + 1])

    base = docs.select(*text_key())
    runs = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "runs")
    near, rest = sized(runs, most_bytes=most_bytes), None
    if near is runs:  # a shuffle: texts without runs stay where they are
        base = may_hold(base, "text_hash", runs, "_hash")
        rest = base.where("not may_hold").select("doc_id", "text", F.lit(None).cast(RUNS).alias("runs"))
        base = base.where("may_hold")
    joined = base.join(near, base.doc_id.eqNullSafe(F.col("_id")) & (base.text_hash == F.col("_hash")), "left").select("doc_id", "text", "runs")
    joined = joined if rest is None else joined.unionByName(rest)
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else ""))
