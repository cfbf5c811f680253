"""Near duplicates by a grouped prefix join on the Jaccard similarity of word shingles.

Two texts link when intersection * 100 >= 75 * union of their sets of distinct 5-word shingles. The result is exact:

1. Shingles are ordered, rare ones first. Frequent shingles are found over all texts: each task counts what it reads,
   in blocks, and reports what reached `local_df` in a block; the sums name the (at most `heavy`) most frequent ones.
   Any order gives right results; this one keeps common passages out of the prefixes.
2. Two sets that link share a shingle among their first n - ceil(0.75 n) + 1. Texts with the same prefix and size form
   one group, whose prefix is kept once. A shingle of one group only ends here. Shingles with the same groups have the
   same list: the first of them in the order stands for all, which leaves a small part of the lists.
3. Group pairs. In each of a few rounds every list and size class has a hub (first the group whose place for the
   shingle is least, so that is nearest to what the list has in common), every group outside the hub's component is
   paired with the hub that it meets most, and the pair's first members are verified. Links are joined to components.
   A round makes at most one pair a group, however large a list is.
4. Last round: groups of one list that still are in different components. Size and position filters are first applied
   to (list, component, size) cells, each standing for all its groups by the least place, then to the group pairs
   of the cells that are left, then the bound by what two prefixes share. The pairs left are expanded to members of
   different components and verified. After it every link between different components has been seen.

Verification first bounds the intersection of two sets by their histograms (shingles per bucket of hashes), which is
never too low, and then fetches the texts of the members in question and compares their sets. Sets are compared as 64-bit
hashes; that two different shingles of one pair of texts collide has a chance of about size**2 / 2**64.

Defined results: null or blank text has an empty set, links with nothing and is its own component; fewer than five
words are one shingle; equal sets always link; rows without doc_id take part, and a component without any doc_id has
none; empty tables give empty results; other columns are ignored, and `keep_first` passes them through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connect
from .common import drop_table, lists, materialize, mix, private, row_key, shingle_sets, sized, text_chunks

#: Similarity as a fraction of whole numbers.
NUM, DEN = 75, 100
#: Shingles per block in which a task counts frequencies.
BLOCK = 4_000_000


def prefix_size(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1 if n else 0


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if DEN * len(a) < NUM * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return DEN * both >= NUM * (len(a) + len(b) - both)


def set_key(s: np.ndarray) -> int:
    """A 64-bit key of a set: equal for equal sets."""
    if not len(s):
        return 0
    key = (int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)) + len(s) * 0x9E3779B97F4A7C15) % 2**64
    return key - 2**64 * (key >> 63)


def frequent(docs: DataFrame, local_df: int = 2, heavy: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, ascending, and how many distinct sets hold each (as far as blocks reported it)."""

    def report(parts):
        t, n = np.unique(np.concatenate(parts), return_counts=True)
        keep = n >= local_df
        return pa.RecordBatch.from_arrays([pa.array(t[keep].view(np.int64)), pa.array(n[keep])], names=["token", "df"])

    def run(batches):
        parts, held, seen = [], 0, set()
        for batch in batches:
            for _, offs, data in text_chunks(batch.column(0)):
                for s in shingle_sets(offs, data):
                    if len(s) and (key := set_key(s)) not in seen:
                        seen.add(key)
                        parts.append(s)
                        held += len(s)
                if held >= BLOCK:
                    yield report(parts)
                    parts, held, seen = [], 0, set()
        if parts:
            yield report(parts)

    got = docs.select(F.col("text").cast("string")).mapInArrow(run, "token long, df long").groupBy("token").agg(F.sum("df").alias("df"))
    top = got.orderBy(F.col("df").desc(), "token").limit(heavy).toArrow()  # bounded by `heavy`
    token, df = top.column("token").to_numpy().view(np.uint64), top.column("df").to_numpy()
    order = np.argsort(token)
    return token[order], df[order]


def order_prefix(s: np.ndarray, token: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, int]:
    """The prefix of the sorted set s under the order, and how many frequent shingles it ends with.

    Shingles that are not known as frequent come first, by hash; then the others, by frequency.
    """
    n = prefix_size(len(s))
    if not len(token):
        return s[:n], 0
    at = np.searchsorted(token, s)
    at[at == len(token)] = 0
    known = token[at] == s
    if not known.any():
        return s[:n], 0
    often = np.flatnonzero(known)
    often = often[np.lexsort((s[often], df[at[often]]))]
    return s[np.concatenate((np.flatnonzero(~known), often))[:n]], max(0, n - (len(s) - len(often)))


def histogram(s: np.ndarray) -> bytes:
    """Shingles per bucket, two to four on average; the number of buckets is a power of two. 255 stands for more."""
    if not len(s):
        return b""
    buckets = 1 << max(4, (max(1, len(s) // 4) - 1).bit_length())
    return np.minimum(np.bincount((s >> np.uint64(40)).astype(np.int64) & (buckets - 1), minlength=buckets), 255).astype(np.uint8).tobytes()


def may_link(a: bytes, n: int, b: bytes, m: int) -> bool:
    """Whether the histograms of sets of n and m shingles leave room for a link."""
    x, y = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (a, b))
    if (x == 255).any() or (y == 255).any():
        return True
    k = min(len(x), len(y))
    both = int(np.minimum(x.reshape(-1, k).sum(0), y.reshape(-1, k).sum(0)).sum())
    return DEN * both >= NUM * (n + m - both)


SIGNED = "doc_id long, row long, size int, node long, gid long, hist binary, known int, prefix array<long>"


def signatures(docs: DataFrame, token: np.ndarray, df: np.ndarray) -> DataFrame:
    """Rows of SIGNED; prefix is null where the task gave the same group's prefix before.

    The last `known` shingles of a prefix are among the frequent ones.
    """
    order = docs.sparkSession.sparkContext.broadcast((token, df))  # at most `heavy` entries

    def run(batches):
        seen: set[int] = set()
        token, df = order.value
        for batch in batches:
            doc, row = batch.column(0), batch.column(1)
            for first, offs, data in text_chunks(batch.column(2)):
                sets = shingle_sets(offs, data)
                node, gid, known, out = [], [], [], []
                for s in sets:
                    p, k = order_prefix(s, token, df)
                    g = set_key(np.append(np.sort(p), np.uint64(len(s)))) if len(s) else 0
                    fresh = len(s) > 0 and g not in seen
                    if fresh:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(g)
                    node.append(set_key(s))
                    gid.append(g)
                    known.append(k)
                    out.append(p if fresh else p[:0])
                n = len(sets)
                arrays = [doc.slice(first, n), row.slice(first, n), pa.array([len(s) for s in sets], pa.int32()), pa.array(node, pa.int64()), pa.array(gid, pa.int64()), pa.array([histogram(s) for s in sets], pa.binary()), pa.array(known, pa.int32()), lists(out)]
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in SIGNED.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), row_key(docs).alias("row"), F.col("text").cast("string")).mapInArrow(run, SIGNED)


def verify(docs: DataFrame, signed: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of pairs (a, b: nodes, a written table) whose sets link."""
    if pairs.isEmpty():
        return pairs
    nodes = lambda p: sized(materialize(p.select(F.col("a").alias("node")).unionByName(p.select(F.col("b").alias("node"))).distinct(), "near-nodes"))
    known = signed.join(nodes(pairs), "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("one"), F.first("size").alias("size"), F.first("hist").alias("hist"))
    known = materialize(known, "near-known")

    def screen(batches):
        for batch in batches:
            keep = [may_link(*x) for x in zip(*[batch.column(c).to_pylist() for c in ("hist_a", "size_a", "hist_b", "size_b")], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    about = lambda c: known.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("hist").alias(f"hist_{c}"))
    pairs = materialize(pairs.join(about("a"), "a").join(about("b"), "b").mapInArrow(screen, "a long, b long"), "near-screened")
    source = known.join(nodes(pairs), "node", "left_semi").select("node", F.col("one.doc_id").alias("_id"), F.col("one.row").alias("_row"))
    source = materialize(source, "near-wanted")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("row"), F.col("text").cast("string").alias("text"))
    texts = text.join(sized(source), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row"))).select("node", F.col("text").cast("binary").alias("raw"))
    texts = materialize(texts.dropDuplicates(["node"]), "near-texts")
    side = lambda c: texts.select(F.col("node").alias(c), F.col("raw").alias(f"raw_{c}"))

    def compare(batches):
        held: dict[int, np.ndarray] = {}

        def of(node, raw):
            if node not in held:
                if len(held) > 64:
                    held.clear()
                data = np.frombuffer(raw.as_buffer(), np.uint8)
                held[node] = shingle_sets(np.array([0, len(data)]), data)[0]
            return held[node]

        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("a", "b"))
            ra, rb = (batch.column(c) for c in ("raw_a", "raw_b"))  # texts are looked at where they are
            keep = [linked(of(x, ra[i]), of(y, rb[i])) for i, (x, y) in enumerate(zip(a, b, strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep)], names=["a", "b", "ok"])

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "raw_a", "raw_b")
    found = materialize(both.mapInArrow(compare, "a long, b long, ok boolean").where("ok").select("a", "b"), "near-links")
    drop_table(known, pairs, source, texts)
    return found


def shared_lists(signed: DataFrame) -> DataFrame:
    """token, gid, size, pos: the lists of the shingles that several groups have, one for each set of groups.

    Shingles that are not known as frequent stand in few texts, so a window finds those of several groups; known ones
    may stand in any share of the corpus, so they only ever meet as sums. A group may come from several tasks, then
    with all of its prefix, so that shingles of the same groups still have equal sums.
    """
    entries = signed.where(F.size("prefix") > 0).select("gid", (F.size("prefix") - F.col("known")).alias("rare"), F.posexplode("prefix").alias("pos", "token"))
    sums = {"n": F.count("*"), "s": F.sum(F.hash("gid").cast("long")), "t": F.sum(F.hash("gid", F.lit(1)).cast("long")), "one": F.min(F.struct("gid", "pos")), "hi": F.max("gid")}
    own = Window.partitionBy("token")
    few = entries.where("pos < rare").select("token", "gid", "pos").withColumns({"lo": F.min("gid").over(own), "hi": F.max("gid").over(own)}).where("lo <> hi").drop("lo", "hi")
    # in the same partitions; what tells of a list as a whole is written in its first row only
    first = (F.col("gid") == F.col("one.gid")) & (F.col("pos") == F.col("one.pos"))
    few = few.withColumns({k: v.over(own) for k, v in sums.items() if k != "hi"})
    few = materialize(few.select("token", "gid", "pos", *[F.when(first, F.col(c)).alias(c) for c in ("n", "s", "t")]), "near-shared")
    often = materialize(entries.where("pos >= rare").select("token", "gid", "pos"), "near-often")
    known = often.groupBy("token").agg(*[v.alias(k) for k, v in sums.items()]).where("one.gid <> hi")
    sign = few.where("n is not null").select("token", "n", "s", "t", F.struct("gid", "pos").alias("one")).unionByName(known.select("token", "n", "s", "t", "one"))
    # all groups see the shingles in the same order, so places in any one of them tell which is first
    first = sign.groupBy("n", "s", "t").agg(F.min_by("token", F.struct("one.pos", "token")).alias("token")).select("token")
    first = materialize(first, "near-first")
    found = few.select("token", "gid", "pos").unionByName(often).join(sized(first), "token", "left_semi").distinct()
    size = signed.where(F.size("prefix") > 0).select("gid", "size").distinct()
    found = materialize(found.join(size, "gid").select("token", "gid", "size", "pos"), "near-lists")
    drop_table(few, often, first)
    return found


def need(n: Column, m: Column) -> Column:
    """The least intersection of linked sets of n and m shingles."""
    return F.ceil(NUM * (n + m) / F.lit(float(NUM + DEN)))


def rooted(listed: DataFrame, members: DataFrame, root: DataFrame | None) -> DataFrame:
    """listed with root: the component of the group's members, or the group itself where they are in several."""
    if root is None:
        return listed.join(members.groupBy("gid").agg(F.min("node").alias("lo"), F.max("node").alias("hi")), "gid").withColumn("root", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("gid"))).drop("lo", "hi")
    of = members.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")).groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    return listed.join(of.select("gid", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("gid")).alias("root")), "gid")


def hub_pairs(listed: DataFrame, turn: int) -> DataFrame:
    """x, y: each group of listed (with root) and the hub, outside its component, that it meets in most lists."""
    group = F.floor(F.log(F.col("size")) / math.log(DEN / NUM)).cast("int").alias("class")
    by = F.struct("pos", "gid") if turn == 0 else F.struct(F.xxhash64("gid", F.lit(turn)), "gid")
    hubs = listed.groupBy("token", group).agg(F.min_by(F.struct("gid", "root", "size", "pos"), by).alias("hub"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token", "class", "hub")
    met = listed.withColumn("class", group).join(hubs, ["token", "class"]).where(F.col("root") != F.col("hub.root"))
    room = F.least(F.col("size") - F.col("pos"), F.col("hub.size") - F.col("hub.pos")) >= need(F.col("size"), F.col("hub.size"))
    counted = met.where(room).groupBy("gid", F.col("hub.gid").alias("hub")).agg(F.count("*").alias("n"))
    return counted.groupBy("gid").agg(F.max_by("hub", F.struct("n", "hub")).alias("y")).select(F.col("gid").alias("x"), "y")


def cross_pairs(listed: DataFrame, signed: DataFrame) -> DataFrame:
    """x, y: the pairs of groups of listed (with root) in different components that no filter rules out."""
    mixed = listed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    apart = materialize(listed.join(mixed, "token", "left_semi"), "near-apart")
    cells = apart.groupBy("token", "root", "size").agg(F.min("pos").alias("pos"))
    side = lambda df, c: df.select("token", *[F.col(n).alias(f"{n}_{c}") for n in df.columns if n != "token"])
    before = (F.col("size_x") < F.col("size_y")) | ((F.col("size_x") == F.col("size_y")) & (F.col("root_x") < F.col("root_y")))
    fits = (F.col("root_x") != F.col("root_y")) & (DEN * F.col("size_x") >= NUM * F.col("size_y"))
    room = F.least(F.col("size_x") - F.col("pos_x"), F.col("size_y") - F.col("pos_y")) >= need(F.col("size_x"), F.col("size_y"))
    met = materialize(side(cells, "x").join(side(cells, "y"), "token").where(before & fits & room).select("token", "root_x", "size_x", "root_y", "size_y"), "near-cells")
    one = met.join(side(apart, "x"), ["token", "root_x", "size_x"]).where(F.col("size_x") - F.col("pos_x") >= need(F.col("size_x"), F.col("size_y")))
    both = one.join(side(apart, "y"), ["token", "root_y", "size_y"]).where(room).select(F.col("gid_x").alias("x"), F.col("gid_y").alias("y")).distinct()
    both = materialize(both, "near-both")
    gids = both.select(F.col("x").alias("gid")).unionByName(both.select(F.col("y").alias("gid"))).distinct()
    gids = sized(materialize(gids, "near-gids"))
    groups = materialize(signed.where(F.size("prefix") > 0).join(gids, "gid", "left_semi").select("gid", "size", "prefix").dropDuplicates(["gid"]), "near-groups")
    of = lambda c: groups.select(F.col("gid").alias(c), F.col("size").alias(f"size_{c}"), F.col("prefix").alias(f"prefix_{c}"))
    share = F.size(F.array_intersect("prefix_x", "prefix_y")) + F.greatest(F.col("size_x") - F.size("prefix_x"), F.col("size_y") - F.size("prefix_y"))
    return both.join(of("x"), "x").join(of("y"), "y").where(share >= need(F.col("size_x"), F.col("size_y"))).select("x", "y")


def labels(docs: DataFrame, local_df: int = 2, heavy: int = 1 << 19, rounds: int = 1) -> DataFrame:
    """doc_id, row (its key), size, node (its set) and root (a node that names its component) of every row of docs."""
    token, df = frequent(docs, local_df, heavy)
    signed = materialize(signatures(docs, token, df), "near-signed")
    listed = shared_lists(signed)
    members = materialize(signed.where("size > 0").select("gid", "node").distinct(), "near-members")
    firsts = members.groupBy("gid").agg(F.min("node").alias("node"))
    first = lambda c: firsts.select(F.col("gid").alias("x" if c == "a" else "y"), F.col("node").alias(c))
    pair = lambda a, b: [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]

    links, tried, root = None, None, None
    for turn in range(rounds):
        met = hub_pairs(rooted(listed, members, root), turn).join(first("a"), "x").join(first("b"), "y").select(*pair("a", "b"))
        if turn == 0:  # the members of a group, each with its first
            met = met.unionByName(members.join(firsts.withColumnRenamed("node", "hub"), "gid").where("node <> hub").select(*pair("node", "hub")))
        met = met.distinct() if tried is None else met.distinct().join(tried, ["a", "b"], "left_anti")
        met = materialize(met, "near-pairs")
        found = verify(docs, signed, met)
        links, tried = (found, met) if links is None else (links.unionByName(found), tried.unionByName(met))
        if root is not None:
            drop_table(root)
        root = materialize(connect(links), "near-roots")

    wide = cross_pairs(rooted(listed, members, root), signed)
    inner = members.groupBy("gid").agg(F.count("*").alias("n")).where("n > 1").select(F.col("gid").alias("x"), F.col("gid").alias("y"))
    named = members.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of = lambda c, node: named.select(F.col("gid").alias(c), F.col("node").alias(node), F.col("root").alias(f"root_{node}"))
    late = wide.unionByName(inner).join(of("x", "m"), "x").join(of("y", "n"), "y").where("root_m <> root_n").select(*pair("m", "n")).distinct()
    late = materialize(late.join(tried, ["a", "b"], "left_anti"), "near-pairs")
    more = verify(docs, signed, late)
    root = sized(materialize(connect(links.unionByName(more)), "near-roots"))
    drop_table(listed, members)
    return signed.select("doc_id", "row", "size", "node").join(root, "node", "left").withColumn("root", F.when(F.col("size") > 0, F.coalesce("root", "node")))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links) of every row of docs (doc_id, text)."""
    labelled = labels(docs, **options)
    least = labelled.where("size > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    return labelled.join(least, "root", "left").select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.when(F.col("size") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each component: of its rows with the least doc_id (or none, where no row has one) the one
    with the least key. Rows without words stay, as they link with nothing. A kept row that stands in the table more
    than once, equal in all columns, stays once. Columns pass through."""
    labelled = materialize(labels(docs, **options).where("size > 0").select("doc_id", "row", "node", "root"), "near-labelled")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row", "node")
    first = labelled.groupBy("root").agg(F.min(order).alias("k"))
    kept = labelled.groupBy("root", "doc_id", "row", "node").agg(F.count("*").alias("n")).join(first, "root").where(order.eqNullSafe(F.col("k")))
    kept = materialize(kept.select("doc_id", "row", "n"), "near-kept")
    gone = labelled.join(kept.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left_anti").select("doc_id", "row").distinct()
    gone = sized(materialize(gone.withColumn("n", F.lit(0).cast("long")).unionByName(kept.where("n > 1").select("doc_id", "row", "n")), "near-gone"))
    doc, row, n = private(docs, "doc", "row", "n")
    mark = gone.select(F.col("doc_id").alias(doc), F.col("row").alias(row), F.col("n").alias(n))
    key = row_key(docs)
    marked = docs.join(mark, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (key == F.col(row)), "left")
    once = marked.where(F.col(n).isNull()).select(*docs.columns)
    many = marked.where(F.col(n) > 1).dropDuplicates([doc, row]).select(*docs.columns)
    return once.unionByName(many) if kept.where("n > 1").limit(1).count() else once
