"""Multipart credential linking, in DataFrame functions only.

Three base patterns give spans that are always reported. Weak parts (account names, short or unusual secrets,
endpoints) are common in clean text, so a weak part is reported only if complementary parts stand near it: an interval
join on (document, scope bucket) finds, for each part, the other parts within `scope` code points. A weak secret needs
an identifier or an endpoint, an identifier needs a secret, an endpoint needs both. Base spans count as partners.

The join is by buckets of one scope's width against the neighbouring buckets: a part meets what lies within three
scopes of text, so pairs grow with the text and not with its square, and a document with many parts is dealt over
many keys.

Defined results: null text counts as empty; a repeated row gets the same result as its twin; rows without doc_id, and
rows that share a doc_id but not the text, are scanned and redacted by their own text; overlapping spans of
different kinds are all reported; empty tables give empty results; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

# The base patterns. hex and access carry their least length; only assign is filtered afterwards, since
# a short value is used up by its match.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
# The weak parts.
IDENTIFIER = r"""(?i:user(?:name|_id)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})"""
SECRET = r"""(?i:pwd|passphrase|credential|auth|private_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})"""
ENDPOINT = r"""(?i:https?|ftp|ssh|jdbc|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]{4,}"""

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _running(items: Column, width, make) -> Column:
    """make(item, sum of the widths before it) of each item, in time that grows with n ** 1.5: sums run over chunks of
    about sqrt(n) items and, before them, over the chunks, so that no growing array is copied for each item."""
    step = F.greatest(F.ceil(F.sqrt(F.size(items))).cast("int"), F.lit(1))

    def sums(values: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("got"))
        return F.aggregate(values, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["got"], F.array(acc["at"])).alias("got")), lambda acc: acc["got"])

    widths = F.transform(items, width)
    chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(items) / step).cast("int") - 1), lambda i: F.slice(widths, i * step + 1, step))

    def whole(parts: Column) -> Column:
        before = sums(F.transform(parts, lambda c: F.aggregate(c, F.lit(0), lambda acc, x: acc + x)), F.lit(0))
        return F.flatten(F.transform(F.arrays_zip(parts.alias("part"), before.alias("first")), lambda z: sums(z["part"], z["first"])))

    at = F.transform(F.array(chunks), whole)[0]  # a lambda's argument is computed once
    return F.zip_with(items, at, make)


def spans(text: Column, pattern: str, kind: int, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as an array of (start, kind, end) in code points.

    The texts between the matches (split) and the matches themselves alternate, so starts are running sums of lengths.
    With `least`, a match counts only if its first group has so many characters.
    """
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if least else found
    zipped = F.arrays_zip(F.transform(F.slice(between, 1, F.size(found)), F.length).alias("b"), F.transform(found, F.length).alias("f"), F.transform(value, F.length).alias("v"))

    def place(x: Column, at: Column) -> Column:
        return F.struct((at + x["b"]).alias("start"), F.lit(kind).alias("kind"), (at + x["b"] + x["f"]).alias("end"), (x["v"] >= least).alias("ok"))

    def whole(items: Column) -> Column:
        every = _running(items, lambda x: x["b"] + x["f"], place)
        return F.transform(F.filter(every, lambda x: x["ok"]), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

    return F.when(text.rlike(pattern), F.transform(F.array(zipped), whole)[0].cast(SPAN)).otherwise(F.array().cast(SPAN))


def show(found: Column) -> Column:
    """kind:start:end of each span, by start and then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def scan(docs: DataFrame, scope: int = 200) -> DataFrame:
    """doc_id, text_hash, base (spans of the base patterns), linked (weak parts with complementary parts within scope)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    raw = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    weak = F.concat(spans(F.col("text"), IDENTIFIER, 3), spans(F.col("text"), SECRET, 4), spans(F.col("text"), ENDPOINT, 5))
    base = F.concat(spans(F.col("text"), ASSIGN, 0, 12), spans(F.col("text"), ACCESS, 1), spans(F.col("text"), HEX, 2))
    parsed = materialize(raw.select("doc_id", F.xxhash64("text").alias("text_hash"), base.alias("base"), weak.alias("weak")), "secret-parts")

    key = ["doc_id", "text_hash"]
    some = parsed.where(F.size("weak") > 0)
    part = some.select(*key, F.explode(F.concat("base", "weak")).alias("p")).distinct().select(*key, "p.*")
    role = F.when(F.col("kind").isin(1, 3), "i").when(F.col("kind") == 5, "e").otherwise("s")
    part = part.withColumn("role", role).withColumn("bucket", F.floor(F.col("start") / scope).cast("int"))
    named = [F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")]
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))  # rows without doc_id go by their text
    near = part.select(*named, F.explode(F.array(*[F.col("bucket") + d for d in (-1, 0, 1)])).alias("_bucket"), F.col("start").alias("other"), F.col("role").alias("beside"))
    pairs = part.where("kind >= 3").join(near, same & (F.col("bucket") == F.col("_bucket"))).where((F.abs(F.col("start") - F.col("other")) <= scope) & (F.col("role") != F.col("beside")))
    has = {r: F.max((F.col("beside") == r).cast("int")) for r in "ise"}
    linked = (
        pairs.groupBy(*key, "start", "kind", "end", "role").agg(*[c.alias(r) for r, c in has.items()])
        .where("(role = 's' and i + e > 0) or (role = 'i' and s > 0) or (role = 'e' and s + i > 1)")
        .groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).cast(SPAN).alias("linked"))
    )
    return parsed.join(linked.select(*named, "linked"), same, "left").select("doc_id", "text_hash", "base", F.coalesce("linked", F.array().cast(SPAN)).alias("linked"))


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id and text of every row of docs, with every reported span overwritten by [kind]; spans that overlap are merged.

    Spans belong to a doc_id (or none) and a text, so rows that share a doc_id but not the text keep their own.
    """
    names = F.array(*map(F.lit, KINDS))
    both = F.array_sort(F.concat("base", "linked"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.when(x["start"] >= acc["at"], F.concat(F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), F.element_at(names, x["kind"] + 1), F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("_hash"), text.alias("text"))
    spans_of = found.where(F.size("base") + F.size("linked") > 0).dropDuplicates(["doc_id", "text_hash"]).withColumnRenamed("doc_id", "_id")
    joined = rows.join(spans_of, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("text_hash")), "left")
    painted = F.aggregate(both, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length(F.col("text")))))
    return joined.select("doc_id", F.coalesce(painted, F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The result of the registered query."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(show(F.col("base")), 256).alias("base_sha256"), show(F.concat("base", "linked")).alias("spans"))
