"""Cross-site boilerplate lines by distinct-site spread.

A line (trimmed of blanks, at least `min_chars` long) that stands on `min_sites` or more distinct sites is
boilerplate and goes. Spread is measured by HyperLogLog: each line hash gets a sketch of its sites, built per task and
merged by aggregation. Only lines whose estimate is within `band` of the threshold have their distinct sites counted
exactly, so the result is exact unless a sketch is off by more than the band. Lines of one site only, known from the
least and greatest site hash, need no sketch.

A document that would lose more than `max_share` of its characters is left whole: it is a copy rather than a text with
boilerplate in it, and document deduplication judges copies.

Hot lines and hot sites only meet as partial sums, sketches and sets of sites; the join that finds the lines to drop
is on the line hash against the (counted, then broadcast or else shuffled) boilerplate set. Texts are not shuffled
while the set of documents that lose lines is small enough to broadcast.

Defined results: null text stays null with no lines; null source is no site, but its lines can go; a repeated row gets
the same result as its twin; an empty table gives an empty result; further columns pass through, whatever their names
(only text and the two counts are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, hash128, materialize, private, sized

#: Sketch size: 2^12 registers, a standard error of 1.6 %.
LG_K = 12


def _split() -> Column:
    return F.split(F.col("text"), "\n", -1)


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, text_hash, pos, h1, h2, site, size of every line that counts."""
    text = F.col("text").cast("string")
    raw = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("text_hash"), F.col("source").cast("string").alias("site"))
    each = raw.select("doc_id", "text_hash", "site", F.posexplode(F.transform(_split(), lambda x: F.trim(x))).alias("pos", "line")).where(F.length("line") >= min_chars)
    return each.select("doc_id", "text_hash", "pos", *hash128("line"), "site", F.length("line").alias("size"))


def boilerplate(docs: DataFrame, min_sites: int = 6, min_chars: int = 2, band: float = 0.15) -> DataFrame:
    """h1, h2 of the lines on min_sites or more distinct sites."""
    lines = _lines(docs, min_chars).where("site is not null")
    site = F.xxhash64("site")
    spread = lines.groupBy("h1", "h2").agg(F.min(site).alias("a"), F.max(site).alias("b")).where("a <> b" if min_sites > 1 else "true").select("h1", "h2")
    spread = materialize(spread, "lines-spread")
    shared = lines.join(sized(spread), ["h1", "h2"], "left_semi")
    sketch = F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K))  # of each task's lines first: no row a line and site is shuffled
    estimate = materialize(shared.groupBy("h1", "h2").agg(sketch.alias("sites")), "lines-estimate")
    drop_table(spread)
    found = estimate.where(F.col("sites") > min_sites * (1 + band)).select("h1", "h2")
    near = materialize(estimate.where(F.col("sites").between(min_sites * (1 - band), min_sites * (1 + band))).select("h1", "h2"), "lines-near")
    if not near.isEmpty():
        exact = lines.join(sized(near), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count_distinct("site").alias("sites"))
        found = found.unionByName(exact.where(F.col("sites") >= min_sites).select("h1", "h2"))
    found = materialize(found, "lines-boilerplate")
    drop_table(estimate, near)
    return found


def remove_lines(docs: DataFrame, min_sites: int = 6, min_chars: int = 2, band: float = 0.15, max_share: float = 0.5, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs (doc_id, text, source, ...) with boilerplate lines cut from text; the lines that count, and those removed,
    are added as the columns `counts`."""
    found = boilerplate(docs, min_sites, min_chars, band)
    hits = _lines(docs, min_chars).join(sized(found), ["h1", "h2"], "left_semi").dropDuplicates(["doc_id", "text_hash", "pos"])
    id_, hash_, drop, cut = private(docs, "id", "hash", "drop", "cut")
    drops = hits.groupBy("doc_id", "text_hash").agg(F.collect_list("pos").alias(drop), F.sum("size").alias(cut))
    drops = sized(materialize(drops.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), drop, cut), "lines-drops"))
    text = F.col("text").cast("string")
    joined = docs.withColumn("text", text).join(drops, (F.col("doc_id").cast("long").eqNullSafe(F.col(id_))) & (F.xxhash64("text") == F.col(hash_)), "left")
    size = lambda x: F.length(F.trim(x))
    total = F.aggregate(_split(), F.lit(0), lambda acc, x: acc + F.when(size(x) >= min_chars, size(x)).otherwise(0))
    joined = joined.withColumn(drop, F.when(F.col(cut) <= max_share * total, F.col(drop)))
    stay = lambda whole: F.array_except(F.sequence(F.lit(0), F.size(whole) - 1), F.col(drop))
    rest = F.transform(F.array(_split()), lambda whole: F.array_join(F.transform(stay(whole), lambda i: whole[i]), "\n"))[0]
    n_lines = F.coalesce(F.size(F.filter(_split(), lambda x: size(x) >= min_chars)), F.lit(0))
    whole = F.col(drop).isNull()
    out = joined.withColumns({counts[0]: F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long"), counts[1]: F.when(whole, 0).otherwise(F.size(drop)).cast("long"), "text": F.when(whole, F.col("text")).otherwise(rest)})
    return out.drop(id_, hash_, drop, cut)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


ORACLE = """
WITH l AS (SELECT row_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos
           FROM (SELECT row_number() OVER () AS row_id, source, string_split(text, chr(10)) AS lines FROM documents)),
t AS (SELECT row_id, source, pos, line, trim(line) AS cut FROM l),
b AS (SELECT cut FROM t WHERE length(cut) >= 2 GROUP BY cut HAVING count(DISTINCT source) >= 6),
m AS (SELECT t.*, length(cut) >= 2 AS counts, length(cut) >= 2 AND cut IN (SELECT cut FROM b) AS hit FROM t),
d AS (SELECT row_id, count(*) FILTER (counts) AS n_lines, count(*) FILTER (hit) AS n_hit,
             coalesce(sum(length(cut)) FILTER (hit), 0) <= 0.5 * coalesce(sum(length(cut)) FILTER (counts), 0) AS fair,
             string_agg(line, chr(10) ORDER BY pos) FILTER (NOT hit) AS rest FROM m GROUP BY row_id)
SELECT s.doc_id, coalesce(n_lines, 0) AS n_lines, CASE WHEN fair THEN n_hit ELSE 0 END AS n_removed,
       md5(CASE WHEN fair AND n_hit > 0 THEN coalesce(rest, '') ELSE coalesce(s.text, '') END) AS kept_md5
FROM (SELECT row_number() OVER () AS row_id, doc_id, text FROM documents) s LEFT JOIN d USING (row_id)
"""
