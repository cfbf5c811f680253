"""Information-theoretic sanitisation of personal data.

Four base patterns find protected entities. In the texts that hold them stand terms; over the corpus, the pointwise mutual
information of a term and an entity, as a share of what the entity's own occurrence would tell (its information
content), says how strongly the term reveals it: 1 for a term met with that entity alone, about 0 for common words.
A term at or above `remove` is removed and one at or above `generalise` is replaced by its class, wherever it stands
in a text that holds that entity. Terms are whole words of three characters or more. Texts without the entity keep it.

Counting is in three aggregations, all combined on the map side: documents per entity, documents and distinct
contexts per (entity, term), and documents per term, this last only for terms with enough contexts. Distinct contexts
keep copies of one document from making all of its words look telling; they are counted beside mentions and over whole
texts, and the greater count holds. Texts are read twice and never shuffled.

Defined results: null text is empty; repeated rows count as documents each and get equal results; rows without doc_id
take part by their text; an entity that
stands in every document has no information and hides nothing; empty tables give empty results; columns besides doc_id
and text are ignored. All patterns run in linear time on any text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, sized

KINDS = ("email", "ip", "card", "phone", "general", "removed")
SPAN = "array<struct<start:int,kind:int,end:int>>"
NEAR = "array<struct<entity:long,term:string,context:long>>"
TERMS = "array<struct<term:string,context:long,start:int,end:int>>"

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A term: letters, digits and whatever is beyond ASCII.
TERM_CLASS = r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
#: What stands between terms.
GAP_CLASS = TERM_CLASS.replace("[^", "[")
_TERM = re.compile(TERM_CLASS)
_CLASS = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str):
    """Matches of the local part, @ and a domain with a dot, found from each @ outwards."""
    at, free = text.find("@"), 0
    while at >= 0:
        s = at
        while s > free and text[s - 1] in _CLASS:
            s -= 1
        if s < at and (m := _DOMAIN.match(text, at + 1)):
            yield s, m.end()
            free = m.end()
        else:
            free = at + 1  # no later match can begin before this @
        at = text.find("@", free)


def ips(text: str):
    for m in _DOTTED.finditer(text):
        parts, s = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            e = s + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield s, e
            s = e + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    found += [(s, 1, e) for s, e in ips(text)]
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(found)


def terms_of(text: str, base: list, reach: int, window: int) -> tuple[list, list]:
    """(entity, term, context) of the terms beside each mention, and (term, context, start, end) of all terms of the text,
    with the context at a term's first place only.

    Beside a mention stand up to `window` whole words on each side that begin or end within `reach` characters; their
    context is the words themselves. Elsewhere a term's context is the `window` words on each side of its first place.
    """
    from xxhash import xxh3_64_intdigest

    number = lambda b: int.from_bytes(xxh3_64_intdigest(b).to_bytes(8, "little"), "little", signed=True)
    word, start, end, last, i = [], [], [], 0, 0
    for m in _TERM.finditer(text) if base else ():
        while i < len(base) and base[i][0] < m.end():
            last, i = max(last, base[i][2]), i + 1
        if last <= m.start():  # no part of an entity
            word.append(m[0])
            start.append(m.start())
            end.append(m.end())
    low = [w.translate(_LOWER) for w in word]
    beside = set()
    for s, kind, e in base:
        p, q = bisect_right(end, s), bisect_left(start, e)
        near = [i for i in range(max(0, p - window), p) if end[i] > s - reach] + [i for i in range(q, min(len(word), q + window)) if start[i] < e + reach]
        near = [i for i in near if len(word[i]) >= 3]
        entity, context = number(f"{kind}:{text[s:e].lower()}".encode()), number(" ".join(word[i] for i in near).encode())
        beside |= {(entity, low[i], context) for i in near}
    first: dict[str, int] = {}
    every = []
    for i, w in enumerate(low):
        if len(w) >= 3:
            context = number(" ".join(word[max(0, i - window) : i + window + 1]).encode()) if first.setdefault(w, i) == i else None
            every.append((w, context, start[i], end[i]))
    return sorted(beside), every


def entities_of(text: str, base: list) -> list[int]:
    from xxhash import xxh3_64_intdigest

    return sorted({int.from_bytes(xxh3_64_intdigest(f"{k}:{text[s:e].lower()}".encode()).to_bytes(8, "little"), "little", signed=True) for s, k, e in base})


_LOWER = {c: c + 32 for c in range(65, 91)}


def extract(docs: DataFrame, reach: int = 60, window: int = 6) -> DataFrame:
    """doc_id, text_hash, base (spans), entities, near (terms beside the entities), terms (of texts with entities)."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    near = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.string()), ("context", pa.int64())]))
    terms = pa.list_(pa.struct([("term", pa.string()), ("context", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            a, b, c, d = [], [], [], []
            for text in batch.column(2).to_pylist():
                base = base_spans(text)
                beside, every = terms_of(text, base, reach, window)
                a.append([dict(zip(("start", "kind", "end"), x, strict=True)) for x in base])
                b.append(entities_of(text, base))
                c.append([dict(zip(("entity", "term", "context"), x, strict=True)) for x in beside])
                d.append([dict(zip(("term", "context", "start", "end"), x, strict=True)) for x in every])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(a, span), pa.array(b, pa.list_(pa.int64())), pa.array(c, near), pa.array(d, terms)], names=["doc_id", "text_hash", "base", "entities", "near", "terms"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(run, f"doc_id long, text_hash long, base {SPAN}, entities array<long>, near {NEAR}, terms {TERMS}")


def disclosure(docs: DataFrame, found: DataFrame, contexts: int = 3, least: float = 0.0) -> DataFrame:
    """entity, term, disclosure of at least `least` (mutual information as a share of the entity's information content)."""
    found = found if "row" in found.columns else materialize(found.withColumn("row", F.monotonically_increasing_id()), "pii-rows")
    total = found.count()
    held = found.where(F.size("entities") > 0)
    entities = held.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    entities = materialize(entities, "pii-entities")
    count = lambda rows: rows.groupBy("entity", "term", "context").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.count("*").alias("n_contexts"), F.sum("n").alias("n_both"))
    beside = materialize(count(held.select(F.explode("near").alias("p")).select("p.*")), "pii-beside")
    # A text is one context of a term and an entity, so entities in fewer texts cannot have enough.
    often = entities.where(F.col("n_entity") >= contexts)
    most = often.agg(F.max("n_entity")).first()[0] or 1
    # Nor can terms that stand in fewer contexts, whatever the entity, unless they have enough of them beside mentions;
    # and a term in so many texts that no entity's share of it can reach `least` is not telling. What is left of a text's
    # entities is then paired with what is left of its terms.
    # The first places tell a text's terms apart: array_distinct compares each pair of structs of an array.
    each = held.select("row", F.explode(F.filter("terms", lambda x: x["context"].isNotNull())).alias("p")).select("row", "p.term", "p.context")
    spread = each.groupBy("term", "context").agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("n_contexts"), F.sum("n").alias("n_near"))
    near = beside.where(F.col("n_contexts") >= contexts).select("term").distinct().withColumn("beside", F.lit(True))
    enough = spread.join(near, "term", "left").where((F.col("n_contexts") >= contexts) | F.col("beside"))
    enough = sized(materialize(enough.where(F.col("n_near") <= total * (most / max(1, total)) ** least * (1 + 1e-9)).select("term"), "pii-spread"))
    mentions = held.select("row", F.explode("entities").alias("entity")).join(sized(materialize(often.select("entity"), "pii-often")), "entity", "left_semi")
    whole = count(mentions.join(each.join(enough, "term", "left_semi"), "row").select("entity", "term", "context"))
    pairs = beside.unionByName(whole).groupBy("entity", "term").agg(F.max("n_contexts").alias("n_contexts"), F.max("n_both").alias("n_both")).where(F.col("n_contexts") >= contexts)
    # A term stands in at least as many documents as it stands with entities in: a bound that spares counting terms
    # which cannot reach `least`, such as common words.
    seen = held.select(F.explode(F.array_distinct(F.transform("terms", lambda x: x["term"]))).alias("term")).groupBy("term").agg(F.count("*").alias("n_near"))
    pairs = pairs.join(entities, "entity").join(seen, "term").where(F.col("n_entity") < total)
    share = lambda n_term: F.log(F.least("n_both", "n_entity") * F.lit(float(total)) / (n_term * F.col("n_entity"))) / F.log(F.lit(float(total)) / F.col("n_entity"))
    pairs = materialize(pairs.where(share(F.col("n_near")) >= least), "pii-pairs")
    wanted = sized(materialize(pairs.select("term").distinct(), "pii-terms"))
    upper = "".join(map(chr, range(65, 91)))
    text = F.translate(F.col("text").cast("string"), upper, upper.lower())
    # Parting a text at what stands between its terms is several times cheaper than matching each; an empty part is no term.
    each = docs.select(F.explode(F.array_distinct(F.split(text, GAP_CLASS))).alias("term"))
    # Counted before the join: what the join passes on is one row a term, not one a term and document.
    freq = each.groupBy("term").agg(F.count("*").alias("n_term")).join(wanted, "term")
    return pairs.join(freq, "term").select("entity", "term", share(F.greatest("n_term", "n_both")).alias("disclosure"))


def find(docs: DataFrame, generalise: float = 0.75, remove: float = 0.95, contexts: int = 3, **options) -> DataFrame:
    """doc_id, text_hash, base and telling spans of every row of docs (doc_id, text)."""
    found = materialize(extract(docs, **options).withColumn("row", F.monotonically_increasing_id()), "pii-found")
    telling = materialize(disclosure(docs, found, contexts, generalise).where(F.col("disclosure") >= generalise), "pii-telling")
    key = ["doc_id", "text_hash"]
    # every place of a telling term in the texts that hold the entity: a text's entities meet their own terms only
    held = found.where(F.size("entities") > 0)
    told = held.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_text"), F.explode("entities").alias("entity")).join(sized(telling), "entity")
    told = told.groupBy("_doc", "_text", F.col("term").alias("_term")).agg(F.max("disclosure").alias("d"))
    places = held.dropDuplicates(key).select(*key, F.explode("terms").alias("x")).select(*key, "x.term", "x.start", "x.end")
    places = places.join(sized(materialize(telling.select("term").distinct(), "pii-told")), "term", "left_semi")
    hits = places.join(told, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_text")) & (F.col("term") == F.col("_term"))).groupBy(*key, "start", "end").agg(F.max("d").alias("d"))
    spans = hits.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", F.when(F.col("d") >= remove, 5).otherwise(4).alias("kind"), "end"))).cast(SPAN).alias("telling"))
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "telling")
    rows = found.drop("entities", "near", "terms", "row")
    return rows.join(spans, rows.doc_id.eqNullSafe(F.col("_id")) & (rows.text_hash == F.col("_hash")), "left").drop("_id", "_hash").withColumn("telling", F.coalesce("telling", F.array().cast(SPAN)))


def show(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(show(F.col("base")), 256).alias("base_sha256"), show(F.concat("base", "telling")).alias("spans"))


def sanitise(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id and text: entities and generalised terms become their class, telling terms go."""

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                at, parts = 0, []
                for x in sorted(spans, key=lambda x: (x["start"], x["kind"])):
                    if x["start"] >= at:
                        parts += [text[at : x["start"]], ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[NUMBER]" if text[x["start"] : x["end"]].isdigit() else "[TERM]", "")[x["kind"]]]
                    at = max(at, x["end"])
                out.append("".join(parts) + text[at:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = ["doc_id", "text_hash"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    spans = found.dropDuplicates(key).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "base", "telling")
    joined = rows.join(spans, rows.doc_id.eqNullSafe(F.col("_id")) & (rows.text_hash == F.col("_hash")), "left")
    return joined.select("doc_id", "text", F.coalesce(F.concat("base", "telling"), F.array().cast(SPAN))).mapInArrow(run, "doc_id long, text string")
