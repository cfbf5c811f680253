"""SQL of the operators that SQL can express on whole tables."""

from __future__ import annotations

import string

from . import line_dedup, secret_scan

_WORDS = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT rid, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.rid < b.rid GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(rid, seen) AS (SELECT rid, rid FROM d UNION SELECT r.rid, e.y FROM r JOIN e ON e.x = r.seen)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM d JOIN r USING (rid) JOIN d o ON o.rid = r.seen LEFT JOIN n ON n.rid = d.rid GROUP BY d.rid, d.doc_id
"""


def _spans(kind: int, pattern: str, least: int = 0) -> str:
    q = pattern.replace("'", "''")
    keep = f"WHERE length(v) >= {least}" if least else ""
    return f"""SELECT rid, {kind} AS kind, (b + f - size)::INT AS start, (b + f)::INT AS stop FROM (
        SELECT rid, v, length(m) AS size, sum(length(t)) OVER o AS b, sum(length(m)) OVER o AS f FROM (
            SELECT rid, unnest(generate_series(1, len(ms))) AS i, unnest(ms) AS m, unnest(ts[: len(ms)]) AS t, unnest(vs) AS v FROM (
                SELECT rid, regexp_extract_all(text, '{q}') AS ms, string_split_regex(text, '{q}') AS ts, regexp_extract_all(text, '{q}', {1 if least else 0}) AS vs FROM d))
        WINDOW o AS (PARTITION BY rid ORDER BY i)) {keep}"""


def _shown(rows: str) -> str:
    names = ", ".join(f"'{k}'" for k in secret_scan.KINDS)
    return f"(SELECT rid, string_agg([{names}][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) AS s FROM {rows} GROUP BY 1)"


SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
base AS ({_spans(0, secret_scan.ASSIGN, 12)} UNION ALL {_spans(1, secret_scan.ACCESS)} UNION ALL {_spans(2, secret_scan.HEX)}),
weak AS ({_spans(3, secret_scan.IDENTIFIER)} UNION ALL {_spans(4, secret_scan.SECRET)} UNION ALL {_spans(5, secret_scan.ENDPOINT)}),
part AS (SELECT *, CASE WHEN kind IN (1, 3) THEN 'i' WHEN kind = 5 THEN 'e' ELSE 's' END AS role FROM (SELECT * FROM base UNION ALL SELECT * FROM weak)),
near AS (SELECT a.rid, a.kind, a.start, a.stop, a.role, max((b.role = 'i')::INT) AS i, max((b.role = 's')::INT) AS s, max((b.role = 'e')::INT) AS e
         FROM part a JOIN part b ON a.rid = b.rid AND a.role <> b.role AND abs(a.start - b.start) <= 200 WHERE a.kind >= 3 GROUP BY ALL),
linked AS (SELECT rid, kind, start, stop FROM near WHERE (role = 's' AND i + e > 0) OR (role = 'i' AND s > 0) OR (role = 'e' AND s + i > 1)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM linked),
n AS (SELECT rid, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS c, count(*) FILTER (kind = 2) AS h FROM base GROUP BY 1)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(x.s, '')) AS base_sha256, coalesce(y.s, '') AS spans
FROM d LEFT JOIN n USING (rid) LEFT JOIN {_shown('base')} x USING (rid) LEFT JOIN {_shown('every')} y USING (rid)
"""

REPEATS = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents),
p AS (SELECT rid, unnest(range(0, length(t) // 2 - 199)) AS i, t FROM d),
w AS (SELECT rid, i, md5(substr(t, 2 * i + 1, 400)) AS h FROM p),
r AS (SELECT rid, i FROM w WHERE h IN (SELECT h FROM w GROUP BY 1 HAVING count(*) > 1)),
g AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS run FROM (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM r)),
s AS (SELECT rid, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY rid, run),
k AS (SELECT rid, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS f, a AS e FROM s UNION ALL SELECT rid, max(b), 1000000000 FROM s GROUP BY 1),
c AS (SELECT rid, string_agg(substr(t, 2 * f + 1, 2 * (e - f)), '' ORDER BY f) AS rest FROM k JOIN d USING (rid) GROUP BY 1),
q AS (SELECT rid, sum(b - a)::BIGINT AS n, count(*) AS m FROM s GROUP BY 1)
SELECT doc_id, length(t) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(m, 0) AS n_spans, sha256(unhex(coalesce(rest, CASE WHEN n IS NULL THEN t ELSE '' END))) AS kept_sha256
FROM d LEFT JOIN q USING (rid) LEFT JOIN c USING (rid)
"""

_FEATURES = f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
RESAMPLING = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_FEATURES} AS ws FROM documents),
f AS (SELECT rid, unnest(ws) AS w FROM d), g AS (SELECT unnest({_FEATURES}) AS w FROM benchmark),
t AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
h AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM f UNION SELECT w FROM g)),
b AS (SELECT w, xor(list_reduce(range(length(x) // 2), lambda c, i: xor(c >> 8, t[1 + (xor(c, ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) & 255)]), 4294967295), 4294967295) % 10000 AS b FROM h, t),
s AS (SELECT b, count(*) AS s FROM f JOIN b USING (w) GROUP BY 1), u AS (SELECT b, count(*) AS t FROM g JOIN b USING (w) GROUP BY 1),
k AS (SELECT b, coalesce(s, 0)::DOUBLE AS s, coalesce(t, 0)::DOUBLE AS t, coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS ss, coalesce((SELECT sum(t) FROM u), 0)::DOUBLE AS tt FROM s FULL JOIN u USING (b)),
n AS (SELECT b, floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::BIGINT AS gain FROM k),
w AS (SELECT rid, sum(gain)::BIGINT AS weight FROM f JOIN b USING (w) JOIN n USING (b) GROUP BY 1),
r AS (SELECT rid, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (rid)),
q AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM r),
p AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, rid) END AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM q)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM p
"""

NEGATIVES = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.rid <> b.rid WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, rid) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER o AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
WINDOW o AS (PARTITION BY p.anchor, p.rid ORDER BY n.score DESC, n.vec_id, n.rid) QUALIFY row_number() OVER o <= 5
"""


def oracle_sql() -> dict[str, str]:
    own = {"op11_importance_resampling": RESAMPLING, "op12_hard_negatives": NEGATIVES}
    return own | {"op3_ngram_jaccard_join": NEAR_DUPLICATES, "op4_suffix_array_dedup": REPEATS, "op7_line_dedup": line_dedup.ORACLE, "op10_secret_scan": SECRETS}
