import hashlib
import math
import random
import re
from collections import Counter

import pytest

from helpers import awkward, frame, prose, widened

pii = pytest.importorskip("chronoscape.llm.pii")

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]
    return sorted(found)


def test_base_spans_equal_brute_force():
    rng = random.Random(7)
    bits = ["a", "x.y", "@", ".", "-", " ", "1", "23", "255", "4111 1111 1111 1111", "+1 (555) 010-2345", "é", "b@c.de", "%", "_", "10.0.0.1", "(", "0"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(25)))
        assert pii.base_spans(t) == brute(t), t
    assert pii.base_spans("0" * 6000 + ".1.2.3") == [(0, 1, 6006)]
    assert pii.base_spans("a" * 300_000 + "@") == [] and pii.base_spans("1" * 300_000) == []


def test_telling_terms(spark):
    rng = random.Random(8)
    texts = [f"{prose(rng, 30)} write to zorblax at zed@example.org {prose(rng, 30)}" for _ in range(6)] + [f"{prose(rng, 40)} write at w1" for _ in range(40)] + ["copy of quux by q@example.org"] * 9
    docs = frame(spark, texts)
    found = pii.find(docs)
    shown = {r.doc_id: r.spans for r in pii.digest(found).collect()}
    for i in range(6):
        s = texts[i].index("zorblax")
        assert f"removed:{s}:{s + 7}" in shown[i]
    assert all("removed" not in shown[i] and "general" not in shown[i] for i in range(6, 55))  # neither common words nor copies
    clean = {r.doc_id: r.text for r in pii.sanitise(docs, found).collect()}
    assert "zorblax" not in clean[0] and "[EMAIL]" in clean[0] and clean[10] == texts[10]


def brute_telling(texts, contexts=3, generalise=0.75, remove=0.95, window=6, reach=60):
    """For each text its telling spans, from the definitions alone."""
    term = re.compile(pii.TERM_CLASS)
    low = lambda w: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
    total, held = len(texts), []
    for t in texts:
        base = brute(t)
        words = [(m.start(), m.end(), m[0]) for m in term.finditer(t) if base and not any(s < m.end() and m.start() < e for s, _, e in base)]
        beside, first = set(), {}
        for s, k, e in base:
            left = [w for w in words if w[1] <= s][-window:]
            right = [w for w in words if w[0] >= e][:window]
            near = [w[2] for w in left if w[1] > s - reach and len(w[2]) >= 3] + [w[2] for w in right if w[0] < e + reach and len(w[2]) >= 3]
            beside |= {((k, t[s:e].lower()), low(w), tuple(near)) for w in near}
        for i, (_, _, w) in enumerate(words):
            if len(w) >= 3:
                first.setdefault(low(w), tuple(x[2] for x in words[max(0, i - window) : i + window + 1]))
        held.append(({(k, t[s:e].lower()) for s, k, e in base}, beside, first, words))
    entities = Counter(x for e, *_ in held for x in e)
    near, whole = Counter(x for _, b, *_ in held for x in b), Counter((x, w, c) for e, _, f, _ in held for x in e if entities[x] >= contexts for w, c in f.items())
    n_term = Counter(w for t in texts for w in {low(m[0]) for m in term.finditer(t)})
    told = {}
    for x, w in {(x, w) for x, w, _ in (*near, *whole)}:
        sides = [[n for (a, b, _), n in table.items() if (a, b) == (x, w)] for table in (near, whole)]
        n_contexts, n_both = max(map(len, sides)), max(map(sum, sides))
        if n_contexts >= contexts and entities[x] < total:
            share = math.log(min(n_both, entities[x]) * total / (max(n_term[w], n_both) * entities[x])) / math.log(total / entities[x])
            if share >= generalise:
                told[x, w] = share
    out = []
    for e, _, _, words in held:
        best = [(s, max((told.get((x, low(w)), 0) for x in e), default=0), t) for s, t, w in words]
        out.append([f"{'removed' if d >= remove else 'general'}:{s}:{t}" for s, d, t in best if d >= generalise])
    return out


def test_telling_spans_equal_brute_force(spark):
    rng = random.Random(77)
    people = [("zed@example.org", "Zorblax", "quuxish"), ("+1 555 010 2345", "blorp", "grault"), ("10.0.0.7", "fnord", "plugh")]
    texts = []
    for i in range(70):
        t = prose(rng, rng.randrange(5, 40), 60)
        for mail, a, b in people:
            if rng.random() < 0.25:
                t += f" {a if rng.random() < 0.9 else ''} {'x' * rng.randrange(50)} {mail} {b if rng.random() < 0.7 else ''} {prose(rng, rng.randrange(9), 60)}"
            elif rng.random() < 0.06:
                t += f" {b} alone {a.upper()}remarkable"
        texts.append(t + (" unforgettable remarkable" * rng.randrange(2)))
    texts += [texts[0], texts[1], None, "", "only zed@example.org"]
    want = brute_telling([t or "" for t in texts])
    found = pii.find(frame(spark, texts))
    got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith(("general", "removed"))] for r in pii.digest(found).collect()}
    assert [sorted(got[i]) for i in range(len(texts))] == [sorted(w) for w in want]
    kinds = Counter(x.split(":")[0] for w in want for x in w)
    assert kinds["removed"] > 10 and kinds["general"] > 0


def test_telling_terms_far_from_the_mention(spark):
    rng = random.Random(9)
    texts = [f"zorblax {prose(rng, 60, 4000)} write to zed@example.org {prose(rng, 60, 4000)} zorblax" for _ in range(6)] + [prose(rng, 60, 4000) for _ in range(60)]
    texts += [f"{texts[0]}" for _ in range(2)] + ["a long" + "word" * 20 + " q@example.org"]
    docs = frame(spark, texts)
    found = pii.find(docs)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs, found).collect()}
    assert all("zorblax" not in clean[i] and "[EMAIL]" in clean[i] for i in range(6))
    assert all(clean[i] == texts[i] for i in range(6, 66))
    base = pii.base_spans(texts[-1])
    assert {w for w, *_ in pii.terms_of(texts[-1], base, 60, 6)[1]} == {"long" + "word" * 20}  # not cut at the window's edge


def test_rows_without_id_are_sanitised(spark):
    texts = [f"w{i} zorblax w{i + 1} at zed@example.org w{i + 2}" for i in range(6)] + [f"other w{i}" for i in range(60)]
    docs = frame(spark, texts).selectExpr("IF(doc_id = 0, NULL, doc_id) AS doc_id", "text")
    found = pii.find(docs)
    assert found.where("doc_id IS NULL").first().telling
    clean = next(r.text for r in pii.sanitise(docs, found).collect() if r.doc_id is None)
    assert "zed@" not in clean and "zorblax" not in clean


def test_awkward_rows(spark):
    docs = widened(awkward(spark))
    rows = pii.digest(pii.find(docs)).collect()
    assert len(rows) == 10 and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() and r.spans == "" for r in rows)
    assert pii.sanitise(docs, pii.find(docs)).count() == 10
    assert pii.find(awkward(spark).limit(0)).count() == 0


def test_a_long_text_costs_no_more_than_its_words(spark):
    """A text's terms were told apart by comparing each pair of them; and the corpus was matched term by term."""
    rng = random.Random(10)
    texts = [f"{prose(rng, 40)} at zed@example.org" for _ in range(5)] + [f"Éa zed@example.org ÉA éa {' '.join(f'word{i}' for i in range(300))} word7"]
    every = pii.terms_of(texts[-1], pii.base_spans(texts[-1]), 60, 6)[1]
    told = [w for w, context, *_ in every if context is not None]
    assert len(told) == len(set(told)) == 300 and [context for w, context, *_ in every if w == "word7"][1:] == [None]
    found = pii.extract(frame(spark, texts)).selectExpr("*", "monotonically_increasing_id() AS row")
    plan = pii.disclosure(frame(spark, texts), found)._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan
    each = frame(spark, ["É, x9\U0001f600y--a.b ", "", None]).selectExpr("doc_id", f"split(text, r'{pii.GAP_CLASS}') AS parts").collect()
    assert {r.doc_id: [x for x in r.parts or () if x] for r in each} == {0: ["É", "x9\U0001f600y", "a", "b"], 1: [], 2: []}
