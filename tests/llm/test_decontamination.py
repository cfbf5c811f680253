import random

import pytest

from helpers import awkward, frame, prose, widened

dec = pytest.importorskip("chronoscape.llm.decontamination")


def sellers(pattern, text):
    """Least distance of the pattern to a substring, by plain dynamic programming."""
    prev = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        cur = [i]
        for j, t in enumerate(text, 1):
            cur.append(min(prev[j - 1] + (p != t), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


def test_myers_equals_plain_dynamic_programming():
    rng = random.Random(12)
    for _ in range(300):
        p, t = (bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, n))) for n in (14, 30))
        want = sellers(p, t)
        assert dec.myers(p, t, len(p))[0] == want
        assert dec.myers(p, t, want - 1) is None


def edited(rng, text, n):
    s = list(text)
    for _ in range(n):
        i = rng.randrange(len(s))
        s[i : i + 1] = rng.choice([[], ["z"], [s[i], "q"]])
    return "".join(s)


def test_equals_brute_force(spark):
    rng = random.Random(13)
    items = [prose(rng, 14, 5000) for _ in range(12)]
    texts = [f"{prose(rng, 10)} {edited(rng, rng.choice(items), rng.randrange(9))}, {prose(rng, 10)}" for _ in range(60)] + [prose(rng, 40) for _ in range(20)] + [items[0].upper().replace(" ", " - ")]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = set()
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            a, b = dec.normalise(item), dec.normalise(t)
            if (n := sellers(a, b)) <= int(0.05 * len(a)):
                want.add((d, i, n))
    for size in (4 << 20, 200):  # one block, and many
        got = dec.leaks(frame(spark, texts), bench, block_bytes=size).collect()
        assert {(r.doc_id, r.item_id, r.distance) for r in got} == want and len(got) == len(want)
    assert any(n > 1 for *_, n in want)
    kept = dec.remove_leaks(frame(spark, texts), bench).collect()
    assert {r.doc_id for r in kept} == set(range(len(texts))) - {d for d, *_ in want}


def test_short_items_are_found_between_word_boundaries(spark):
    items = ["a", "Paris", "42", "who is he", "is it so today", "the capital of france"]
    texts = ["Paris", "paris-42!", "compare parisian", "WHO is  he?", "who is her", "a", "is it so todays", "so: is it so today", "the capital of frances", "the capitol of france", "", None, " a\n"]
    want = set()
    for d, t in enumerate(texts):
        b = dec.normalise(t)
        for i, item in enumerate(items):
            a = dec.normalise(item)
            if k := int(0.05 * len(a)):
                if sellers(a, b) <= k:
                    want.add((d, i))
            elif b" " + a + b" " in b" " + b + b" ":
                want.add((d, i))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = dec.leaks(frame(spark, texts), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) == 9
    assert {(r.doc_id, r.start_word, r.end_word) for r in got if r.item_id in (2, 4)} == {(1, 1, 2), (7, 1, 5)}


def test_long_texts_are_hashed_in_overlapping_parts(spark, monkeypatch):
    monkeypatch.setattr(dec, "CHUNK", 50)
    rng = random.Random(14)
    item = prose(rng, 12, 5000)
    for lead in range(0, 60, 7):
        text = b" " + dec.normalise("x" * lead + " " + item + " y" * 30) + b" "
        assert [(n, d) for n, d, *_ in dec.Matcher([(1, b" " + dec.normalise(item) + b" ")], 0.05)(text)] == [(0, 0)]


def test_awkward_rows(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "lorem ipsum " * 12), (None, "lorem ipsum " * 6)], "item_id long, text string")
    docs = widened(awkward(spark))
    assert {(r.doc_id, r.item_id) for r in dec.leaks(docs, bench.selectExpr("*", "1 AS doc_id")).collect()} == {(4, 4), (4, None)}
    assert dec.remove_leaks(docs, bench).count() == 8
    assert dec.leaks(docs, bench.limit(0)).count() == 0 and dec.leaks(docs.limit(0), bench).count() == 0
