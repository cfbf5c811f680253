import random
import zlib
from collections import Counter

import pytest
from helpers import awkward, widened

from chronoscape.llm import language_id as li

SYLLABLES = {"xx": "ba be bi bo da de di do", "yy": "ka ke ki ko ta te ti to", "zz": "éma éme émi ému sa se si so"}


def corpus(seed, n=240, known=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = sorted(SYLLABLES)[i % 3]
        parts = SYLLABLES[lang].split()
        text = " ".join("".join(rng.choice(parts) for _ in range(rng.choice([1, 2, 2, 5]))).capitalize() for _ in range(rng.choice([4, 30])))
        rows.append((i, text, lang if known else None))
    return rows


def brute(rows, longest=5, penalty=7.0):
    """The same score with nothing but dictionaries, without bounds on the model."""
    import math
    import re

    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    split = lambda t: re.findall(r"[^\W\d_]{1,64}", t.lower())
    parts = {}
    for i, text, lang in rows:
        if i is not None and not out(i) and lang is not None and text is not None:
            for w in split(text):
                parts.setdefault((lang, 0), Counter())[w] += 1
                for n in range(1, longest + 1):
                    p = f" {w} " if n > 1 else w
                    for j in range(len(p) - n + 1):
                        parts.setdefault((lang, n), Counter())[p[j : j + n]] += 1
    langs = sorted({lang for lang, _ in parts})

    def value(lang, n, key):
        c = parts.get((lang, n), Counter())
        return max(-penalty, math.log10(c[key] / sum(c.values()))) if c[key] else -penalty

    got = []
    for i, text, _ in rows:
        sums, n_words, any_word = dict.fromkeys(langs, 0.0), 0, False
        for w in split(text or ""):
            any_word = True
            if any(parts.get((lang, 0), {}).get(w) for lang in langs):
                keys, size = [w], 0
            else:
                for size in range(longest, 0, -1):
                    p = f" {w} " if size > 1 else w
                    keys = [g for g in (p[j : j + size] for j in range(len(p) - size + 1)) if any(parts.get((lang, size), {}).get(g) for lang in langs)]
                    if keys:
                        break
            if keys:
                n_words += 1
                for lang in langs:
                    sums[lang] += sum(value(lang, size, k) for k in keys) / len(keys)
        if not any_word or not langs:
            got.append((i, out(i), "und", 0.0))
        elif not n_words:
            got.append((i, out(i), max(langs, key=lambda x: sum(parts[x, 0].values())), round(1 / len(langs), 9)))
        else:
            best = max(langs, key=lambda x: sums[x])
            got.append((i, out(i), best, round(1 / sum(10 ** ((sums[x] - sums[best]) / n_words) for x in langs), 9)))
    return sorted(got, key=repr)


def result(df):
    return sorted(((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in df.collect()), key=repr)


def test_equals_brute_force(spark):
    rows = corpus(1) + [(900, "Bobadi KAKE xyzzy q", None), (901, "ééé", "zz"), (902, "漢字", None), (903, "12 34 __", "xx"), (None, "babe", "yy"), (905, "x" * 200, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    assert result(li.identify(df)) == brute(rows)


def test_held_out_rows_are_not_learned_from(spark):
    rows = corpus(2)
    hidden = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    of = lambda r: result(li.identify(spark.createDataFrame(r, "doc_id long, text string, lang string")))
    assert of(rows) == of(hidden)
    right = [p == rows[i][2] for i, out, p, _ in of(rows) if out]
    assert len(right) > 30 and sum(right) >= 0.95 * len(right)


def test_unseen_words_by_shorter_ngrams(spark):
    rows = corpus(3) + [(1000 + i, "".join(random.Random(i).choice(p.split()) for _ in range(9)), None) for i, p in enumerate(sorted(SYLLABLES.values()))]
    got = {r[0]: r[2] for r in result(li.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")))}
    assert [got[1000], got[1001], got[1002]] == ["xx", "yy", "zz"]


def test_the_model_is_bounded(spark):
    df = spark.createDataFrame(corpus(4), "doc_id long, text string, lang string")
    model = li.fit(df, words=20, ngrams=30)
    size = Counter(s for s, _ in model.names)
    assert 0 < size[0] <= 20 and all(0 < size[n] <= 30 for n in range(1, 6))
    right = [r.lang_pred == r.lang for r in li.predict(df, model).join(df, "doc_id").collect()]
    assert sum(right) > 0.9 * len(right)


@pytest.mark.parametrize("piece", [64, 1000])
def test_long_texts_in_pieces(monkeypatch, piece):
    import pyarrow as pa

    monkeypatch.setattr(li, "PIECE", piece)
    texts = ["Ab cd " * 500, None, "", "é" * 300, "one two\nthree"]
    for text, pieces in zip(texts, li.text_pieces(pa.array(texts).slice(0))):
        got = list(pieces)
        assert "".join(got) == (text or "").lower()
        if text and " " in text:
            assert [w for p in got for w in p.split()] == text.lower().split()


def test_small_flushes_change_nothing(spark, monkeypatch):
    rows = corpus(5, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(li, "ENTRIES", 7)
    assert [(*r[:3], round(r[3], 6)) for r in result(li.identify(df))] == [(*r[:3], round(r[3], 6)) for r in brute(rows)]


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = result(li.identify(docs))
    assert len(got) == docs.count()
    assert {r[2:] for r in got if r[0] in (1, 2, 3)} == {("und", 0.0)}
    assert result(li.identify(widened(docs))) == got
    assert li.identify(docs.limit(0)).count() == 0
    assert {r[2] for r in result(li.identify(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")))} == {"und"}
