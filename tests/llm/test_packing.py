import os
import random
import subprocess
import sys
import zlib

import numpy as np
import pytest

from helpers import awkward, frame, prose, widened

packing = pytest.importorskip("chronoscape.llm.packing")


def whole_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def check(rows, cap=4096):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= cap
    return bins


def test_ids_and_cuts_equal_the_tokenizer(spark):
    rng = random.Random(1)
    texts = [prose(rng, rng.randrange(60)) for _ in range(40)] + ["Ärger, straße's ÉTÉ dûment! 12.5€", "I'll don't <|endoftext|> x", "a b c \x1c d", "ΟΔΟΣ Σ", "", None, "x " * 9000, "ﬁ é 日本語 😀"]
    got = packing.tokenize_pieces(frame(spark, texts)).collect()
    for i, ids in enumerate(whole_ids(texts)):
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [(r.start, r.length, r.ids_crc32) for r in own] == [(s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for s in range(0, len(ids), 4096)]


def test_packing_is_valid_and_near_the_bound(spark):
    rng = random.Random(2)
    docs = frame(spark, [prose(rng, rng.randrange(1, 900)) for _ in range(400)])
    rows = packing.pack_documents(docs).collect()
    bins = check(rows)
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows)
    total = sum(r.length for r in rows)
    assert len(bins) <= -(-total // 4096) + 2
    sequences = packing.render_sequences(docs, packing.pack_documents(docs)).collect()
    assert sum(len(s.ids) for s in sequences) == total


def test_every_capacity_holds():
    rng = np.random.default_rng(3)
    lengths = np.sort(rng.integers(1, 400, 500))[::-1]
    cap = packing.Capacity(1000, 4, 200_000)
    for rule in ("norm", "dot"):
        where, offset, bins = packing.best_fit(lengths, cap, rule=rule)
        for b in range(bins):
            own = lengths[where == b]
            assert own.sum() <= 1000 and len(own) <= 4 and (own**2).sum() <= 200_000
            order = np.argsort(offset[where == b])
            assert (np.cumsum(own[order]) - own[order] == np.sort(offset[where == b])).all()
    with pytest.raises(ValueError):
        packing.best_fit(np.array([2000]), cap)


def test_awkward_rows(spark):
    rows = packing.pack_documents(widened(awkward(spark))).collect()
    check(rows)
    assert sum(r.doc_id == 1 for r in rows) == 1 and next(r for r in rows if r.doc_id == 2).length == 1
    assert len([r for r in rows if r.doc_id == 4]) == 2 * len({r.piece for r in rows if r.doc_id == 4})
    assert packing.pack_documents(awkward(spark).limit(0)).count() == 0


def test_what_a_task_freed_goes_back_to_the_system():
    code = """
import re
import numpy as np
from chronoscape.llm.common import give_back

def held():
    return sum(map(int, re.findall("Pss_Anon: +([0-9]+)", open("/proc/self/smaps_rollup").read()))) / 1024

before = held()
parts = [np.ones(12_000, np.uint8) for _ in range(8_000)]
pin = np.ones(12_000, np.uint8)  # lies on top of the heap, so that freeing alone returns nothing
del parts
give_back()
print(held() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)})
    assert float(out.stdout) < 30


def test_known_words_stay_few(monkeypatch):
    monkeypatch.setattr(packing.WordTokenizer, "KEEP", 300)
    monkeypatch.setattr(packing.WordTokenizer, "RECENT", 100)
    encode = packing.WordTokenizer(packing.default_tokenizer())
    for k in range(20):
        text = " ".join(f"w{k * 40 + i}" for i in range(60))
        data = np.frombuffer(text.encode(), np.uint8)
        assert encode(np.array([0, len(data)]), data)[0].tolist() == encode.whole.encode(text, add_special_tokens=False).ids
        assert len(encode.known.key) <= 300 and len(encode.recent.key) <= 160


def test_plain_words_are_judged_together(monkeypatch):
    """A word at a time was matched, decoded and joined; a batch of new words is now matched once, and any other word alone."""
    encode, calls, pattern = packing.WordTokenizer(packing.default_tokenizer()), [], packing.WordTokenizer.PLAIN

    class Counted:
        def fullmatch(self, text):
            calls.append(text)
            return pattern.fullmatch(text)

    monkeypatch.setattr(packing.WordTokenizer, "PLAIN", Counted())
    for text, most in ((" ".join(f"Word{i},it's été{i}" for i in range(300)), 1), ("ΟΔΟΣ Ärger x<|endoftext|> <| I'll ª ﬁ don't 12.5€ a", 10), ("", 0)):
        calls.clear()
        data = np.frombuffer(text.encode(), np.uint8)
        assert encode(np.array([0, len(data)]), data)[0].tolist() == encode.whole.encode(text, add_special_tokens=False).ids
        assert len(calls) <= most
