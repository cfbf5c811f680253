import hashlib
import random
import re

import pytest

from helpers import awkward, frame, widened

secret_scan = pytest.importorskip("chronoscape.llm.secret_scan")

A = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
PATTERNS = (("assign", A, lambda m: len(m[2]) >= 12), ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16))


def brute(text):
    found = sorted((m.start(), k, m.end(), n) for k, (n, p, ok) in enumerate(PATTERNS) for m in p.finditer(text or "") if ok(m))
    return [f"{n}:{s}:{e}" for s, _, e, n in found]


TEXTS = [
    "password=abcdefghijkl and token: 'short' é😀 secret = \"0123456789abcdef0123\"", "AKIA12345678901234 AKIA123 AKIAAKIA1234567890", "deadbeefdeadbeef deadbeef", "token=secret=abcdefghijklmnop",
    "token: secret: abcdefghijklmnop", "API_KEY:abcdefghijklmnopqrstuvwxyz apikey = x" * 3, None, "", "é" * 50 + "PassWord  :  'aaaaaaaaaaaaaaaa'", "paſſword=abcdefghijklmnop",
    "login=alice pwd=hunter22 at ssh://db.example.org/x", "pwd=hunter22 alone", "user: bob alone", "https://example.org/page alone", "user=carol " + "x " * 300 + "pwd=hunter22",
]


def test_base_equals_brute_force(spark):
    docs = frame(spark, TEXTS)
    got = {r.doc_id: r for r in secret_scan.digest(secret_scan.scan(docs)).collect()}
    for i, t in enumerate(TEXTS):
        want = brute(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (t, got[i])
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(w.startswith(n) for w in want) for n in ("assign", "access", "hex"))


def test_weak_parts_need_complements(spark):
    got = {r.doc_id: r.spans for r in secret_scan.digest(secret_scan.scan(frame(spark, TEXTS))).collect()}
    assert [x.split(":")[0] for x in got[10].split(",")] == ["identifier", "secret", "endpoint"]
    assert got[11] == got[12] == got[13] == got[14] == ""


def test_rows_without_id_are_linked(spark):
    docs = frame(spark, TEXTS[10:15]).selectExpr("CAST(NULL AS LONG) AS doc_id", "text")
    got = sorted(r.spans for r in secret_scan.digest(secret_scan.scan(docs)).collect())
    assert got[:4] == [""] * 4 and [x.split(":")[0] for x in got[4].split(",")] == ["identifier", "secret", "endpoint"]


def test_weak_parts_equal_brute_force(spark):
    rng = random.Random(101)
    bits = ["login=alice", "user_id: 'bob.smith'", "account=" + "x" * 90, "pwd=hunter22", "auth: abcdefgh", "https://db.example.org/x", "redis://h:1/0", "password=abcdefghijkl", "AKIA12345678901234", "deadbeefdeadbeef", "é😀"]
    texts = [" ".join(rng.choice(bits) if rng.random() < 0.2 else "w" * rng.randrange(1, 40) for _ in range(rng.randrange(60))) for _ in range(60)]
    identifier = re.compile(r"""(?ai:user(?:name|_id)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""")
    secret = re.compile(r"""(?ai:pwd|passphrase|credential|auth|private_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})""")
    endpoint = re.compile(r"(?ai:https?|ftp|ssh|jdbc|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]{4,}")
    got = {r.doc_id: r.spans for r in secret_scan.digest(secret_scan.scan(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        parts = [(m.start(), k, m.end(), n, n in ("assign", "hex") and "s" or "i") for k, (n, p, ok) in enumerate(PATTERNS) for m in p.finditer(t) if ok(m)]
        parts += [(m.start(), k, m.end(), n, n[0]) for k, n, p in ((3, "identifier", identifier), (4, "secret", secret), (5, "endpoint", endpoint)) for m in p.finditer(t)]
        want = []
        for s, k, e, n, role in sorted(parts):
            near = {r for s2, _, _, _, r in parts if abs(s2 - s) <= 200} - {role}
            if k < 3 or (near if role == "s" else "s" in near if role == "i" else near == {"s", "i"}):
                want.append(f"{n}:{s}:{e}")
        assert got[i] == ",".join(want), t


def test_time_grows_with_the_hits(spark):
    text = "password=abcdefghijkl " * 20_000
    got = secret_scan.digest(secret_scan.scan(frame(spark, [text, None]))).collect()
    assert sorted((r.doc_id, r.n_assign) for r in got) == [(0, 20_000), (1, 0)] and got[0].spans.count(",") in (0, 19_999)


def test_rows_of_one_id_keep_their_own_spans(spark):
    rows = [(1, "login=alice pwd=hunter22 at ssh://db.example.org/x"), (1, "nothing to hide in this row"), (None, "password=abcdefghijkl"), (None, "clean"), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(r.text for r in secret_scan.redact(docs, secret_scan.scan(docs)).collect())
    assert out == sorted(["[identifier] [secret] at [endpoint]", "nothing to hide in this row", "[assign]", "clean", ""])


def test_redaction_and_awkward_rows(spark):
    docs = frame(spark, TEXTS)
    out = {r.doc_id: r.text for r in secret_scan.redact(docs, secret_scan.scan(docs)).collect()}
    assert "hunter22" not in out[10] and "hunter22" in out[11] and out[8].startswith("é" * 50 + "[assign]")
    rows = secret_scan.digest(secret_scan.scan(widened(awkward(spark)))).collect()
    assert len(rows) == 10 and all(r.spans == ("hex:0:5000" if r.doc_id == 7 else "") for r in rows)
    assert secret_scan.scan(awkward(spark).limit(0)).count() == 0
