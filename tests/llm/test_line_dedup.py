import random
from collections import defaultdict

import pytest

from helpers import DOCS, awkward, widened

line_dedup = pytest.importorskip("chronoscape.llm.line_dedup")


def brute(rows, min_sites=6, min_chars=2, max_share=0.5):
    sites = defaultdict(set)
    for _, t, _, s, _ in rows:
        for x in (t or "").split("\n"):
            if len(x.strip(" ")) >= min_chars and s is not None:
                sites[x.strip(" ")].add(s)
    bad = {x for x, s in sites.items() if len(s) >= min_sites}
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        counted = [x for x in lines if len(x.strip(" ")) >= min_chars]
        cut = [x for x in counted if x.strip(" ") in bad]
        fair = sum(len(x.strip(" ")) for x in cut) <= max_share * sum(len(x.strip(" ")) for x in counted)
        out.append((i, len(counted), len(cut) if fair else 0, "\n".join(x for x in lines if not (fair and x in cut)) if t is not None else None))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(11)
    shared = [f"notice {k}" for k in range(12)]
    rows = []
    for i in range(300):
        lines = [f"line {rng.randrange(900)} of doc" for _ in range(rng.randrange(6))] + [" " + x for x in shared if rng.random() < 0.05 * (1 + int(x.split()[1]))]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), "en", rng.choice([None, *[f"s{k}" for k in range(9)]]), 0))
    got = line_dedup.remove_lines(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got) == sorted(brute(rows))
    assert any(r.n_removed for r in got)


def test_many_sites_and_copies(spark):
    rows = [(i, f"own line {i} here\nshared by all sites", "en", f"site{i}", 0) for i in range(400)] + [(1000 + i, "a copied text\nwith a second line", "en", f"site{i}", 0) for i in range(50)]
    got = {r.doc_id: r for r in line_dedup.remove_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[3].text == "own line 3 here\nshared by all sites"  # more than half of it
    rows = [(i, f"own line {i} here, and some more of it\nshared by all sites", "en", f"site{i}", 0) for i in range(400)] + rows[400:]
    got = {r.doc_id: r for r in line_dedup.remove_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[3].text == "own line 3 here, and some more of it" and got[1007].n_removed == 0


def test_awkward_rows(spark):
    docs = widened(awkward(spark))
    got = line_dedup.remove_lines(docs).collect()
    assert len(got) == 10 and all(r.n_removed == 0 for r in got) and "piece" in got[0].asDict()
    assert line_dedup.remove_lines(awkward(spark).limit(0)).count() == 0


def test_sites_are_counted_exactly_only_near_the_threshold(spark, monkeypatch):
    """Lines on far fewer or far more sites than the threshold are settled by their sketches."""
    rows = [(i, f"on {n} sites", "en", f"s{k}", 0) for i, (n, k) in enumerate((n, k) for n in (1, 2, 5, 6, 7, 30) for k in range(n))]
    asked = []
    own = line_dedup.sized
    monkeypatch.setattr(line_dedup, "sized", lambda df: (asked.append((df.columns, df.count())), own(df))[1])
    docs = spark.createDataFrame(rows, DOCS)
    found = line_dedup.boilerplate(docs).collect()
    assert len(found) == 3  # on 6, 7 and 30
    assert asked == [(["h1", "h2"], 5), (["h1", "h2"], 1)]  # shared lines; of these, near the threshold
    asked.clear()
    assert line_dedup.boilerplate(docs.where("text != 'on 6 sites'")).count() == 2 and len(asked) == 1
