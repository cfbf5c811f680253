import itertools
import random

import pytest

chat = pytest.importorskip("chronoscape.llm.chat")
R = chat.ROLES


def legal(seq):
    return all(b in chat.NEXT[a] for a, b in zip((chat.START, *seq), seq)) and bool(seq) and seq[-1] in chat.FINAL


def brute(roles, costs):
    """Every way to group turns, to give each group a role and to insert up to two roles before it and at the end."""
    n, least = len(roles), 1 << 30
    runs = [p for k in range(3) for p in itertools.product(range(3), repeat=k)]
    for cuts in itertools.product((0, 1), repeat=n - 1):
        groups = [0]
        for c in cuts:
            groups.append(groups[-1] + c)
        for named in itertools.product(range(3), repeat=groups[-1] + 1):
            base = costs.merge * (n - 1 - groups[-1]) + sum((costs.unknown if r not in R else costs.relabel) * (r != R[named[g]]) for r, g in zip(roles, groups))
            if base >= least:
                continue
            for ins in itertools.product(runs, repeat=len(named) + 1):
                cost = base + costs.insert * sum(map(len, ins))
                if cost < least and legal([x for i, r in enumerate(named) for x in (*ins[i], r)] + list(ins[-1])):
                    least = cost
    return least


def test_cost_is_the_least_possible():
    rng = random.Random(9)
    for costs in (chat.Costs(), chat.Costs(merge=3, relabel=1, unknown=2, insert=1)):
        for _ in range(12):
            roles = [rng.choice([*R, "tool", None]) for _ in range(rng.randrange(1, 4))]
            assert chat.repair(roles, costs)[0] == brute(roles, costs), roles


def test_rendered_turns_are_legal(spark):
    rng = random.Random(10)
    rows = [(c, t, rng.choice([*R, "bot"]), f"{c}.{t}") for c in range(40) for t in range(rng.randrange(1, 12))]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 40
    for r in got:
        assert legal([{"s": 0, "u": 1, "a": 2}[x] for x in r.roles])
        own = [t for c, _, _, t in rows if c == r.conv_id]
        at = [r.rendered.index(t) for t in own]
        assert at == sorted(at) and r.n_turns == len(own)


def test_awkward_rows(spark):
    rows = [(1, 0, "user", "q"), (1, 0, "user", "q"), (1, 1, "assistant", None), (2, None, None, None), (None, 3, "assistant", ""), (3, 0, "user", "x" * 300_000)] + [(4, i, "user", "y") for i in range(3000)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS turns", "2 AS cost")
    got = {r.conv_id: r for r in chat.format_chats(docs).collect()}
    assert got[1].n_merged == 1 and got[1].roles == "ua" and got[2].roles == "ua" and got[3].n_inserted == 1 and got[4].n_turns == 3000
    assert chat.format_chats(docs.limit(0)).count() == 0
