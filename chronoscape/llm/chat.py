"""Minimum-cost role repair of conversations, and their rendering.

Legal turns follow an automaton: an optional system turn, then user and assistant in alternation, ending with the
assistant. Dynamic programming over (turn, last role) finds the cheapest way to make a conversation legal by merging a
turn into the one before, giving it another role, or inserting empty turns; ties take the first action in that list,
then the first role. The time and memory of a conversation grow in proportion to its turns.

A conversation is one result row, so its turns are brought together by conv_id; different conversations never are.

Defined results: turns go by (turn, role, text), nulls first; null text is empty; a role outside the automaton has to
be replaced at `unknown` cost; a repeated turn counts as a turn of its own (and is most often merged); rows without
conv_id form one conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from dataclasses import dataclass
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
START = 3
#: Roles that may follow; the last entry is the start.
NEXT = ((1,), (2,), (1,), (0, 1))
FINAL = (2,)


@dataclass(frozen=True)
class Costs:
    merge: int = 1
    relabel: int = 2
    unknown: int = 1
    insert: int = 3


def _bridges() -> dict[tuple[int, int], tuple[int, ...]]:
    """For each (last role, next role) the shortest run of roles to insert between them."""
    found = {}
    for a in range(4):
        frontier = [((), a)]
        while frontier:
            later = []
            for path, last in frontier:
                for b in NEXT[last]:
                    if (a, b) not in found:
                        found[a, b] = path
                        later.append(((*path, b), b))
            frontier = later
    return found


BRIDGE = _bridges()


def repair(roles: list[str | None], costs: Costs = Costs()) -> tuple[int, list[tuple[str, int, tuple[int, ...]]]]:
    """Cost, and per turn (action, role, roles inserted before it); a last entry ("end", ...) holds inserts at the end."""
    best: dict[int, int] = {START: 0}
    back: list[dict[int, tuple[int, str, tuple[int, ...]]]] = []
    for role in roles:
        now: dict[int, int] = {}
        how: dict[int, tuple[int, str, tuple[int, ...]]] = {}
        known = ROLES.index(role) if role in ROLES else -1
        change = [0 if r == known else costs.unknown if known < 0 else costs.relabel for r in range(3)]
        for last, cost in sorted(best.items()):
            if last != START and (c := cost + costs.merge + change[last]) < now.get(last, 1 << 60):
                now[last], how[last] = c, (last, "merge", ())
        for last, cost in sorted(best.items()):
            for r in range(3):
                if (path := BRIDGE.get((last, r))) is not None and (c := cost + change[r] + costs.insert * len(path)) < now.get(r, 1 << 60):
                    now[r], how[r] = c, (last, "relabel" if change[r] else "keep", path)
        best = now
        back.append(how)
    if not roles:
        return 0, []
    ends = {last: () if last in FINAL else (*BRIDGE[last, FINAL[0]], FINAL[0]) for last in best}
    last = min(sorted(best), key=lambda r: best[r] + costs.insert * len(ends[r]))
    cost = best[last] + costs.insert * len(ends[last])
    plan: list = [("end", last, ends[last])]
    for how in reversed(back):
        before, action, path = how[last]
        plan.append((action, last, path))
        last = before
    return cost, plan[::-1]


def render(turns: list[tuple[str | None, str | None]], costs: Costs = Costs(), template: str = "<|{role}|>\n{text}\n", joiner: str = "\n\n") -> tuple:
    """Cost, merges, relabels, inserts, roles and text of one repaired conversation."""
    cost, plan = repair([r for r, _ in turns], costs)
    out: list[tuple[int, list[str]]] = []
    count = {"merge": 0, "relabel": 0}
    inserted = 0
    for k, (action, role, path) in enumerate(plan):
        out += [(r, [""]) for r in path]
        inserted += len(path)
        if action == "end":
            break
        said, text = turns[k]
        count["relabel"] += (said != ROLES[role])
        if action == "merge":
            count["merge"] += 1
            out[-1][1].append(text or "")
        else:
            out.append((role, [text or ""]))
    text = "".join(template.replace("{role}", ROLES[r]).replace("{text}", joiner.join(parts)) for r, parts in out)
    return cost, count["merge"], count["relabel"], inserted, "".join(ROLES[r][0] for r, _ in out), text


SCHEMA = "conv_id long, n_turns int, cost int, n_merged int, n_relabelled int, n_inserted int, roles string, rendered string"


def format_chats(turns: DataFrame, costs: Costs = Costs(), template: str = "<|{role}|>\n{text}\n") -> DataFrame:
    """One row per conversation of turns (conv_id, turn, role, text)."""

    def run(batches):
        for batch in batches:
            rows = []
            for got in batch.column(1).to_pylist():
                rows.append((len(got), *render([(x["role"], x["text"]) for x in got], costs, template)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int32(),) * 5 + (pa.string(),) * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=[c.split()[0] for c in SCHEMA.split(", ")])

    whole = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return whole.mapInArrow(run, SCHEMA)
