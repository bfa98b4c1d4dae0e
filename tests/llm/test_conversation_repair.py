"""Repair of conversations against a search over all edits."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyfold.llm import conversation_repair as cr

COLUMNS = "conv_id LONG, turn LONG, role STRING, text STRING, part STRING, number STRING, symbols STRING, row STRING, id STRING, cost STRING"
SOLID = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """Cost, letters and lines for ``role, text, deleted, truncated`` rows: the least over all paths, one per output."""
    # The initials put so far decide what may follow; a path is kept per last initial only.
    best = {"": (0, "", ())}

    def inserted(paths):
        for _ in range(2):
            for last, (cost, letters, lines) in list(paths.items()):
                role = "assistant" if last == "u" else "user"
                new = (cost + 2, letters + "I", (*lines, role + ":"))
                if role[0] not in paths or new < paths[role[0]]:
                    paths[role[0]] = new
        return paths

    for role, text, deleted, truncated in rows:
        after = {}

        def offer(last, path, after=after):
            if last not in after or path < after[last]:
                after[last] = path

        for last, (cost, letters, lines) in inserted(best).items():
            offer(last, (cost + 3, letters + "D", lines))
            if deleted:
                continue
            due = "a" if last == "u" else "u"
            if role[:1] == due or (role[:1] == "s" and last == ""):
                offer(role[:1], (cost + truncated, letters + "K", (*lines, f"{role}:{text}")))
            name = {"a": "assistant", "u": "user"}[due]
            offer(due, (cost + 2 + truncated, letters + "R", (*lines, f"{name}:{text}")))
        best = after
    return min(path for last, path in inserted(best).items() if last in ("", "a"))


def brute_force(rows):
    """Results by conversation of ``conv_id, turn, role, text`` rows."""
    out = set()
    for conv_id in {row[0] for row in rows}:
        own = sorted(
            [(row[1] is not None, row[1] or 0, " " if row[2] is None else row[2], " " if row[3] is None else row[3]) for row in rows if row[0] == conv_id]
        )
        seen, judged, counts = set(), [], [0, 0, 0]
        for *_, role, text in own:
            solid = SOLID.findall(text)
            faults = [not solid, (role, text) in seen, not solid or solid[-1] not in ".!?"]
            seen.add((role, text))
            if any(faults):
                counts[faults.index(True)] += 1
            judged.append((role, text, faults[0] or faults[1], int(faults[2])))
        turns = {row[1] for row in own if row[0]}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [row[2][:1] for row in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, letters, lines = cheapest(judged)
        out.add((conv_id, gaps, *counts, illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


TEXTS = ["Yes.", "No?", "Well", "", " \n", "so so! \t", "é.", "a\nb", None]
ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "unknown"]


def conversations(seed, n=40, most=14):
    rng = random.Random(seed)
    rows = []
    for conv_id in [*range(n), None]:
        for turn in range(rng.randint(1, most)):
            if rng.random() < 0.9:
                place = rng.choice([turn, turn, turn, turn + 20, None, -turn])
                role = ["user", "assistant"][turn % 2] if rng.random() < 0.5 else rng.choice(ROLES)
                rows.append((conv_id, place, role, rng.choice(TEXTS) if rng.random() < 0.4 else f"text {rng.randrange(50)}."))
    return rows


def found(spark, rows, identifiers=None):
    frame = spark.createDataFrame([(*row, *["x"] * 6) for row in rows], COLUMNS).repartition(3)
    result = cr.repair_conversations(frame, identifiers).collect()
    assert len(result) == len({r.conv_id for r in result})
    return {tuple(r) for r in result}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ""]), st.booleans(), st.booleans()), max_size=17), st.integers(1, 5))
def test_traces_are_cheapest_and_least(rows, block):
    known = cr.tables(block)
    symbols = bytes(cr.symbol_of(role, deleted, truncated) for role, deleted, truncated in rows)
    letters, state = known.traced(symbols, 0, 0)
    closing = cr.closing_letters(state)
    lines = tuple(cr.repaired_lines(letters, [row[0] for row in rows], ["t"] * len(rows), 0, closing))
    (vectors, costs) = known.boundaries(symbols, cr.np.zeros(1, int))
    cost = int(costs[0]) + known.vectors[int(vectors[0][0])][0]
    expected = cheapest([(role, "t", deleted, int(truncated)) for role, deleted, truncated in rows])
    assert (cost, "".join(letters) + closing, lines) == expected
    assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))


def test_conversations_equal_brute_force(spark):
    rows = conversations(1)
    assert found(spark, rows) == brute_force(rows)


@pytest.mark.parametrize("limits", [(3, 10**9, 4, 10**9), (0, 10**9, 1, 10**9), (50, 60, 5, 20)])
def test_long_conversations_are_composed_of_chunks(spark, monkeypatch, limits):
    for name, value in zip(("LONG_ROWS", "LONG_BYTES", "CHUNK_ROWS", "CHUNK_BYTES"), limits, strict=True):
        monkeypatch.setattr(cr, name, value)
    rows = conversations(sum(limits[:3]), 12, 30)
    rows += [(7, i, ["user", "assistant"][i % 2], f"row {i % 60}." if i % 7 else "and") for i in range(400)]  # most of all rows
    assert found(spark, rows) == brute_force(rows)


def test_defined_cases(spark):
    rows = [(1, None, None, None), (2, 1, "user", "Hi."), (2, 1, "user", "Hi."), (3, 5, "system", "Be good."), (None, 1, "assistant", "x" * 2_000_000)]
    identifiers = spark.createDataFrame([(1,), (2,), (2,), (4,), (None,), (3,)], "conv_id LONG")
    nothing = (4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found(spark, rows, identifiers) == brute_force(rows) | {nothing}
    assert found(spark, []) == set()
    assert found(spark, [], identifiers.where("conv_id = 4")) == {nothing}


def test_only_a_few_vectors_exist():
    assert len(cr.tables().vectors) < 32 and cr.tables().block_before.shape[1] == cr.SYMBOLS**cr.BLOCK
