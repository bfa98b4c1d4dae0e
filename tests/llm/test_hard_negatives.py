"""Hard negatives against brute force; Strassen products against plain ones."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyfold.llm import hard_negatives as hn

COLUMNS = "vec_id LONG, label INT, embedding ARRAY<FLOAT>, key STRING, anchor STRING, tile STRING, score STRING, place STRING, rank STRING"


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 40), st.integers(0, 40), st.integers(0, 40), st.integers(1, 8), st.integers(0, 2**32 - 1))
def test_strassen_is_the_product(rows, inner, columns, leaf, seed):
    rng = np.random.default_rng(seed)
    # Any 64-bit integers: both sides are the product modulo 2**64.
    a, b = (rng.integers(-(2**63), 2**63 - 1, shape) for shape in ((rows, inner), (inner, columns)))
    assert (hn.strassen(a, b, leaf) == a @ b).all()


def brute_force(rows, percent=80, most=5):
    """Rows of (identifier, label, vector); every row with its place."""
    kept = [
        (i, vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vector])
        for i, (vec_id, label, vector) in enumerate(rows)
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector)
    ]
    found = []
    for anchor in kept:
        if anchor[1] is None or anchor[1] % 100:
            continue
        others = [(sum(x * y for x, y in zip(anchor[3], row[3], strict=False)), row) for row in kept if row[0] != anchor[0]]
        others.sort(key=lambda o: (-o[0], o[1][1] is None, o[1][1] or 0, o[1][0]))
        for score, positive in [o for o in others if o[1][2] == anchor[2]][:most]:
            fitting = [o for o in others if o[1][2] != anchor[2] and percent * score <= 100 * o[0] <= 100 * score][:most]
            found += [(anchor[1], positive[1], rank, row[1], score, s) for rank, (s, row) in enumerate(fitting, 1)]
    return sorted(found, key=str)


def mined(spark, rows, **options):
    frame = spark.createDataFrame([(*row, *["x"] * 6) for row in rows], COLUMNS).coalesce(1)
    return sorted((tuple(r) for r in hn.hard_negatives(frame, **options).collect()), key=str)


def table(seed, n=260, labels=3, width=6, grain=0.125):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        vector = [round(rng.gauss(0.1, 0.4) / grain) * grain for _ in range(width)]  # coarse: many ties
        # One label holds a third of the rows and more, one vector many of them.
        rows.append((i, rng.choice([0] * labels + list(range(labels))), rows[0][2] if rows and rng.random() < 0.2 else vector))
    return rows


@pytest.mark.parametrize("sizes", [(1024, 2048, 4), (2, 16, 3), (1, 3, 1)])
def test_tiles_of_any_size_give_the_same(spark, monkeypatch, sizes):
    for name, value in zip(("ANCHOR_ROWS", "CANDIDATE_ROWS", "GROUP_TILES"), sizes, strict=True):
        monkeypatch.setattr(hn, name, value)
    rows = table(sum(sizes))
    expected = brute_force(rows)
    assert expected and mined(spark, rows) == expected


def test_defined_cases(spark):
    rows = table(5, n=120)
    rows += [(None, 0, rows[1][2]), (200, None, rows[1][2]), (300, 1, None), (400, 0, [1.0, None]), (500, 0, [float("nan")]), (600, 0, [float("inf")])]
    rows += [(700, 0, [0.5, 0.25]), (700, 1, []), (800, 2, [0.5] * 9), rows[0], rows[0], (0, 2, rows[0][2])]
    assert mined(spark, rows) == brute_force(rows)
    assert mined(spark, []) == [] and mined(spark, [(None, None, None)]) == []
    assert mined(spark, [(100, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [-1.0])]) == []  # the positive's score is negative


def test_large_components(spark):
    rows = [(0, 1, [2.0**20, -3.0]), (1, 1, [2.0**18, 5.0]), (2, 2, [2.0**18 - 1, 0.0]), (3, 2, [2.0**17, 0.0])]
    assert mined(spark, rows) == brute_force(rows) != []


def test_other_windows(spark):
    rows = table(9, n=150)
    assert mined(spark, rows, percent=33, n_positives=2, n_negatives=2) == brute_force(rows, 33, 2)
