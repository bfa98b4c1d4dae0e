from __future__ import annotations

import math
import random

import numpy as np
import pytest
from brute_binning import binned
from conftest import plan_of
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyfold.functions.timebins import bin_centre, bin_id
from skyfold.operators.binning import bin_statistics, binned_light_curve

SCHEMA = "name STRING, band STRING, pos BIGINT, time DOUBLE, flux DOUBLE, e_flux DOUBLE, upperlimit BOOLEAN"


def close(actual, expected, scale=1.0):
    if expected is None or actual is None:
        return actual is None and expected is None
    return math.isclose(actual, expected, rel_tol=1e-9, abs_tol=1e-9 * scale)


def check(spark, curves, width=3.0):
    """``curves`` maps an object to its points; every bin of every object must match the restatement."""
    rows = [(name, "B", *point) for name, points in curves.items() for point in points]
    actual = {}
    for row in binned_light_curve(spark.createDataFrame(rows, SCHEMA), width).collect():
        actual.setdefault(row.name, {})[row.bin_id] = (row.flux, row.e_flux, row.upperlimit)
    for name, points in curves.items():
        expected = binned(points, width)
        assert set(actual[name]) == set(expected)
        for index, (flux, error, limit) in expected.items():
            got = actual[name][index]
            members = [p[2] for p in points if int(p[1] // width) == index]
            # An error far below the rounding of the fluxes themselves is not determined by them.
            scale = 1e-6 * max(abs(x) for x in members)
            assert close(got[0], flux) and close(got[1], error, scale) and got[2] == limit, (name, index, got, points)


fluxes = st.one_of(st.sampled_from([1.0, 2.0, 2.5]), st.floats(1e-3, 1e3))
errors = st.one_of(st.none(), st.just(math.nan), st.just(0.0), st.floats(1e-4, 1e4), st.sampled_from([0.1, 0.2]))
points = st.lists(st.tuples(st.floats(-20, 20), fluxes, errors, st.booleans()), min_size=1, max_size=12)


@settings(
    max_examples=8,
    deadline=None,
    derandomize=True,
    phases=[Phase.generate],
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(st.lists(points, min_size=1, max_size=30))
def test_matches_restatement(spark, bands):
    check(spark, {str(i): [(pos, *p) for pos, p in enumerate(band)] for i, band in enumerate(bands)})


@pytest.mark.parametrize("spread", [1.0, 1e-3, 1e-6])
@pytest.mark.parametrize("error_range", [0.0, 1.0, 4.0])
def test_precision(spark, spread, error_range):
    """Nearly equal fluxes and errors over many orders of magnitude keep the scatter exact."""
    rng = random.Random(7)
    curve = [
        (i, rng.random() * 2.9, 1000.0 * (1 + spread * rng.gauss(0, 1)), 10 ** rng.uniform(-error_range, error_range), False)
        for i in range(3000)
    ]
    check(spark, {"x": curve})


def test_constant_flux_has_no_scatter(spark):
    rows = [("x", "B", i, 0.5, 0.1, 1e-9 * (1 + i % 7), False) for i in range(2000)]
    row = bin_statistics(spark.createDataFrame(rows, SCHEMA).repartition(8)).first()
    assert row.weighted_mean == pytest.approx(0.1, rel=1e-12)
    assert row.sigma < 1e-15


def test_first_of_equal_upper_limits(spark):
    rows = [("x", "B", pos, 1.0, 5.0, e, True) for pos, e in [(9, 0.9), (2, 0.2), (4, None)]]
    rows += [("y", "B", pos, 1.0, 5.0, e, True) for pos, e in [(9, 0.9), (2, None), (4, 0.4)]]
    result = {r.name: r for r in binned_light_curve(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (result["x"].flux, result["x"].e_flux, result["x"].upperlimit) == (5.0, 0.2, True)
    assert result["y"].e_flux is None


def test_edge_cases(spark):
    nan, inf = math.nan, math.inf
    rows = [
        ("limit errors only", "B", 0, 1.0, 4.0, 0.1, True),
        ("limit errors only", "B", 1, 1.0, 6.0, None, False),
        ("zero error", "B", 0, 1.0, 4.0, 0.0, False),
        ("zero error", "B", 1, 1.0, 6.0, 0.1, False),
        ("single zero error", "B", 0, 1.0, 4.0, 0.0, False),
        ("infinite error", "B", 0, 1.0, 4.0, inf, False),
        ("tiny error", "B", 0, 1.0, 4.0, 1e-200, False),
        ("tiny error", "B", 1, 1.0, 4.0, 1e-200, False),
        ("huge error", "B", 0, 1.0, 4.0, 1e200, False),
        ("huge error", "B", 1, 1.0, 4.0, 1e200, False),
        ("no flag", "B", 0, 1.0, 4.0, 0.5, None),
        ("not finite", "B", 0, nan, 4.0, 0.5, False),
        ("not finite", "B", 1, inf, 4.0, 0.5, False),
        ("no finite flux", "B", 0, 1.0, nan, 0.5, False),
        ("infinite limit", "B", 0, 1.0, inf, 0.5, True),
        ("one infinite flux", "B", 0, 1.0, 4.0, 0.5, False),
        ("one infinite flux", "B", 1, 2.0, -inf, 0.5, False),
        ("far away", "B", 0, 1e300, 4.0, 0.5, False),
    ]
    result = {
        r.name: (r.flux, r.e_flux, r.upperlimit, r.method)
        for r in binned_light_curve(spark.createDataFrame(rows, SCHEMA)).collect()
    }
    assert result == {
        "limit errors only": (6.0, None, False, "plain mean"),
        "no finite flux": (None, None, False, "single"),
        "infinite limit": (None, None, True, "upper limit"),
        "one infinite flux": (None, None, False, "weighted"),
        "far away": (4.0, 0.5, False, "single"),
        "zero error": (None, None, False, "weighted"),
        "single zero error": (4.0, 0.0, False, "single"),
        "infinite error": (4.0, None, False, "plain mean"),
        "tiny error": (None, None, False, "weighted"),
        "huge error": (None, None, False, "weighted"),
        "no flag": (4.0, 0.5, False, "single"),
    }


@pytest.mark.parametrize("width", [3.0, 30.0, 0.1, 0.7, 2.5])
def test_bin_index_equals_floor_division(spark, width):
    times = [k * width + d for k in range(-50, 2000) for d in (0.0, 1e-9, width / 2)] + list(np.linspace(5e4, 6e4, 5000))
    frame = spark.createDataFrame([(float(t),) for t in times], "time DOUBLE")
    rows = frame.selectExpr("time", f"{bin_id('time', width)} AS k", f"{bin_centre(bin_id('time', width), width)} AS c")
    for row in rows.collect():
        assert row.k == np.float64(row.time) // width
        assert row.c == row.k * width + width / 2


def test_hot_bin_is_combined_before_the_shuffle(spark):
    """A bin holding nearly all rows leaves every map task as a handful of partial rows."""
    rows = spark.range(0, 400_000, 1, 8).selectExpr(
        "CASE WHEN id % 100 = 0 THEN string(id) ELSE 'hot' END AS name",
        "'B' AS band",
        "id AS pos",
        "1.0D AS time",
        "10D + (id % 17) / 100D AS flux",
        "0.1D + (id % 5) / 100D AS e_flux",
        "id < 0 AS upperlimit",
    )
    bins = binned_light_curve(rows)
    plan = plan_of(bins)
    assert "ObjectHashAggregate" not in plan and "Python" not in plan
    # Only the branch of upper limits keeps a structure per bin and is sorted for it.
    sorted_ones = [line for line in plan.split("\n") if "SortAggregate" in line]
    assert sorted_ones and all("min(struct(" in line for line in sorted_ones)
    assert plan.count("Exchange hashpartitioning") == 4 and plan.count("- Window") == 1
    hot = bins.where(F.col("name") == "hot").first()
    ids = np.array([i for i in range(400_000) if i % 100])
    flux, error = 10 + (ids % 17) / 100, 0.1 + (ids % 5) / 100
    weight = 1 / error**2
    mean = np.average(flux, weights=weight)
    sigma = np.sqrt(np.sum(weight * (flux - mean) ** 2) / weight.sum() / (len(ids) - 1))
    typical = 1 / np.sqrt(weight.sum())
    assert hot.flux == pytest.approx(mean, rel=1e-12)
    assert hot.e_flux == pytest.approx((sigma + typical) / 2 if typical > sigma else sigma, rel=1e-9)
    assert hot.n_obs == len(ids)


def test_hot_bin_of_upper_limits(spark):
    """Distinct upper limits of one bin are spread over the tasks and reduced to one row per task."""
    rows = spark.range(0, 200_000, 1, 8).selectExpr(
        "'hot' AS name", "'B' AS band", "id AS pos", "1.0D AS time", "double(200000 - id % 100000) AS flux",
        "double(id) AS e_flux", "true AS upperlimit",
    )
    row = binned_light_curve(rows).first()
    assert (row.flux, row.e_flux, row.upperlimit, row.n_obs) == (100_001.0, 99_999.0, True, 200_000)
