from __future__ import annotations

import random

import pytest
from conftest import plan_of

from skyfold.dims import BANDS, BANDSETS
from skyfold.operators import light_curves as lc
from skyfold.operators import validation as v
from skyfold.operators.plotdata import plot_series
from skyfold.sources.results import write_csv

CURVES = "name STRING, band STRING, pos BIGINT, time DOUBLE, e_time DOUBLE, flux DOUBLE, e_flux DOUBLE, upperlimit BOOLEAN"


def tables(spark, observations, candidates):
    """``observations`` are ``(name, band, time)``; ``candidates`` maps names to having photometry."""
    rows = [(name, band, pos, float(time), None, 1.0, None, False) for pos, (name, band, time) in enumerate(observations)]
    return v.Tables(
        spark.createDataFrame(list(candidates.items()), "name STRING, has_photometry BOOLEAN"),
        spark.createDataFrame(rows, CURVES),
    )


@pytest.fixture(scope="module")
def crowd(spark):
    rng = random.Random(3)
    names = [f"sn{i}" for i in range(40)]
    observations = [
        (rng.choice(names[:-2]), rng.choice(BANDS), rng.uniform(-30, 30)) for _ in range(3000)
    ]
    return observations, {name: i % 9 != 0 for i, name in enumerate(names)}


def expected_bandset(observations, name, members, minimum):
    for band in members:
        times = [t for n, b, t in observations if n == name and b == band]
        if len({t // 3 for t in times}) < minimum:
            return f"Band [{band}] has only {len(times)} observation(s) (minimum: {minimum})"
    return None


@pytest.mark.parametrize("minimum", [1, 6, 8, 30])
def test_minimum_observations(spark, crowd, minimum):
    observations, candidates = crowd
    check = v.minimum_observations(min_observations=minimum)
    results = {r.name: r for r in check.validate(tables(spark, *crowd)).collect()}
    assert set(results) == set(candidates)
    for name, has_photometry in candidates.items():
        row = results[name]
        if not has_photometry:
            assert (row.is_valid, row.message) == (False, "No photometry data available")
            continue
        messages = {s: expected_bandset(observations, name, m, minimum) for s, m in BANDSETS.items()}
        passed = [s for s, message in messages.items() if message is None]
        assert row.is_valid is bool(passed)
        assert row.available_bandsets == passed
        assert row.message == (None if passed else "\n".join(messages.values()))


def test_all_bands_and_no_bandsets(spark, crowd):
    observations, candidates = crowd
    rows = v.minimum_observations(min_observations=5, all_bands=True).validate(tables(spark, *crowd)).collect()
    for row in rows:
        if candidates[row.name]:
            message = expected_bandset(observations, row.name, BANDS, 5)
            assert (row.is_valid, row.message) == (message is None, message)
    for row in v.minimum_observations(bandsets={}).validate(tables(spark, *crowd)).collect():
        assert not row.is_valid and row.message == ("" if candidates[row.name] else "No photometry data available")


def own_check(name, failing):
    return v.Check(
        name,
        lambda t: t.candidates.selectExpr(
            "name", f"name NOT IN ({failing}) AS is_valid", f"CASE WHEN name IN ({failing}) THEN 'bad' END AS message"
        ),
    )


def test_chained_checks(spark):
    subject = tables(spark, [], dict.fromkeys("abcd", True))
    checks = [own_check("first", "'a', 'b'"), own_check("second", "'a', 'c'"), own_check("third", "'a'")]
    results = v.check_results(subject, checks)
    assert results.count() == 12
    fast = {(r.name, r.check_name) for r in v.check_results(subject, checks, fail_fast=True).collect()}
    assert fast == {("a", "first"), ("b", "first"), ("c", "first"), ("c", "second")} | {
        ("d", name) for name in ("first", "second", "third")
    }
    validity = v.candidate_validity(subject.candidates, results)
    assert {r.name for r in validity.where("is_valid").collect()} == {"d"}
    assert {r.name for r in v.filter_valid(subject.candidates, results).collect()} == {"d"}
    lines = {}
    for row in v.report(results, only_errors=False).orderBy("name", "line_pos").collect():
        lines.setdefault(row.name, []).append(row.line)
    assert lines["d"] == ["### d ###", "Passed."]
    assert lines["a"] == ["### a ###"] + [f"Check failed: [check={c}; message=bad]" for c in ("first", "second", "third")]
    assert {r.name for r in v.report(results).collect()} == {"a", "b", "c"}
    assert tuple(v.valid_ratio(validity).first()) == (1, 4, 25.0)
    assert tuple(v.valid_ratio(validity, 10).first()) == (1, 10, 10.0)


def test_no_checks(spark):
    subject = tables(spark, [], {"a": True})
    assert v.check_results(subject, []).count() == 0
    assert v.filter_valid(subject.candidates, v.check_results(subject, [])).count() == 1
    assert v.candidate_validity(subject.candidates, None).first().is_valid
    assert v.filter_valid(subject.candidates, None).count() == 1


def test_names_with_quotes(spark):
    subject = tables(spark, [("a", "R", 1)], {"a": True})
    check = v.minimum_observations({"R's \\ set": ("R",)}, 1)
    outcome = check.validate(subject)
    assert outcome.first().available_bandsets == ["R's \\ set"]
    assert v.bandset_flags(outcome, ["R's \\ set"]).first()[1] is True


def test_two_checks_share_their_scan(spark, tmp_path):
    """Checks that differ in their minimum only reuse the per-candidate counts."""
    rows = spark.range(20_000).selectExpr(
        "string(id % 50) AS name", "'R' AS band", "id AS pos", "double(id) AS time", "1D AS flux", "1D AS e_flux",
        "false AS upperlimit",
    )
    rows.write.parquet(str(tmp_path / "curves"))
    curves = spark.read.parquet(str(tmp_path / "curves"))
    names = curves.selectExpr("name", "true AS has_photometry").distinct()
    names.write.parquet(str(tmp_path / "names"))
    subject = v.Tables(spark.read.parquet(str(tmp_path / "names")), curves)
    results = v.check_results(
        subject, [v.minimum_observations(min_observations=3), v.minimum_observations(min_observations=5)]
    )
    results.collect()
    assert "ReusedExchange" in plan_of(results) or "Reused" in plan_of(results)


def test_hot_band_is_counted_from_partial_rows(spark):
    """Counting bins collects no set per band, so one band may hold nearly all observations."""
    rows = spark.range(0, 300_000, 1, 8).selectExpr(
        "CASE WHEN id % 50 = 0 THEN string(id) ELSE 'hot' END AS name", "'R' AS band", "id AS pos", "id / 10D AS time"
    )
    statistics = v.band_statistics(rows)
    assert "collect" not in plan_of(statistics) and "Window" not in plan_of(statistics)
    hot = statistics.where("name = 'hot'").first()
    expected = {(i / 10) // 3 for i in range(300_000) if i % 50}
    assert (hot.n_obs, hot.n_bins) == (294_000, len(expected))


def test_select_bands(spark):
    subject = tables(spark, [("a", "R", 1), ("a", "R", 2), ("b", "g", 3)], dict.fromkeys("abc", True))
    rows = lc.select_bands(subject.candidates, subject.light_curves, ("R", "g")).collect()
    assert sorted((r.name, r.band_pos, r.band, r.time) for r in rows if r.pos is not None) == [
        ("a", 0, "R", 1.0), ("a", 0, "R", 2.0), ("b", 1, "g", 3.0),
    ]
    assert sorted((r.name, r.band) for r in rows if r.pos is None) == [
        ("a", "g"), ("b", "R"), ("c", "R"), ("c", "g"),
    ]
    assert lc.select_bands(subject.candidates, subject.light_curves).count() == 3 * 9 + 1
    others = lc.select_bands(subject.candidates.where("name <> 'a'"), subject.light_curves, ("R", "g")).collect()
    assert {r.name for r in others} == {"b", "c"}


def test_band_arrays_are_one_row_per_band(spark):
    subject = tables(spark, [("a", "R", t) for t in range(10, 0, -1)], {"a": True})
    arrays = lc.band_arrays(subject.light_curves)
    assert arrays.count() == 1 and arrays.first().time == [float(t) for t in range(10, 0, -1)]
    parts = lc.band_arrays(subject.light_curves, span=4).orderBy("part").collect()
    assert [p.time for p in parts] == [[10.0, 9.0, 8.0, 7.0], [6.0, 5.0, 4.0, 3.0], [2.0, 1.0]]
    matrix = lc.band_matrix(arrays).first().matrix
    assert len(matrix) == 4 and matrix[2] == [1.0] * 10


def test_candidate_counts(spark):
    subject = tables(spark, [("a", "R", 1), ("a", "g", 2), ("x", "g", 3)], dict.fromkeys("ab", True))
    counts = {r.name: r.n_obs for r in lc.candidate_counts(subject.candidates, subject.light_curves).collect()}
    assert counts == {"a": 2, "b": 0}


def test_plot_series(spark):
    subject = tables(spark, [("a", "R", 1), ("a", "g", 2), ("a", "g_pr", 3)], {"a": True})
    requested = {"one": ("R", "g"), "two": ("g",)}
    rows = sorted((r.bandset, r.series, r.x) for r in plot_series(subject.light_curves, requested).collect())
    assert rows == [("one", "R", 1.0), ("one", "g", 2.0), ("two", "g", 2.0)]


def test_csv(spark, tmp_path):
    flags = spark.createDataFrame([("a,b", True, False, True)], "name STRING, BRI BOOLEAN, gri BOOLEAN, gri_primed BOOLEAN")
    write_csv(flags.coalesce(1), str(tmp_path / "csv"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "csv")).collect()]
    assert lines == ["name,BRI,gri,g'r'i'", '"a,b",True,False,True']
