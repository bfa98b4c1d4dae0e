from __future__ import annotations

import math
import os

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from skyfold.operators.binning import binned_light_curve
from skyfold.operators.growing_bins import add_batch, binned_so_far, compact

CURVES = """
    CASE WHEN id % 3 = 0 THEN 'hot' ELSE string(id % 40) END AS name,
    CASE WHEN id % 2 = 0 THEN 'B' ELSE 'R' END AS band,
    id AS pos,
    CASE WHEN id % 3 = 0 THEN 1D ELSE double(id % 61) END AS time,
    CASE WHEN id % 997 = 0 THEN double('nan') ELSE 1e6D + (id * 7919 % 1009) / 100D END AS flux,
    CASE id % 7 WHEN 0 THEN NULL WHEN 1 THEN 1e-3D WHEN 2 THEN CASE WHEN id % 11 = 0 THEN 0D ELSE 50D END
        ELSE 0.1D + (id % 13) / 20D END AS e_flux,
    id % 5 = 0 OR id % 40 = 1 AS upperlimit"""


def curves(spark, n=20_000):
    return spark.range(0, n, 1, 8).selectExpr("id", f"inline(array(struct({CURVES})))")


def rows_of(bins):
    return {(r.name, r.band, r.bin_id): r for r in bins.collect()}


def assert_same(found, expected):
    assert set(found) == set(expected)
    for key, row in expected.items():
        got = found[key]
        assert (got.n_obs, got.method, got.upperlimit, got.time) == (row.n_obs, row.method, row.upperlimit, row.time)
        for a, b in ((got.flux, row.flux), (got.e_flux, row.e_flux)):
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9)), (key, got, row)


def files_below(path):
    return {
        os.path.join(folder, name): os.stat(os.path.join(folder, name)).st_mtime_ns
        for folder, _, names in os.walk(path)
        for name in names
    }


def test_batches_equal_one_run(spark, tmp_path):
    """Halves, thirds of what is left, a repeated and an empty batch, before and after compaction."""
    path, points = str(tmp_path / "bins"), curves(spark)
    expected = rows_of(binned_light_curve(points))
    parts = ["id % 2 = 0", "id % 2 = 1 AND id < 9000", "id % 2 = 1 AND id >= 9000", "id < 0"]
    for batch, part in enumerate(parts):
        add_batch(points.where(part), path, batch)
        if batch == 1:
            before = files_below(path)
            add_batch(points.where(part), path, batch)
            assert files_below(path) == before
    assert_same(rows_of(binned_so_far(spark, path)), expected)
    compact(spark, path)
    assert_same(rows_of(binned_so_far(spark, path)), expected)
    assert "merged" in os.listdir(tmp_path / "bins" / "width=3.0")
    compact(spark, path)
    more = points.selectExpr("* EXCEPT (pos)", "pos + 1000000 AS pos").where("id < 300")
    add_batch(more, path, 4)
    both = rows_of(binned_light_curve(points.unionByName(more)))
    assert_same(rows_of(binned_so_far(spark, path)), both)
    compact(spark, path)
    assert_same(rows_of(binned_so_far(spark, path)), both)
    with pytest.raises(ValueError, match="comes after the compaction"):
        add_batch(more, path, -1)


def test_untouched_bins_are_not_rewritten(spark, tmp_path):
    path, points = str(tmp_path), curves(spark, 4000)
    add_batch(points, path, 0)
    before = files_below(path)
    new = points.where("name = '7' AND time < 10")
    add_batch(new, path, 1)
    after = files_below(path)
    assert before.items() <= after.items()
    touched = rows_of(binned_so_far(spark, path, touched_by=1))
    everything = rows_of(binned_light_curve(points.unionByName(new)))
    keys = {(r.name, r.band, r.bin_id) for r in rows_of(binned_light_curve(new)).values()}
    assert keys and set(touched) == keys
    assert_same(touched, {key: everything[key] for key in keys})


def test_widths_lie_side_by_side(spark, tmp_path):
    path, points = str(tmp_path), curves(spark, 500)
    for width in (3.0, 30.0):
        add_batch(points, path, 0, width)
    for width in (3.0, 30.0):
        assert_same(rows_of(binned_so_far(spark, path, width)), rows_of(binned_light_curve(points, width)))
    with pytest.raises(ValueError, match="no batch"):
        binned_so_far(spark, path, 7.0)


def test_a_failed_batch_does_not_count(spark, tmp_path):
    path, points = str(tmp_path), curves(spark, 500)
    add_batch(points, path, 0)
    with pytest.raises(Exception, match="broken"):
        add_batch(points.withColumn("flux", F.when(F.col("id") < 400, F.col("flux")).otherwise(F.raise_error(F.lit("broken")))), path, 1)
    assert_same(rows_of(binned_so_far(spark, path)), rows_of(binned_light_curve(points)))


def test_stored_sums_are_reduced_on_the_map_side(spark, tmp_path):
    path = str(tmp_path)
    add_batch(curves(spark, 500), path, 0)
    plan = plan_of(binned_so_far(spark, path))
    assert "Python" not in plan and "CartesianProduct" not in plan and plan.count("- Window") == 1
