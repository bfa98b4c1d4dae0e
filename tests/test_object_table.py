"""The stored table of objects: a lookup reads what may hold the object, and finds it."""

from __future__ import annotations

import json

import pytest

from skyfold.operators.structuring import structure_objects
from skyfold.sources.object_table import read_object, write_objects

ODD = ["", "ä'\"\\ %", "a" * 5000]
N = 6000


def scanned_rows(df):
    """Rows that left the scan in the run of ``df``."""
    rows = df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    assert leaves.size() == 1
    return rows, leaves.head().metrics().apply("numOutputRows").value()


@pytest.fixture(scope="module")
def objects(spark):
    stems = [f"SN{i:05d}" for i in range(N)] + ODD + ["SN00007"]
    text = {"schema": "v1", "sources": [{"alias": "1", "name": "x" * 200}]}
    rows = [(stem, json.dumps({stem: text | {"name": stem}})) for stem in stems] + [("broken", "no json")]
    return structure_objects(spark.createDataFrame(rows, "file_stem string, value string").repartition(8))


@pytest.mark.parametrize("clustered", [True, False])
def test_lookup_reads_few_row_groups(spark, objects, tmp_path, clustered):
    path = str(tmp_path / "objects")
    write_objects(objects, path, clustered, row_group_bytes=40_000)
    assert spark.read.parquet(path).count() == N + 5
    for stem in ("SN03000", *ODD):
        rows, n_scanned = scanned_rows(read_object(spark, path, stem))
        assert [r.file_stem for r in rows] == [stem] and rows[0].name == stem
        assert n_scanned < N / 8
    assert scanned_rows(read_object(spark, path, "SN03000x")) == ([], 0)
    assert [r.reason for r in read_object(spark, path, "broken").collect()] == ["invalid"]
    assert read_object(spark, path, "SN00007").count() == 2


def test_empty_table(spark, objects, tmp_path):
    write_objects(objects.limit(0), str(tmp_path / "none"), True)
    assert read_object(spark, str(tmp_path / "none"), "SN03000").collect() == []


def test_objects_are_structured_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    stems = spark.range(500).selectExpr("string(id) AS file_stem").repartition(4)
    write_objects(stems.mapInArrow(counted, stems.schema), str(tmp_path / "objects"), clustered=True)
    assert spark.read.parquet(str(tmp_path / "objects")).count() == 500 and read.value == 500
