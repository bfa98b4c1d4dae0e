from __future__ import annotations

import json

import pytest
from pyspark.errors import AnalysisException

from conftest import plan_of
from skyfold.operators.logs import filter_lines, message_text, number_lines
from skyfold.sources.logs import read_log_lines, write_collection


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "logs"
    (path / "filtered").mkdir(parents=True)
    for f in range(3):
        lines = [json.dumps({"text": f"{'Error' if i % 3 else 'error'} {f}-{i}"}) for i in range(5000)]
        (path / f"{f}.log").write_text("\n".join(lines) + "\n")
    (path / "day=1").mkdir()
    (path / "day=1" / "0.log").write_text('{"text": "error"}\n')
    (path / "filtered" / "old.log").write_text('{"text": "error"}\n')
    return str(path)


def expected(keyword):
    texts = [f"{'Error' if i % 3 else 'error'} {f}-{i}" for f in range(3) for i in range(5000)]
    return [text for text in texts if keyword in text]


def test_filters(spark, folder):
    lines = read_log_lines(spark, folder)
    assert lines.count() == 15_000
    assert filter_lines(lines, "error").count() == len(expected("error"))
    assert filter_lines(lines, "error", negate=True).count() == 15_000 - len(expected("error"))
    assert read_log_lines(spark, f"{folder}/0.log").count() == 5000
    with pytest.raises(AnalysisException):
        read_log_lines(spark, f"{folder}/missing")


@pytest.mark.parametrize("split_bytes", [8_000, 50_000, 128_000_000])
def test_numbering_follows_files_and_lines(spark, folder, split_bytes):
    """Numbers are the same however the files are split and packed into tasks."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        numbered = filter_lines(read_log_lines(spark, folder), "error").transform(number_lines).transform(message_text)
        rows = sorted((r.number, r.text) for r in numbered.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert rows == list(enumerate(expected("error"), start=1))


def test_text_of_other_lines(spark):
    lines = spark.createDataFrame([('{"a": 1}',), ("plain",)], "value STRING")
    assert [r.text for r in message_text(lines).collect()] == [None, None]


def test_collections(spark, folder, tmp_path):
    path = str(tmp_path / "collections")
    lines = read_log_lines(spark, folder)
    assert write_collection(filter_lines(lines, "error 0"), "lower", path)
    assert write_collection(filter_lines(lines, "Error"), "upper", path)
    assert write_collection(filter_lines(lines, "error"), "lower", path)
    saved = spark.read.json(path)
    found = {r.collection: r["count"] for r in saved.groupBy("collection").count().collect()}
    assert found == {"lower": len(expected("error")), "upper": len(expected("Error"))}
    first = saved.where("collection = 'lower' AND number = 1").first()
    assert (json.loads(first.record), first.text) == ({"text": "error 0-0"}, "error 0-0")
    with pytest.warns(UserWarning):
        assert not write_collection(filter_lines(lines, "absent"), "none", path)
    assert spark.read.json(path).where("collection = 'none'").count() == 0


def test_numbering_leaves_lines_in_place(spark, folder, tmp_path):
    """Many small files, and a plan without an exchange of the text even where Spark would broadcast nothing."""
    for f in range(60):
        (tmp_path / f"{f:02}.log").write_text("".join(f'{{"text": "{f}-{i}"}}\n' for i in range(3)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        numbered = number_lines(read_log_lines(spark, str(tmp_path)))
        rows = [json.loads(r.value)["text"] for r in numbered.orderBy("number").collect()]
        plan = plan_of(numbered)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == [f"{f}-{i}" for f in range(60) for i in range(3)]
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_no_line_is_lost_when_splits_change_between_building_and_running(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f'{{"text": "{i}"}}\n' for i in range(300_000)))
    spark.conf.set("spark.sql.files.minPartitionNum", "5")
    try:
        numbered = number_lines(read_log_lines(spark, str(tmp_path))).transform(message_text)
        spark.conf.set("spark.sql.files.minPartitionNum", "13")
        assert numbered.where("number = text + 1").count() == numbered.count() == 300_000
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
