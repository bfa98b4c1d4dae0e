"""What a streamed ingest costs besides its documents: no file is asked for its age twice, and few tasks list the batches."""

from __future__ import annotations

import json
import os

from skyfold.plans import fixtures, registered
from skyfold.streaming import catalog_stream
from skyfold.streaming.catalog_stream import ingest_stream


def write_documents(path, n):
    path.mkdir()
    for i in range(n):
        document = {f"o{i}": {"name": f"o{i}", "schema": "v1", "sources": [{"alias": 1, "name": "s"}]}}
        (path / f"o{i}.json").write_text(json.dumps(document))
    return str(path)


def test_ages_are_asked_for_once(spark, tmp_path, monkeypatch):
    folder, asked = write_documents(tmp_path / "files", 60), str(tmp_path / "asked")
    plain = catalog_stream.with_status

    def noted(batches):
        for batch in batches:
            with open(asked, "a") as file:
                file.write("".join(f"{name}\n" for name in batch["file_name"].to_pylist()))
            yield batch

    monkeypatch.setattr(catalog_stream, "with_status", lambda names, path: plain(names.mapInArrow(noted, names.schema), path))
    for n in (60, 61):  # at first, and with files registered before
        ingest_stream(spark, folder, str(tmp_path / "objects"), str(tmp_path / "state"), 20)
        with open(asked) as file:
            assert sorted(file.read().split()) == sorted(f"o{i}.json" for i in range(n))
        with open(os.path.join(folder, "o60.json"), "w") as file:
            file.write("broken")
    assert spark.read.parquet(str(tmp_path / "objects")).count() == 61


def listing_tasks(spark, read):
    """The most tasks of a stage of what ``read`` runs."""
    group = f"listing {id(read)}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        read()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [stage for job in tracker.getJobIdsForGroup(group) for stage in tracker.getJobInfo(job).stageIds]
    return max(tracker.getStageInfo(stage).numTasks for stage in stages)


def test_a_task_lists_many_batches(spark, tmp_path):
    path = str(tmp_path / "objects")
    spark.range(120).selectExpr("id", "id AS batch_id").coalesce(1).write.partitionBy("batch_id").parquet(path)
    before = spark.conf.get(catalog_stream.LISTING)
    found = []
    tasks = listing_tasks(spark, lambda: found.append(catalog_stream.read_batches(spark, spark.read, "parquet", path)))
    assert 1 < tasks <= catalog_stream.LISTING_TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert found[0].count() == 120 and spark.conf.get(catalog_stream.LISTING) == before


def test_streamed_queries_list_in_few_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registered, "STREAM_BATCH", 4)
    for name in ("objects", "batches"):
        monkeypatch.setattr(registered, "_catalog_files", lambda *_, path=tmp_path / name: write_documents(path, 160))
        query = registered.QUERIES[f"catalog_stream_{name}"]
        assert listing_tasks(spark, lambda query=query: query(spark, "").count()) <= 4 * spark.sparkContext.defaultParallelism


def test_documents_are_rendered_after_the_exchange(spark, tmp_path):
    """The few tasks that read a compact table do not render all documents."""
    rows = [(i, i % 3, "error", float(i), '{"k": 1}') for i in range(50)]
    events = spark.createDataFrame(rows, "event_id LONG, user_id LONG, event_type STRING, value DOUBLE, props STRING")
    events.selectExpr("*", "timestamp_seconds(event_id) AS ts").write.parquet(str(tmp_path / "events.parquet"))
    texts = fixtures.catalog_texts(spark, str(tmp_path))
    assert texts.count() == 3
    plan = texts._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Exchange hashpartitioning") :]
    assert "props" in below and "AS observation" not in below and "AS claimedtype" not in below
