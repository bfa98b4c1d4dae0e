"""Folders of many files: the driver keeps no path, and small batches share a micro-batch."""

from __future__ import annotations

import json

import pytest

from skyfold.sources import catalog, listing
from skyfold.streaming import catalog_stream
from skyfold.streaming.catalog_stream import ingest_object_batches, ingest_stream

N = 150


def document(stem):
    return json.dumps({stem: {"name": stem, "schema": "v1", "sources": [{"alias": 1, "name": "s"}]}})


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "files"
    path.mkdir()
    for i in range(N):
        (path / f"o{i}.json").write_text(document(f"o{i}") if i % 10 else "broken")
    return path


def test_the_driver_keeps_no_path(spark, folder):
    for frame in (catalog.read_texts(spark, str(folder)), catalog.list_files(spark, str(folder))):
        assert frame.count() == N
        assert len(frame.inputFiles()) == 1


def test_contents_are_handed_over_in_parts(spark, folder, monkeypatch):
    (folder / "bytes.json").write_bytes(b"\xef\xbb\xbf\xff\x00\r\n")
    (folder / "empty.json").write_bytes(b"")
    monkeypatch.setattr(listing, "BATCH_BYTES", 100)
    names = listing.list_names(spark, str(folder), ".json").coalesce(1)
    found = {r.file_name: bytes(r.content) for r in listing.with_contents(names, str(folder)).collect()}
    assert found == {path.name: path.read_bytes() for path in folder.iterdir()}
    sizes = {r.file_name: r.n_bytes for r in listing.with_status(names, str(folder)).collect()}
    assert sizes == {name: len(content) for name, content in found.items()}


def sizes(spark, path, column):
    return {r[column]: r["count"] for r in spark.read.parquet(path).groupBy(column).count().collect()}


def test_small_batches_share_a_micro_batch(spark, folder, tmp_path):
    objects, state = str(tmp_path / "objects"), str(tmp_path / "state")
    ingest_stream(spark, str(folder), objects, state, 4)
    assert sizes(spark, objects, "batch_id") == {i: 4 for i in range(37)} | {37: 2}
    assert len(list((tmp_path / "state").glob("*/commits/[0-9]*"))) == 1
    (folder / "late.json").write_text(document("late"))
    ingest_stream(spark, str(folder), objects, state, 4)
    assert sizes(spark, objects, "batch_id") == {i: 4 for i in range(37)} | {37: 2, 38: 1}


def test_batches_over_several_micro_batches(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog_stream, "FILES_PER_TRIGGER", 50)
    objects, counts, state = (str(tmp_path / name) for name in ("objects", "counts", "state"))
    ingest_object_batches(spark, str(folder), objects, counts, state, 20)
    assert len(list((tmp_path / "counts").glob("batch_id=*"))) == 4
    assert sizes(spark, objects, "batch_id") == {i: 20 for i in range(7)} | {7: 10}
    assert sizes(spark, objects, "object_batch") == {None: 15} | {i: 20 for i in range(6)} | {6: 15}
