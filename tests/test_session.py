from __future__ import annotations

from types import SimpleNamespace

import pytest

from skyfold.session import scratch_dir, written_table


class Conf(dict):
    def set(self, key, value):
        self[key] = value


def test_scratch_needs_a_shared_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        scratch_dir(SimpleNamespace(conf=Conf({"spark.master": "yarn"})))
    with pytest.raises(RuntimeError):
        scratch_dir(SimpleNamespace(conf=Conf({"spark.master": "local-cluster[2,1,1024]"})))
    shared = Conf({"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://store/tmp/", "spark.app.id": "app-1"})
    assert scratch_dir(SimpleNamespace(conf=shared)).startswith("hdfs://store/tmp/skyfold-app-1/")


def test_written_table_keeps_schema_and_rows(spark):
    frame = spark.createDataFrame([(1, None), (2, "b")], "a INT, b STRING")
    again = written_table(frame)
    assert again.schema == frame.schema and sorted(map(tuple, again.collect())) == [(1, None), (2, "b")]
    assert written_table(frame.limit(0)).count() == 0
