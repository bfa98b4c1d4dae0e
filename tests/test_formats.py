"""Catalogues of other formats: a shipped one, and one of the user's own."""

from __future__ import annotations

import json
import os
import pickle

import pytest

from skyfold.operators import unnest
from skyfold.operators.structuring import candidates, rejects
from skyfold.plans import registered
from skyfold.sources.formats import (
    CatalogFormat,
    FolderReader,
    PhotometryTables,
    UnknownLayout,
    _name_lists,
    packed,
    read_catalog,
)

TABLE = """# name: SN 1
# schema: v1
# source: first
# source: second
time,band,magnitude,upperlimit,source
53000.5,B,17.25,False,
53001,"R,x",,true,2
"""


def written(folder, files):
    folder.mkdir()
    for name, content in files.items():
        (folder / name).write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(folder)


@pytest.fixture
def packed_objects():
    class Packed(CatalogFormat):
        """Several objects per file, one per line as ``stem<TAB>fields``."""

        suffix = ".objects"

        @classmethod
        def name(cls):
            return "packed_objects"

        @staticmethod
        def objects(file_stem, content):
            for line in content.decode().splitlines():
                stem, tab, fields = line.partition("\t")
                if not tab:
                    raise UnknownLayout(f"line without tab in {file_stem}")
                yield stem, json.loads(fields)

    return Packed


def test_tables(spark, tmp_path):
    path = written(tmp_path / "a b%20[c]", {"SN 1.csv": TABLE, "_hidden.csv": TABLE, ".dotted.csv": TABLE, "notes.txt": "no"})
    (tmp_path / "a b%20[c]" / "k=v").mkdir()
    (tmp_path / "a b%20[c]" / "k=v" / "inside.csv").write_text(TABLE)
    objects = read_catalog(spark, PhotometryTables, path)
    assert sorted((r.file_stem, r.name, r.reason) for r in objects.collect()) == [
        (stem, "SN 1", None) for stem in (".dotted", "SN 1", "_hidden")
    ]
    one = candidates(objects).where("file_stem = 'SN 1'")
    assert [(r.alias, r.source_name) for r in unnest.sources(one).collect()] == [(1, "first"), (2, "second")]
    observed = unnest.observations(one, ("time", "band", "magnitude", "upperlimit", "source")).orderBy("pos").collect()
    assert [(r.time, r.band_raw, r.magnitude, r.upperlimit, r.source) for r in observed] == [
        (53000.5, "B", 17.25, False, "1"),
        (53001.0, "R,x", None, True, "2"),
    ]


@pytest.mark.parametrize(
    ("content", "reason", "detail"),
    [
        ("", "schema", "no photometric column names"),
        ("time,colour\n1,2\n", "schema", "no photometric column names"),
        ("time,time\n1,2\n", "schema", "no photometric column names"),
        ("# name: a\ntime,band\n1\n", "invalid", "zip() argument 2 is shorter than argument 1"),
        ('# name: a\ntime,band\n1,"B\n', "invalid", "table: unexpected end of data"),
        (b"\xff\xfe", "invalid", "'utf-8' codec can't decode byte 0xff in position 0: invalid start byte"),
        ("# name: a\ntime,upperlimit\n1,0\n", "invalid", "upperlimit: neither true nor false"),
        ("# name: a\n# source: s\ntime,band\n1,B\n", "invalid", "schema: missing"),
        ("# schema: v1\n# name: a\n# source: s\ntime,magnitude\n1,faint\n", "invalid", "photometry: malformed"),
    ],
)
def test_rejected_tables(spark, tmp_path, content, reason, detail):
    path = written(tmp_path / "tables", {"bad.csv": content, "good.csv": TABLE})
    objects = read_catalog(spark, PhotometryTables, path)
    assert [(r.file_stem, r.reason, r.detail) for r in rejects(objects).collect()] == [("bad", reason, detail)]
    assert [r.file_stem for r in candidates(objects).collect()] == ["good"]


def test_format_of_ones_own(spark, tmp_path, packed_objects):
    fields = json.dumps({"name": "n", "schema": "v1", "sources": [{"alias": 1, "name": "s"}]})
    files = {f"part{i}.objects": "".join(f"o{i}-{j}\t{fields}\n" for j in range(50)) for i in range(20)}
    files["cut.objects"] = f"kept\t{fields}\nno tab\nlost\t{fields}\n"
    files["nan.objects"] = 'nan\t{"name": NaN}\n'
    path = written(tmp_path / "packed", files)
    objects = read_catalog(spark, packed_objects, path, partitionBytes=20_000, openCostBytes=100)
    assert objects.rdd.getNumPartitions() > 3
    assert candidates(objects).count() == 20 * 50 + 1
    assert sorted((r.file_stem, r.reason) for r in rejects(objects).collect()) == [("cut", "schema"), ("nan", "invalid")]
    documents = spark.read.format("packed_objects").load(path)
    assert documents.columns == ["file_stem", "value", "reason", "detail"] and documents.count() == 1003


def test_folders_without_files(spark, tmp_path, packed_objects):
    assert read_catalog(spark, packed_objects, str(tmp_path)).collect() == []
    with pytest.raises(Exception, match="absent"):
        read_catalog(spark, packed_objects, str(tmp_path / "absent")).collect()


def test_partitions_are_filled_by_bytes():
    files = [("big", 500), *[(f"small{i:02d}", 10) for i in range(20)]]
    partitions = packed(files, 100, 10)
    assert partitions[0] == ["big"] and [len(p) for p in partitions[1:]] == [5, 5, 5, 5]
    assert sorted(path for p in partitions for path in p) == sorted(path for path, _ in files)


def test_the_driver_plans_lists_of_names(spark, tmp_path, packed_objects):
    fields = json.dumps({"name": "n", "schema": "v1", "sources": [{"alias": 1, "name": "s"}]})
    path = written(tmp_path / "many", {f"_p{i}.objects": f"o{i}\t{fields}\n" for i in range(60)})
    lists = _name_lists(spark, path, ".objects", openCostBytes=1000, partitionBytes=20_000)
    reader = FolderReader(path, ".objects", packed_objects.objects, 20_000, 1000, lists)
    partitions = reader.partitions()
    assert 1 < len(partitions) <= 4 and all(len(pickle.dumps(p)) < 1000 for p in partitions)
    assert sorted(path for p in partitions for path in reader.paths(p)) == sorted(f"{path}/_p{i}.objects" for i in range(60))
    objects = read_catalog(spark, packed_objects, path, openCostBytes=1000, partitionBytes=20_000)
    assert sorted(r.file_stem for r in objects.collect()) == sorted(f"o{i}" for i in range(60))
    assert objects.rdd.getNumPartitions() == len(partitions)


def test_partitions_of_small_files_are_few(spark, tmp_path):
    path = written(tmp_path / "many", {f"p{i}.csv": TABLE for i in range(600)})
    reader = FolderReader(path, ".csv", PhotometryTables.objects, 0, 0, _name_lists(spark, path, ".csv"))
    partitions = reader.partitions()
    assert len(partitions) == 1 and len(list(reader.paths(partitions[0]))) == 600


def test_tables_are_made_of_objects_structured_once(spark, tmp_path, monkeypatch):
    rows = [(i, i % 40, "error", float(i), '{"k": 1}') for i in range(120)]
    events = spark.createDataFrame(rows, "event_id LONG, user_id LONG, event_type STRING, value DOUBLE, props STRING")
    events.selectExpr("*", "timestamp_seconds(event_id) AS ts").write.parquet(str(tmp_path / "events.parquet"))
    plain, asked = registered._objects, str(tmp_path / "asked")

    def noted(batches):
        for batch in batches:
            with open(asked, "a") as file:
                file.write("".join(f"{stem}\n" for stem in batch["file_stem"].to_pylist()))
            yield batch

    def objects(*given):
        found = plain(*given)
        return found.mapInArrow(noted, found.schema)

    monkeypatch.setattr(registered, "_objects", objects)
    path = registered._table_files(spark, str(tmp_path)).removeprefix("file:")
    with open(asked) as file:
        assert sorted(file.read().split()) == sorted(f"{user}.0" for user in range(40))
    assert sorted(os.listdir(path)) == sorted(f"{user}.0.csv" for user in range(40))
