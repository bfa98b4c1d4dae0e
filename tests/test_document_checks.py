"""Verdicts from documents equal those of the long tables; streams equal the batch."""

from __future__ import annotations

import json

import pytest

from conftest import plan_of
from skyfold.dims import BANDSETS
from skyfold.operators import unnest
from skyfold.operators.document_checks import document_statistics, document_verdicts
from skyfold.operators.light_curves import derive_flux_and_magnitude, light_curves
from skyfold.operators.structuring import candidates, structure_objects
from skyfold.operators.validation import Tables, bandset_flags, minimum_observations
from skyfold.plans import fixtures
from skyfold.sources.results import CSV_FLAGS, csv_rows
from skyfold.streaming.catalog_stream import ingest_object_batches, validate_stream

SF_DIR = "/root/testdata/sf0.001"


def observation(band, time, **more):
    return {"source": "1", "band": band, "time": time, "flux": "2.5"} | more


DOCUMENTS = {
    "none": {},
    "null": {"photometry": None},
    "empty": {"photometry": []},
    "odd": {
        "photometry": [
            observation("g'", ["1", "4"]),
            observation("g'", "2.9"),
            observation("r'", "nan"),
            observation("r'", "inf"),
            observation("r'", "1e300"),
            observation("i'", "-0.5", flux=None, magnitude="3", zeropoint="2"),
            observation("i'", "-0.5", flux=None),
            observation("I", None),
            observation(None, "5"),
            observation("V", "5"),
            observation("B", "5", flux="nan"),
        ]
    },
    "full": {"photometry": [observation(band, str(3 * k)) for band in ("B", "R", "I", "g", "r") for k in range(4)]},
}


@pytest.fixture(scope="module")
def objects(spark):
    content = {"schema": "s", "sources": []}
    rows = [(n, json.dumps({n: content | {"name": n} | document})) for n, document in DOCUMENTS.items()]
    own = spark.createDataFrame([*rows, ("bad", "no document")], "file_stem STRING, value STRING")
    return own.unionByName(fixtures.catalog_texts(spark, SF_DIR)).transform(structure_objects).cache()


@pytest.fixture(scope="module")
def tables(objects):
    valid = candidates(objects)
    observations = unnest.observations(valid, unnest.LIGHT_CURVE_FIELDS).transform(derive_flux_and_magnitude)
    return Tables(valid.select(*unnest.OBJECT, "has_photometry"), light_curves(observations, unnest.OBJECT), unnest.OBJECT)


def by_object(frame):
    rows = {r.file_stem: tuple(r) for r in frame.collect()}
    assert len(rows) == frame.count()
    return rows


@pytest.mark.parametrize(
    "options",
    [
        {"min_observations": 1},
        {"min_observations": 2, "bin_width": 1.5},
        {"bandsets": {"gri_primed": BANDSETS["gri_primed"], "one": ("B",)}, "min_observations": 1},
        {"all_bands": True, "min_observations": 0},
        {"bandsets": {}},
    ],
)
def test_verdicts_equal_those_of_the_long_tables(objects, tables, options):
    expected = by_object(minimum_observations(**options).validate(tables))
    found = by_object(document_verdicts(candidates(objects), **options))
    assert found == expected and len(expected) > len(DOCUMENTS)


def test_counts(objects):
    rows = {r.file_stem: r for r in document_statistics(candidates(objects)).collect()}
    assert (rows["odd"].n_obs_6, rows["odd"].n_bins_6, rows["odd"].n_obs_7, rows["odd"].n_obs_8) == (2, 1, 1, 1)
    assert (rows["full"].n_obs_0, rows["full"].n_bins_0, rows["full"].n_obs_5) == (4, 4, 0)
    assert [rows[n].has_photometry for n in ("none", "null", "empty")] == [False, False, True]


def test_nothing_is_exchanged(spark):
    texts = spark.createDataFrame([("a", "{}")], "file_stem STRING, value STRING")
    plan = plan_of(document_verdicts(candidates(structure_objects(texts))))
    assert "Exchange" not in plan and "Join" not in plan and "Aggregate" not in plan


@pytest.fixture
def folder(spark, tmp_path):
    path = tmp_path / "files"
    path.mkdir()
    for row in fixtures.catalog_texts(spark, SF_DIR).collect():
        (path / f"{row.file_stem}.json").write_text(row.value)
    return path


def exported(spark, path):
    columns = "name STRING, " + ", ".join(f"`{flag}` STRING" for flag in CSV_FLAGS.values())
    return sorted(tuple(r) for r in spark.read.schema(columns + ", batch_id INT").csv(path, header=True).drop("batch_id").collect())


def test_streamed_validation_equals_the_batch(spark, folder, tmp_path, objects):
    own = objects.where(f"file_stem NOT IN ({', '.join(repr(n) for n in DOCUMENTS)})")
    verdicts = document_verdicts(candidates(own), min_observations=1)
    expected = sorted(tuple(r) for r in csv_rows(bandset_flags(verdicts.where("is_valid"), by=unnest.OBJECT)).collect())
    csv = str(tmp_path / "csv")
    for run in ("first", "first", "again"):  # nothing new; then every batch is repeated
        validate_stream(spark, str(folder), csv, str(tmp_path / run), 40, min_observations=1)
        assert exported(spark, csv) == expected != []


def test_batches_count_objects(spark, folder, tmp_path):
    paths = [str(tmp_path / name) for name in ("objects", "counts")]

    def sizes():
        rows = spark.read.parquet(paths[0]).groupBy("object_batch").count().collect()
        return {r.object_batch: r["count"] for r in rows}

    n_files = len(list(folder.glob("*.json")))
    ingest_object_batches(spark, str(folder), *paths, str(tmp_path / "one"), 20)
    first = sizes()
    n_good = n_files - first[None]
    assert first[None] > 0 and [first[k] for k in sorted(k for k in first if k is not None)] == [20] * (n_good // 20) + [n_good % 20][: n_good % 20]
    ingest_object_batches(spark, str(folder), *paths, str(tmp_path / "two"), 20)
    assert sizes() == first
    good = next(p for p in folder.glob("*.json") if p.stem.startswith("0."))
    for i in range(25):
        text = json.loads(good.read_text())
        (folder / f"new{i}.json").write_text(json.dumps({f"new{i}": text[good.stem]}))
    ingest_object_batches(spark, str(folder), *paths, str(tmp_path / "two"), 20)
    after = sizes()
    assert after[None] == first[None] and sum(after.values()) == n_files + 25
    assert [after[k] for k in sorted(k for k in after if k is not None)][:-1] == [20] * ((n_good + 25 - 1) // 20)
