from __future__ import annotations

from skyfold import dims
from skyfold.operators.structuring import structure_objects
from skyfold.sources.results import catalog_summary


def test_bands(spark):
    assert [r.band for r in dims.bands(spark).orderBy("band_pos").collect()] == list(dims.BANDS)
    rows = dims.bandset_bands(spark).orderBy("bandset_pos", "band_pos").collect()
    assert [(r.bandset, r.band) for r in rows] == [(s, b) for s, members in dims.BANDSETS.items() for b in members]


def test_catalog_summary(spark):
    texts = spark.createDataFrame(
        [("OSC-2022", "a", '{"a": {"schema": "s", "name": "a", "sources": []}}'), ("OSC-2022", "b", "{}")],
        "catalog STRING, file_stem STRING, value STRING",
    )
    summary = catalog_summary(dims.catalogs(spark, {"OSC-2022": "/data/osc"}), structure_objects(texts))
    found = {r.catalog: (r.path, r.nr_datapoints, r.n_loaded, r.n_rejected) for r in summary.collect()}
    assert found == {
        "OSC-2018-June": ("datasets/osc2018_june", 45162, 0, 0),
        "OSC-2022": ("/data/osc", 108921, 1, 1),
    }
