"""Fixed dimensions: bands, band sets and known catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Supported bands in declared order, and the band sets made of them.
BANDS = ("B", "R", "I", "g", "r", "i", "g_pr", "r_pr", "i_pr")
BANDSETS = {
    "BRI": ("B", "R", "I"),
    "gri": ("g", "r", "i"),
    "gri_primed": ("g_pr", "r_pr", "i_pr"),
}

# Names and nominal sizes of the known catalogues.
CATALOGS = (
    ("OSC-2018-June", "datasets/osc2018_june", "Open Supernova Catalog up to June 2018 (arXiv:1905.11516)", 45162),
    ("OSC-2022", "datasets/osc2022", "Open Supernova Catalog up to 2022, merged with the AstroCats repositories", 108921),
)


def bands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(BANDS)), "band_pos INT, band STRING").select("band", "band_pos")


def bandset_bands(spark: SparkSession, bandsets: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row per band of each band set, numbered in declared order."""
    rows = [
        (bandset, bandset_pos, band, band_pos)
        for bandset_pos, (bandset, members) in enumerate((bandsets or BANDSETS).items())
        for band_pos, band in enumerate(members)
    ]
    return spark.createDataFrame(rows, "bandset STRING, bandset_pos INT, band STRING, band_pos INT")


def catalogs(spark: SparkSession, paths: dict[str, str] | None = None) -> DataFrame:
    """Known catalogues with nominal size; ``paths`` overrides the default location by name."""
    rows = [
        (name, (paths or {}).get(name, path), description, size) for name, path, description, size in CATALOGS
    ]
    return spark.createDataFrame(rows, "catalog STRING, path STRING, description STRING, nr_datapoints BIGINT")
