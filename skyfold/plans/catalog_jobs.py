"""The two catalogue jobs: ingest files into tables, and select valid candidates from the tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from skyfold.operators import unnest
from skyfold.operators.light_curves import derive_flux_and_magnitude, light_curves
from skyfold.operators.structuring import candidates, rejects, structure_objects
from skyfold.operators.validation import Check, Tables, bandset_flags, check_results, filter_valid
from skyfold.sources.catalog import read_texts
from skyfold.sources.object_table import write_objects
from skyfold.sources.results import write_csv

OBJECT = unnest.OBJECT


def ingest(spark: SparkSession, path: str, tables_path: str, clustered: bool = False) -> None:
    """Read the files once into the table ``objects``; the long tables are then unnested from it.

    ``clustered`` exchanges the objects once, for cheaper lookups (see ``sources.object_table``).
    """
    write_objects(read_texts(spark, path).transform(structure_objects), f"{tables_path}/objects", clustered)
    for name, table in unnested(spark, tables_path).items():
        table.write.mode("overwrite").parquet(f"{tables_path}/{name}")


def unnested(spark: SparkSession, tables_path: str) -> dict[str, DataFrame]:
    objects = spark.read.parquet(f"{tables_path}/objects")
    valid = candidates(objects)
    return {
        "rejects": rejects(objects),
        "sources": unnest.sources(valid),
        "quantities": unnest.quantities(valid),
        "observations": unnest.observations(valid).transform(derive_flux_and_magnitude),
        "spectra": unnest.spectra(valid),
    }


def catalog_tables(spark: SparkSession, tables_path: str) -> Tables:
    """Candidates and light curves of an ingested catalogue."""
    valid = candidates(spark.read.parquet(f"{tables_path}/objects"))
    observations = spark.read.parquet(f"{tables_path}/observations")
    return Tables(valid.select(*OBJECT, "has_photometry"), light_curves(observations, OBJECT), OBJECT)


def select_valid(tables: Tables, checks: Sequence[Check], flags_from: Check, csv_path: str) -> None:
    """Export the candidates that pass every check, with the band sets that ``flags_from`` found available."""
    results = check_results(tables, checks)
    flags = bandset_flags(flags_from.validate(tables), by=tables.by)
    write_csv(filter_valid(flags, results, tables.by), csv_path)
