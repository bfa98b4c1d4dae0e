"""Result sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Header of the exported table.
CSV_FLAGS = {"BRI": "BRI", "gri": "gri", "gri_primed": "g'r'i'"}


def csv_rows(flags: DataFrame, name: str = "name", kept: Sequence[str] = ()) -> DataFrame:
    """Name and band set flags as exported, the flags spelled ``True`` and ``False``, and the columns ``kept``."""
    return flags.select(
        F.col(name).alias("name"),
        *[F.initcap(F.col(bandset).cast("string")).alias(header) for bandset, header in CSV_FLAGS.items()],
        *kept,
    )


def write_csv(flags: DataFrame, path: str, name: str = "name") -> None:
    """Write a folder of CSV files, each with the header."""
    csv_rows(flags, name).write.mode("overwrite").csv(path, header=True)


def catalog_summary(
    catalogs: DataFrame, objects: DataFrame, by: Sequence[str] = ("catalog",)
) -> DataFrame:
    """Nominal, loaded and rejected size of each known catalogue found in ``objects``."""
    counted = objects.groupBy(*by).agg(
        F.count_if(F.col("reason").isNull()).alias("n_loaded"),
        F.count_if(F.col("reason").isNotNull()).alias("n_rejected"),
    )
    zero = F.lit(0).cast("bigint")
    return catalogs.join(counted, list(by), "left").select(
        *by,
        "description",
        "path",
        "nr_datapoints",
        F.coalesce("n_loaded", zero).alias("n_loaded"),
        F.coalesce("n_rejected", zero).alias("n_rejected"),
    )
