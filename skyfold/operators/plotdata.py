"""Plot-ready series of light curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.dims import BANDSETS

NAME = ("name",)


def plot_series(
    light_curves: DataFrame, bandsets: dict[str, tuple[str, ...]] = BANDSETS, by: Sequence[str] = NAME
) -> DataFrame:
    """Points per requested band set and band: ``x`` time, ``y`` flux, ``y_error`` flux error.

    The band itself names the series. Works on plain and on binned light curves; a band requested by several
    band sets appears once in each.
    """
    memberships = [
        F.when(F.col("band").isin(*members), F.lit(bandset)) for bandset, members in bandsets.items()
    ]
    return light_curves.select(
        *by,
        F.explode(F.array_compact(F.array(*memberships))).alias("bandset"),
        F.col("band").alias("series"),
        F.col("time").alias("x"),
        F.col("flux").alias("y"),
        F.col("e_flux").alias("y_error"),
    )
