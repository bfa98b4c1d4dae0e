"""From photometric observations to per-band light curves in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.dims import BANDS
from skyfold.functions.photometry import (
    flux_from_magnitude,
    is_supported_band,
    magnitude_from_flux,
    normalise_band,
    zeropoint_or_default,
)
from skyfold.functions.sqltext import literals

NAME = ("name",)


def derive_flux_and_magnitude(observations: DataFrame) -> DataFrame:
    """Fill the missing one of flux and magnitude from the other; a missing zeropoint counts as 1."""
    derived = {
        "flux": f"coalesce(flux, {flux_from_magnitude('magnitude', 'zeropoint')})",
        "magnitude": f"coalesce(magnitude, {magnitude_from_flux('flux', 'zeropoint')})",
    }
    return observations.withColumn("zeropoint", F.expr(zeropoint_or_default("zeropoint"))).withColumns(
        {name: F.expr(value) for name, value in derived.items()}
    )


def valid_observations(observations: DataFrame) -> DataFrame:
    return observations.where("time IS NOT NULL AND flux IS NOT NULL AND band_raw IS NOT NULL")


def normalise_bands(observations: DataFrame) -> DataFrame:
    """Add ``band``: the raw band name with every prime spelled out."""
    return observations.selectExpr("*", f"{normalise_band('band_raw')} AS band")


def supported_bands(observations: DataFrame) -> DataFrame:
    return observations.where(is_supported_band("band"))


def light_curves(observations: DataFrame, by: Sequence[str] = NAME) -> DataFrame:
    """Valid observations in supported bands with the band attributes only. Narrow: no shuffle."""
    return (
        observations.transform(valid_observations)
        .transform(normalise_bands)
        .transform(supported_bands)
        .select(*by, "band", "pos", "time", "e_time", "flux", "e_flux", "upperlimit")
    )


def band_counts(light_curves: DataFrame, by: Sequence[str] = NAME) -> DataFrame:
    """Observations per band, for the bands that have any."""
    return light_curves.groupBy(*by, "band").agg(F.count(F.lit(1)).alias("n_obs"))


def candidate_counts(candidates: DataFrame, light_curves: DataFrame, by: Sequence[str] = NAME) -> DataFrame:
    """Observations over all bands, 0 for a candidate without any."""
    counted = light_curves.groupBy(*by).agg(F.count(F.lit(1)).alias("n_obs"))
    return candidates.select(*by).join(counted, list(by), "left").select(
        *by, F.coalesce("n_obs", F.lit(0).cast("bigint")).alias("n_obs")
    )


def select_bands(
    candidates: DataFrame,
    light_curves: DataFrame,
    bands: Sequence[str] = BANDS,
    by: Sequence[str] = NAME,
) -> DataFrame:
    """The requested bands of every candidate, numbered in requested order.

    A band without observations is one row with a null ``pos``; light curves of objects that are no candidates
    are left out. Empty bands are found against the per-band counts. Both joins have unique keys on one side, so
    a band or object holding most of all observations can be split.
    """
    wanted = f"array({literals(bands)})"
    chosen = light_curves.where(f"array_contains({wanted}, band)").join(candidates.select(*by), list(by), "left_semi")
    filled = chosen.selectExpr("*", f"int(array_position({wanted}, band)) - 1 AS band_pos")
    requested = candidates.selectExpr(*by, f"posexplode({wanted}) AS (band_pos, band)")
    empty = requested.join(band_counts(chosen, by), [*by, "band"], "left_anti")
    return filled.unionByName(empty, allowMissingColumns=True)


def band_arrays(light_curves: DataFrame, by: Sequence[str] = NAME, span: int | None = None) -> DataFrame:
    """Parallel arrays in input order, one row per object and band.

    A band's observations come from one document, which fits one row. ``span`` is for light curves from elsewhere:
    it cuts the arrays at multiples of so many positions, numbered by ``part``.
    """
    attributes = ("time", "e_time", "flux", "e_flux", "upperlimit")
    key = [*by, "band"]
    if span is not None:
        light_curves = light_curves.selectExpr("*", f"bigint(floor(pos / {span})) AS part")
        key.append("part")
    points = F.expr(f"array_sort(collect_list(struct(pos, {', '.join(attributes)}))) AS points")
    gathered = light_curves.groupBy(*key).agg(points)
    return gathered.selectExpr(*key, *[f"points.{name} AS {name}" for name in attributes])


def band_matrix(arrays: DataFrame) -> DataFrame:
    """Each band as a 4 x n matrix of time, time error, flux and flux error."""
    matrix = F.array("time", "e_time", "flux", "e_flux").alias("matrix")
    return arrays.withColumn("matrix", matrix).drop("time", "e_time", "flux", "e_flux", "upperlimit")
