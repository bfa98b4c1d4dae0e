"""Error-weighted binning of light curves in time.

No task ever sees the raw rows of a bin, so a bin may hold most of all observations:

1. within a bin, observations are grouped by the decade (base 4) of their error, so that weights in one
   group differ by at most a factor of 16. The weighted scatter then follows from two mergeable sums,
   ``sum(w (f - m)^2) = S(w f, f) - m S(w, f)`` with ``S`` the centred sum of products, without the
   cancellation that plain sums of squares suffer: a hash aggregation, combined on the map side. Upper limits have a
   branch of their own, which keeps the first of the lowest ones per bin, combined on the map side as well;
2. the overall weighted mean is put beside the groups by a window. Its partitions hold one row per decade,
   about 1,050 at most (the exponent range of a double) whatever the data;
3. the groups of a bin are merged around that mean: again a hash aggregation, combined on the map side.

Deviations: where only upper limits have errors the plain mean of the detections is used (the weighted mean
would be one of nothing); an error of exactly zero among several gives null flux and null error; ``upperlimit``
is the flag of the bin; observations without finite time are left out; a bin holding a flux that is not finite has
null flux and error, and counts all its observations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyfold.functions.coerce import finite_or_null
from skyfold.functions.timebins import bin_centre, bin_id

NAME = ("name",)
BIN_WIDTH = 3.0

UPPER_LIMIT = "upper limit"
PLAIN_MEAN = "plain mean"
SINGLE = "single"
WEIGHTED = "weighted"

# Stands for the error decade of an error of zero, which has no logarithm.
ZERO_ERROR = -9999


def assign_bins(light_curves: DataFrame, bin_width: float = BIN_WIDTH) -> DataFrame:
    """Add ``bin_id``; drop observations without a finite time."""
    return light_curves.selectExpr("*", f"{bin_id('time', bin_width)} AS bin_id").where("bin_id IS NOT NULL")


def partial_bins(
    light_curves: DataFrame, bin_width: float = BIN_WIDTH, by: Sequence[str] = NAME
) -> tuple[DataFrame, DataFrame]:
    """The mergeable sums that ``merged_statistics`` takes: detections per bin and error decade, upper limits per bin."""
    key = [*by, "band", "bin_id"]
    points = (
        assign_bins(light_curves, bin_width)
        .selectExpr(
            *key,
            "pos",
            f"{finite_or_null('flux')} AS flux",
            f"{finite_or_null('e_flux')} AS e_flux",
            "coalesce(upperlimit, false) AS is_limit",
        )
        .selectExpr(
            *key,
            "pos",
            "flux",
            "e_flux",
            "CASE WHEN NOT is_limit THEN try_divide(1D, e_flux * e_flux) END AS weight",
            "is_limit",
        )
    )
    decade = f"CASE WHEN e_flux IS NOT NULL THEN coalesce(int(floor(log(4D, abs(e_flux)))), {ZERO_ERROR}) END AS error_decade"
    detections = points.where("NOT is_limit").selectExpr(*key, "pos", "flux", "e_flux", "weight", decade)
    groups = detections.groupBy(*key, "error_decade").agg(
        F.expr("count(*) AS n"),
        F.expr("count(flux) AS n_finite"),
        F.expr("sum(flux) AS flux_sum"),
        F.expr("min_by(e_flux, pos) AS first_error"),
        F.expr("sum(weight) AS weight"),
        F.expr("regr_sxy(flux, weight) AS s_w_f"),
        F.expr("regr_sxy(flux, weight * flux) AS s_wf_f"),
    )
    limits = (
        points.where("is_limit")
        .groupBy(*key)
        .agg(
            F.expr("count(*) AS n"),
            F.expr("count(flux) AS n_finite"),
            F.expr("min(struct(coalesce(flux, double('infinity')) AS flux, pos, e_flux)) AS lowest"),
        )
        .selectExpr(
            *key, "n", "n_finite", "lowest.flux AS limit_flux", "lowest.pos AS limit_pos", "lowest.e_flux AS limit_error"
        )
    )
    return groups, limits


def merged_statistics(groups: DataFrame, limits: DataFrame, by: Sequence[str] = NAME) -> DataFrame:
    """``bin_statistics`` from the partial sums. A decade may have several rows of ``groups``; ``limits`` has one row per bin."""
    key = [*by, "band", "bin_id"]
    bin_groups = Window.partitionBy(*key)
    centred = (
        groups.selectExpr("*", "flux_sum / n + try_divide(s_w_f, weight) AS mean")
        .withColumns({
            "total_weight": F.expr("sum(weight)").over(bin_groups),
            "weighted_sum": F.expr("sum(weight * mean)").over(bin_groups),
        })
        .selectExpr("*", "try_divide(weighted_sum, total_weight) AS weighted_mean")
        .selectExpr(
            "*",
            # Scatter around the overall mean: that within the group plus that of the group itself.
            """greatest(s_wf_f - mean * s_w_f, 0D) + weight * (mean - weighted_mean) * (mean - weighted_mean)
               AS scatter""",
        )
    )
    parts = centred.unionByName(limits.drop("limit_pos"), allowMissingColumns=True)
    merged = parts.groupBy(*key).agg(
        F.expr("sum(n) AS n_obs"),
        F.expr("sum(n) = sum(n_finite) AS all_finite"),
        F.expr("sum(CASE WHEN limit_flux IS NULL THEN n ELSE 0 END) AS n_detections"),
        F.expr("sum(CASE WHEN error_decade IS NOT NULL THEN n ELSE 0 END) AS n_errors"),
        F.expr("sum(CASE WHEN weight IS NOT NULL THEN n ELSE 0 END) AS n_weights"),
        F.expr("min(limit_flux) AS limit_flux"),
        F.expr("max(limit_error) AS limit_error"),
        F.expr("sum(CASE WHEN limit_flux IS NULL THEN flux_sum END) AS detection_sum"),
        F.expr("max(CASE WHEN error_decade IS NOT NULL THEN flux_sum END) AS single_flux"),
        F.expr("max(CASE WHEN error_decade IS NOT NULL THEN first_error END) AS single_error"),
        F.expr("max(weighted_mean) AS weighted_mean"),
        F.expr("max(total_weight) AS total_weight"),
        F.expr("sum(scatter) AS scatter"),
    )
    weighted = f"method = '{WEIGHTED}' AND n_weights = n_errors AND all_finite"
    values = ("detection_sum", "single_flux", "single_error", "weighted_mean", "limit_flux", "limit_error")
    return merged.selectExpr(
        "* EXCEPT (" + ", ".join(values) + ")",
        *[f"CASE WHEN all_finite THEN {name} END AS {name}" for name in values],
        f"""CASE WHEN n_detections = 0 THEN '{UPPER_LIMIT}'
                 WHEN n_errors = 0 THEN '{PLAIN_MEAN}'
                 WHEN n_errors = 1 THEN '{SINGLE}'
                 ELSE '{WEIGHTED}' END AS method""",
    ).selectExpr(
        *key,
        "n_obs",
        "n_detections",
        "n_errors",
        "method",
        "limit_flux",
        "limit_error",
        "try_divide(detection_sum, n_detections) AS plain_mean",
        "single_flux",
        "single_error",
        f"CASE WHEN {weighted} THEN weighted_mean END AS weighted_mean",
        f"CASE WHEN {weighted} THEN sqrt(try_divide(scatter, total_weight) / (n_errors - 1)) END AS sigma",
        f"CASE WHEN {weighted} THEN try_divide(1D, sqrt(total_weight)) END AS typical_error",
    )


def bin_statistics(light_curves: DataFrame, bin_width: float = BIN_WIDTH, by: Sequence[str] = NAME) -> DataFrame:
    """One row per bin with every statistic and the ``method`` that applies to it.

    ``sigma`` is the standard error of the weighted mean and ``typical_error`` the propagated one; both are
    null unless the method is ``weighted``.
    """
    return merged_statistics(*partial_bins(light_curves, bin_width, by), by)


def binned_light_curve(light_curves: DataFrame, bin_width: float = BIN_WIDTH, by: Sequence[str] = NAME) -> DataFrame:
    """Binned flux and error: the lowest upper limit, the plain mean, the only value, or the weighted mean."""
    return binned_values(bin_statistics(light_curves, bin_width, by), bin_width, by)


def binned_values(statistics: DataFrame, bin_width: float = BIN_WIDTH, by: Sequence[str] = NAME) -> DataFrame:
    """The binned light curve that follows from ``statistics``, one row per bin."""
    flux = f"""CASE method WHEN '{UPPER_LIMIT}' THEN limit_flux WHEN '{PLAIN_MEAN}' THEN plain_mean
                           WHEN '{SINGLE}' THEN single_flux ELSE weighted_mean END"""
    e_flux = f"""CASE method WHEN '{UPPER_LIMIT}' THEN limit_error WHEN '{SINGLE}' THEN single_error
                             WHEN '{WEIGHTED}' THEN
                    CASE WHEN typical_error > sigma THEN (sigma + typical_error) / 2 ELSE sigma END END"""
    return (
        statistics.selectExpr(*by, "band", "bin_id", "n_obs", "method", f"{flux} AS flux", f"{e_flux} AS e_flux")
        .selectExpr(
            *by,
            "band",
            "bin_id",
            f"{bin_centre('bin_id', bin_width)} AS time",
            f"{float(bin_width) / 2!r}D AS e_time",
            f"{finite_or_null('flux')} AS flux",
            f"{finite_or_null('e_flux')} AS e_flux",
            f"method = '{UPPER_LIMIT}' AS upperlimit",
            "n_obs",
            "method",
        )
    )

