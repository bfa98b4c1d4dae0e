"""Checks on catalogue candidates, their results and the selection of valid candidates.

A check is a name and a callable from ``Tables`` to ``(by..., is_valid, message)`` rows, one per candidate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyfold.dims import BANDS, BANDSETS
from skyfold.functions.sqltext import identifier, literal
from skyfold.operators.binning import BIN_WIDTH, assign_bins

NAME = ("name",)

# Texts of results and reports.
MINIMUM_OBSERVATIONS = "MinimumObservationsPerBand"
NO_PHOTOMETRY = "No photometry data available"
TOO_FEW = "Band [%s] has only %d observation(s) (minimum: %d)"
CHECK_FAILED = "Check failed: [check=%s; message=%s]"
SUBJECT = "### %s ###"
PASSED = "Passed."


@dataclass(frozen=True)
class Tables:
    """What checks may look at. ``candidates`` has ``by`` and ``has_photometry``."""

    candidates: DataFrame
    light_curves: DataFrame
    by: tuple[str, ...] = NAME


@dataclass(frozen=True)
class Check:
    name: str
    validate: Callable[[Tables], DataFrame]


def band_statistics(light_curves: DataFrame, bin_width: float = BIN_WIDTH, by: Sequence[str] = NAME) -> DataFrame:
    """Observations and occupied time bins per band; the bins themselves need not be computed."""
    return assign_bins(light_curves, bin_width).groupBy(*by, "band").agg(
        F.count(F.lit(1)).alias("n_obs"), F.count_distinct("bin_id").alias("n_bins")
    )


def bandset_results(
    tables: Tables,
    bandsets: dict[str, tuple[str, ...]] = BANDSETS,
    min_observations: int = 3,
    bin_width: float = BIN_WIDTH,
) -> DataFrame:
    """Per candidate the array ``bandsets`` of ``(bandset, is_valid, message)`` in requested order.

    A band set passes when each of its bands occupies ``min_observations`` bins; otherwise the first failing
    band gives the message, which quotes the number of unbinned observations. The candidate has one slot
    per band (a fixed number), so the band sets are evaluated by expressions on a single row per candidate.
    """
    by = list(tables.by)
    per_candidate = band_statistics(tables.light_curves, bin_width, by).groupBy(*by).agg(*[
        F.expr(f"coalesce(max(CASE WHEN band = {literal(band)} THEN {measure} END), 0) AS {measure}_{i}")
        for i, band in enumerate(BANDS)
        for measure in band_measures()
    ])
    counted = tables.candidates.select(*by, "has_photometry").join(per_candidate, by, "left")
    return outcomes(counted, bandsets, min_observations, by)


def band_measures() -> tuple[str, str]:
    """What is counted per band, in columns numbered by band."""
    return ("n_bins", "n_obs")


def outcomes(
    counted: DataFrame, bandsets: dict[str, tuple[str, ...]], min_observations: int, by: Sequence[str] = NAME
) -> DataFrame:
    """``bandset_results`` from one row per candidate with the numbered ``band_measures``."""
    slots = {band: i for i, band in enumerate(BANDS)}

    def result(bandset: str, members: Sequence[str]) -> str:
        failures = [
            f"CASE WHEN coalesce(n_bins_{slots[band]}, 0) < {min_observations} THEN "
            f"format_string({literal(TOO_FEW)}, {literal(band)}, coalesce(n_obs_{slots[band]}, 0), {min_observations}) END"
            for band in members
        ]
        return f"struct({literal(bandset)} AS bandset, coalesce({', '.join(failures)}) AS message)"

    results = ", ".join(result(bandset, members) for bandset, members in bandsets.items())
    outcome = f"transform(array({results}), r -> struct(r.bandset, r.message IS NULL AS is_valid, r.message))"
    empty = "cast(array() AS ARRAY<STRUCT<bandset: STRING, is_valid: BOOLEAN, message: STRING>>)"
    return counted.selectExpr(
        *by, "has_photometry", f"CASE WHEN has_photometry THEN {outcome if bandsets else empty} END AS bandsets"
    )


def minimum_verdicts(results: DataFrame, by: Sequence[str] = NAME) -> DataFrame:
    """Verdict, message and available band sets from ``bandset_results``: one passing band set suffices."""
    return results.selectExpr(
        *by,
        "has_photometry AND exists(bandsets, r -> r.is_valid) AS is_valid",
        f"""CASE WHEN NOT has_photometry THEN {literal(NO_PHOTOMETRY)}
                 WHEN NOT exists(bandsets, r -> r.is_valid) THEN
                     array_join(transform(filter(bandsets, r -> NOT r.is_valid), r -> r.message), '\\n')
            END AS message""",
        "transform(filter(bandsets, r -> r.is_valid), r -> r.bandset) AS available_bandsets",
    )


def minimum_observations(
    bandsets: dict[str, tuple[str, ...]] = BANDSETS,
    min_observations: int = 3,
    all_bands: bool = False,
    bin_width: float = BIN_WIDTH,
) -> Check:
    """Enough binned observations in all bands of at least one band set.

    Without band sets no candidate is valid and the message is empty; ``all_bands`` instead demands enough
    observations in every supported band. Deviation: all band sets are the default, not the empty list.
    """
    requested = {"all": BANDS} if all_bands else bandsets

    def validate(tables: Tables) -> DataFrame:
        return minimum_verdicts(bandset_results(tables, requested, min_observations, bin_width), tables.by)

    return Check(MINIMUM_OBSERVATIONS, validate)


def bandset_flags(
    results: DataFrame, bandsets: Sequence[str] = tuple(BANDSETS), by: Sequence[str] = NAME
) -> DataFrame:
    """One boolean per band set from the ``available_bandsets`` of a check."""
    return results.selectExpr(
        *by,
        *[
            f"coalesce(array_contains(available_bandsets, {literal(bandset)}), false) AS {identifier(bandset)}"
            for bandset in bandsets
        ],
    )


def check_results(tables: Tables, checks: Sequence[Check], fail_fast: bool = False) -> DataFrame:
    """All results ``(by..., check_pos, check_name, is_valid, message)``, numbered in the order of ``checks``.

    ``fail_fast`` keeps a candidate's results up to and including its first failure.
    """
    if not checks:
        nothing = tables.candidates.select(*tables.by).where("false")
        return nothing.selectExpr("*", "0 AS check_pos", "'' AS check_name", "true AS is_valid", "CAST(NULL AS STRING) AS message")
    columns = (*tables.by, "is_valid", "message")
    results = reduce(
        DataFrame.unionByName,
        [
            check.validate(tables).select(
                *columns, F.lit(position).alias("check_pos"), F.lit(check.name).alias("check_name")
            )
            for position, check in enumerate(checks)
        ],
    ).select(*tables.by, "check_pos", "check_name", "is_valid", "message")
    return first_failures(results, tables.by) if fail_fast else results


def first_failures(results: DataFrame, by: Sequence[str] = NAME) -> DataFrame:
    """Results up to and including the first failure; a window holds one row per check."""
    earlier = Window.partitionBy(*by).orderBy("check_pos").rowsBetween(Window.unboundedPreceding, -1)
    failures = F.coalesce(F.sum(F.when(~F.col("is_valid"), 1).otherwise(0)).over(earlier), F.lit(0))
    return results.withColumn("earlier_failures", failures).where("earlier_failures = 0").drop("earlier_failures")


def candidate_validity(candidates: DataFrame, results: DataFrame | None, by: Sequence[str] = NAME) -> DataFrame:
    """``is_valid`` per candidate: all its results are valid; true where there is none."""
    if results is None:
        return candidates.select(*by, F.lit(True).alias("is_valid"))
    verdicts = results.groupBy(*by).agg(F.bool_and("is_valid").alias("is_valid"))
    return candidates.select(*by).join(verdicts, list(by), "left").select(
        *by, F.coalesce("is_valid", F.lit(True)).alias("is_valid")
    )


def filter_valid(candidates: DataFrame, results: DataFrame | None, by: Sequence[str] = NAME) -> DataFrame:
    """The candidates without a failed result."""
    if results is None:
        return candidates
    return candidates.join(results.where(~F.col("is_valid")).select(*by), list(by), "left_anti")


def report(results: DataFrame, only_errors: bool = True, by: Sequence[str] = NAME) -> DataFrame:
    """Report lines per candidate: a heading, then its failed checks, or that it passed.

    Grouped rows hold one entry per check. With ``only_errors`` candidates without a failure are left out.
    """
    line = f"format_string({literal(CHECK_FAILED)}, check_name, coalesce(message, 'None'))"
    gathered = results.groupBy(*by).agg(
        F.expr(
            f"sort_array(collect_list(CASE WHEN NOT is_valid THEN struct(check_pos, {line} AS line) END)) AS failures"
        )
    )
    if only_errors:
        gathered = gathered.where("size(failures) > 0")
    heading = f"array(format_string({literal(SUBJECT)}, {identifier(by[-1])}))"
    body = f"CASE WHEN size(failures) > 0 THEN failures.line ELSE array({literal(PASSED)}) END"
    return gathered.selectExpr(*by, f"posexplode(concat({heading}, {body})) AS (line_pos, line)")


def valid_ratio(validity: DataFrame, nominal_size: int | None = None) -> DataFrame:
    """Valid candidates, total and percentage; ``nominal_size`` replaces the counted total."""
    total = F.count(F.lit(1)) if nominal_size is None else F.lit(nominal_size).cast("bigint")
    counted = validity.agg(
        F.count_if("is_valid").alias("n_valid"),
        total.alias("n_total"),
    )
    return counted.select(
        "n_valid", "n_total", F.try_divide(F.col("n_valid") * 100.0, F.col("n_total")).alias("percent_valid")
    )
