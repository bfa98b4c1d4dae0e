"""Checks within the documents of a catalogue: bins, counts and verdicts of an object from its own row.

The photometry of an object lies in one document, so its light curves, time bins and verdicts follow from array expressions on
that row: no observation is exchanged and no result is joined, in batch and on a stream alike. The long tables and their
aggregation (``validation``) remain for light curves that do not come as documents. Results are the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from skyfold import schemas
from skyfold.dims import BANDS, BANDSETS
from skyfold.functions.coerce import coerce
from skyfold.functions.photometry import flux_from_magnitude, normalise_band, zeropoint_or_default
from skyfold.functions.sqltext import literal
from skyfold.functions.timebins import bin_id
from skyfold.operators.binning import BIN_WIDTH
from skyfold.operators.unnest import OBJECT
from skyfold.operators.validation import band_measures, minimum_verdicts, outcomes

FIELDS = ("time", "magnitude", "flux", "zeropoint", "band")


def document_statistics(candidates: DataFrame, bin_width: float = BIN_WIDTH, by: Sequence[str] = OBJECT) -> DataFrame:
    """``by``, ``has_photometry`` and, per supported band, observations and occupied time bins. Narrow: no shuffle."""
    declared = {name: schemas.PHOTOMETRY_FIELDS[name] for name in FIELDS}
    typed = ", ".join(f"{coerce(f'item.{name}', kind)} AS {name}" for name, kind in declared.items())
    flux = f"coalesce(o.flux, {flux_from_magnitude('o.magnitude', zeropoint_or_default('o.zeropoint'))})"
    # One step of the chain a column: what later steps use more than once is computed once.
    steps = (
        ("items", f"from_json(photometry, '{schemas.parsed_list(declared)}')"),
        ("typed", f"transform(items, item -> struct({typed}))"),
        ("points", f"transform(typed, o -> struct({normalise_band('o.band')} AS band, o.time AS time, {flux} AS flux))"),
        ("timed", f"transform(filter(points, p -> p.flux IS NOT NULL), p -> struct(p.band, {bin_id('p.time', bin_width)} AS bin_id))"),
        ("binned", "filter(timed, p -> p.bin_id IS NOT NULL)"),
    )
    kept = [*by, "has_photometry"]
    rows, column = candidates.selectExpr(*kept, "photometry"), "photometry"
    for name, value in steps:
        rows, column = rows.selectExpr(*kept, f"inline(array(struct({value} AS {name})))"), name
    for i, band in enumerate(BANDS):
        own = f"transform(filter({column}, p -> p.band = {literal(band)}), p -> p.bin_id)"
        rows = rows.selectExpr("*", f"{own} AS bins_{i}")
    measures = {"n_obs": "size(bins_{})", "n_bins": "size(array_distinct(bins_{}))"}
    return rows.selectExpr(
        *kept,
        *[
            f"CASE WHEN {column} IS NULL THEN 0L ELSE bigint({measures[name].format(i)}) END AS {name}_{i}"
            for i in range(len(BANDS))
            for name in band_measures()
        ],
    )


def document_verdicts(
    candidates: DataFrame,
    bandsets: dict[str, tuple[str, ...]] = BANDSETS,
    min_observations: int = 3,
    all_bands: bool = False,
    bin_width: float = BIN_WIDTH,
    by: Sequence[str] = OBJECT,
) -> DataFrame:
    """``minimum_observations`` for the ``candidates`` of ``structure_objects``: the same columns and values."""
    counted = document_statistics(candidates, bin_width, by)
    return minimum_verdicts(outcomes(counted, {"all": BANDS} if all_bands else bandsets, min_observations, by), by)
