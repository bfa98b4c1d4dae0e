"""Binned light curves of a catalogue that grows: mergeable sums of every bin are stored, batch by batch.

A batch of new observations is reduced to the partial sums of its own bins and error decades, which go to a folder of its
own; what was stored before is neither read nor rewritten. The statistics of a bin merge the sums of all batches around the
overall mean, as those of a single run merge its error decades, and equal them to rounding. ``compact`` merges the batches so
far into one, so that a bin has at most as many rows as it has decades (about 1,050) and batches since.

Layout: ``<path>/width=<w>/batches/batch=<k>/{sums,limits}`` and ``<path>/width=<w>/merged/upto=<k>/{sums,limits}``. A
folder gets its name when it is complete, so a job that fails leaves nothing that counts. This needs a file system whose
renaming is atomic. Compacted batches remain for readers that have started, until the deployment removes them.

Defined cases: a batch that is stored already stays and its repetition is ignored; an empty batch changes nothing; an
observation given in two batches counts twice; batches may come in any order, but a new one at or below a compacted one is an
error; bins of several widths lie side by side; without any batch there are no bins to read, which is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyfold.operators.binning import BIN_WIDTH, NAME, binned_values, merged_statistics, partial_bins
from skyfold.sources.folders import folder_names, give_name

SUMS, LIMITS = "sums", "limits"
BATCHES, MERGED = "batches/batch=", "merged/upto="


def add_batch(
    light_curves: DataFrame, path: str, batch: int, bin_width: float = BIN_WIDTH, by: Sequence[str] = NAME
) -> None:
    """Store the partial sums of the new observations ``light_curves`` as batch number ``batch``, from 0."""
    spark, root = light_curves.sparkSession, _root(path, bin_width)
    if batch in _numbers(spark, root, BATCHES):
        return
    if batch <= (upto := _compacted(spark, root)):
        raise ValueError(f"batch {batch} comes after the compaction of batches up to {upto}")
    _store(spark, root, f"{BATCHES}{batch}", *partial_bins(light_curves, bin_width, by))


def binned_so_far(
    spark: SparkSession, path: str, bin_width: float = BIN_WIDTH, by: Sequence[str] = NAME, touched_by: int | None = None
) -> DataFrame:
    """``binned_light_curve`` of all batches; with ``touched_by`` only the bins that this batch has changed."""
    root = _root(path, bin_width)
    parts = [_stored(spark, root, kind) for kind in (SUMS, LIMITS)]
    if touched_by is not None:
        key = [*by, "band", "bin_id"]
        folder = f"{root}/{BATCHES}{touched_by}"
        sums, limits = (spark.read.parquet(f"{folder}/{kind}").select(*key) for kind in (SUMS, LIMITS))
        touched = sums.union(limits).toDF(*[f"_touched_{i}" for i in range(len(key))])
        parts = [
            part.join(touched, [part[name].eqNullSafe(touched[f"_touched_{i}"]) for i, name in enumerate(key)], "left_semi")
            for part in parts
        ]
    return binned_values(merged_statistics(parts[0], _merged_limits(parts[1], by), by), bin_width, by)


def compact(spark: SparkSession, path: str, bin_width: float = BIN_WIDTH, by: Sequence[str] = NAME) -> None:
    """Merge what is stored into one set of sums, in the place of the batches so far."""
    root = _root(path, bin_width)
    newest = max(_numbers(spark, root, BATCHES), default=-1)
    if newest > _compacted(spark, root):
        sums, limits = (_stored(spark, root, kind) for kind in (SUMS, LIMITS))
        _store(spark, root, f"{MERGED}{newest}", _merged_sums(sums, by), _merged_limits(limits, by))


def _merged_sums(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per bin and error decade.

    Centred sums of products add up with the products of the distances between the means of the rows and the mean over
    them, which a window puts beside the rows of a decade: as many as there are batches.
    """
    key = [*by, "band", "bin_id", "error_decade"]
    rows = Window.partitionBy(*key)
    means = {"f": "flux_sum / n", "w": "weight / n", "wf": "weight / n * (flux_sum / n) + s_w_f / n"}
    apart = (
        sums.selectExpr("*", *[f"{mean} AS mean_{name}" for name, mean in means.items()])
        .withColumns({f"overall_{name}": F.expr(f"sum(n * mean_{name})").over(rows) / F.sum("n").over(rows) for name in means})
        .selectExpr("*", *[f"mean_{name} - overall_{name} AS apart_{name}" for name in means])
    )
    return apart.groupBy(*key).agg(
        F.expr("sum(n) AS n"),
        F.expr("sum(n_finite) AS n_finite"),
        F.expr("sum(flux_sum) AS flux_sum"),
        # Read only of a bin with a single error.
        F.expr("max(first_error) AS first_error"),
        F.expr("sum(weight) AS weight"),
        F.expr("sum(s_w_f + n * apart_w * apart_f) AS s_w_f"),
        F.expr("sum(s_wf_f + n * apart_wf * apart_f) AS s_wf_f"),
    )


def _merged_limits(limits: DataFrame, by: Sequence[str]) -> DataFrame:
    key = [*by, "band", "bin_id"]
    lowest = limits.groupBy(*key).agg(
        F.expr("sum(n) AS n"), F.expr("sum(n_finite) AS n_finite"), F.expr("min(struct(limit_flux, limit_pos, limit_error)) AS lowest")
    )
    return lowest.selectExpr(*key, "n", "n_finite", "lowest.*")


def _store(spark: SparkSession, root: str, name: str, sums: DataFrame, limits: DataFrame) -> None:
    unfinished = f"{root}/unfinished/{uuid.uuid4().hex}"
    for kind, part in ((SUMS, sums), (LIMITS, limits)):
        part.write.parquet(f"{unfinished}/{kind}")
    give_name(spark, unfinished, f"{root}/{name}")


def _stored(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """The newest compaction and the batches since, each read from its own folder."""
    upto = _compacted(spark, root)
    names = [f"{BATCHES}{batch}" for batch in _numbers(spark, root, BATCHES) if batch > upto]
    if upto >= 0:
        names.append(f"{MERGED}{upto}")
    if not names:
        raise ValueError(f"no batch of bins is stored in {root}")
    return spark.read.parquet(*[f"{root}/{name}/{kind}" for name in names])


def _compacted(spark: SparkSession, root: str) -> int:
    return max(_numbers(spark, root, MERGED), default=-1)


def _numbers(spark: SparkSession, root: str, label: str) -> list[int]:
    folder, prefix = label.split("/")
    return sorted(int(name[len(prefix) :]) for name in folder_names(spark, f"{root}/{folder}"))


def _root(path: str, bin_width: float) -> str:
    return f"{path.rstrip('/')}/width={float(bin_width)!r}"
