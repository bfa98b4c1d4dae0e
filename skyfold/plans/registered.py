"""The registered queries: every operator on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold import dims
from skyfold.functions.coerce import finite_or_null
from skyfold.functions.timebins import bin_centre
from skyfold.operators import binning, growing_bins, unnest, validation
from skyfold.operators import light_curves as lc
from skyfold.operators import logs as log_ops
from skyfold.operators.document_checks import document_verdicts
from skyfold.operators.plotdata import plot_series as series_of
from skyfold.operators.structuring import candidates, rejects, structure_objects
from skyfold.plans import fixtures
from skyfold.session import scratch_dir, written_table
from skyfold.sources import catalog, formats, logs, object_table, results
from skyfold.streaming.catalog_stream import ingest_object_batches, ingest_stream, read_batches, validate_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

STREAM_BATCH = 100
MIN_BINS = 4
STRICT_MIN_BINS = 5
CATALOG_MIN_BINS = 1
NOMINAL_SIZE = 45162


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def rounded(column: str, places: int = 6) -> Column:
    return F.expr(f"round({finite_or_null(column)}, {places}) AS {column}")


# --- Photometry derivations and filters ---------------------------------------------------------------


@register
def flux_from_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived = fixtures.magnitudes_from_events(spark, sf_dir).transform(lc.derive_flux_and_magnitude)
    return derived.select("name", "pos", rounded("flux", 9))


@register
def magnitude_from_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived = fixtures.magnitudes_from_events(spark, sf_dir).transform(lc.derive_flux_and_magnitude)
    return derived.select("name", "pos", rounded("magnitude", 9))


@register
def zeropoint_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived = fixtures.magnitudes_from_events(spark, sf_dir).transform(lc.derive_flux_and_magnitude)
    return derived.groupBy("name").agg(
        F.count_if(F.col("zeropoint") == 1).alias("n_default"), F.count("zeropoint").alias("n_zeropoint")
    )


@register
def valid_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    observations = fixtures.magnitudes_from_events(spark, sf_dir).transform(lc.derive_flux_and_magnitude)
    complete = observations.withColumns({
        "time": F.when(F.col("pos") % 7 != 3, F.col("pos").cast("double")),
        "band_raw": F.when(F.col("pos") % 5 != 0, "B"),
    })
    return complete.transform(lc.valid_observations).select("name", "pos")


@register
def normalise_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    observations = fixtures.observations_from_events(spark, sf_dir)
    return observations.transform(lc.normalise_bands).select("name", "pos", "band_raw", "band")


@register
def supported_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    observations = fixtures.observations_from_events(spark, sf_dir)
    return observations.transform(lc.normalise_bands).transform(lc.supported_bands).select("name", "pos", "band")


@register
def light_curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.event_light_curves(spark, sf_dir)


@register
def band_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.event_light_curves(spark, sf_dir).transform(lc.band_counts)


@register
def candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as candidates, most of which have no observation."""
    tables = fixtures.event_tables(spark, sf_dir)
    return lc.candidate_counts(tables.candidates, tables.light_curves)


@register
def all_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = fixtures.event_tables(spark, sf_dir)
    selected = lc.select_bands(tables.candidates, tables.light_curves)
    return selected.select("name", "band_pos", "band", "pos", "time", "flux")


@register
def valid_candidate_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bands of the candidates that pass the checks, and of no other object."""
    tables = fixtures.event_tables(spark, sf_dir)
    valid = validation.filter_valid(tables.candidates, validation.check_results(tables, _checks()))
    return lc.select_bands(valid, tables.light_curves).select("name", "band_pos", "band", "pos", "time", "flux")


@register
def bandset_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = fixtures.event_tables(spark, sf_dir)
    selected = lc.select_bands(tables.candidates, tables.light_curves, dims.BANDSETS["gri_primed"])
    return selected.select("name", "band_pos", "band", "pos", "time", "flux")


@register
def band_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = lc.band_arrays(_catalog_curves(spark, sf_dir), unnest.OBJECT)
    return arrays.select(
        "name",
        "band",
        F.size("time").cast("bigint").alias("n_points"),
        _joined("flux").alias("flux"),
        _joined("e_flux").alias("e_flux"),
        _joined("upperlimit").alias("upperlimit"),
    )


def _joined(array: str) -> Column:
    """Array as text, thousandths for numbers, so that any engine renders it alike."""
    if array == "upperlimit":
        return F.array_join(F.transform(array, lambda x: x.cast("int").cast("string")), ",")
    thousandths = F.transform(array, lambda x: F.round(F.nullif(x, F.lit(float("nan"))) * 1000).cast("bigint").cast("string"))
    return F.array_join(thousandths, ",", "null")


@register
def band_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = lc.band_matrix(lc.band_arrays(_catalog_curves(spark, sf_dir), unnest.OBJECT))
    first, last = F.round(F.col("matrix")[2][0], 6), F.round(F.element_at(F.col("matrix")[2], -1), 6)
    return matrix.select(
        "name",
        "band",
        F.size("matrix").cast("bigint").alias("n_rows"),
        F.size(F.col("matrix")[0]).cast("bigint").alias("n_columns"),
        first.alias("first_flux"),
        last.alias("last_flux"),
    )


# --- Time binning -------------------------------------------------------------------------------------


@register
def bin_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = fixtures.event_light_curves(spark, sf_dir).transform(binning.assign_bins)
    return binned.selectExpr("name", "band", "pos", "bin_id", f"{bin_centre('bin_id', 3.0)} AS bin_centre")


def _event_bins(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    bins = fixtures.event_light_curves(spark, sf_dir).transform(binning.binned_light_curve)
    return bins.where(F.col("method") == method).select(
        "name", "band", "bin_id", rounded("flux"), rounded("e_flux"), "upperlimit", "n_obs"
    )


@register
def bins_all_upper_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_bins(spark, sf_dir, binning.UPPER_LIMIT)


@register
def bins_without_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_bins(spark, sf_dir, binning.PLAIN_MEAN)


@register
def bins_single_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_bins(spark, sf_dir, binning.SINGLE)


@register
def bins_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_bins(spark, sf_dir, binning.WEIGHTED)


def _lineitem_statistics(spark: SparkSession, sf_dir: str, statistic: str) -> DataFrame:
    statistics = fixtures.lineitem_light_curves(spark, sf_dir).transform(
        binning.bin_statistics, fixtures.LINEITEM_BIN_WIDTH
    )
    return statistics.where(F.col("method") == binning.WEIGHTED).select(
        "name", "band", "bin_id", "n_errors", rounded(statistic, 4)
    )


@register
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineitem_statistics(spark, sf_dir, "weighted_mean")


@register
def weighted_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineitem_statistics(spark, sf_dir, "sigma")


@register
def typical_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineitem_statistics(spark, sf_dir, "typical_error")


@register
def binned_light_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = fixtures.event_light_curves(spark, sf_dir).transform(binning.binned_light_curve)
    return bins.select(
        "name", "band", "bin_id", "time", "e_time", rounded("flux"), rounded("e_flux"), "upperlimit", "n_obs"
    )


@register
def binned_growing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins of a catalogue that came in three batches, two of them compacted."""
    path, points = scratch_dir(spark), fixtures.event_light_curves(spark, sf_dir)
    for batch in range(3):
        growing_bins.add_batch(points.where(F.col("pos") % 3 == batch), path, batch)
        if batch == 1:
            growing_bins.compact(spark, path)
    return growing_bins.binned_so_far(spark, path).select(
        "name", "band", "bin_id", "time", "e_time", rounded("flux"), rounded("e_flux"), "upperlimit", "n_obs"
    )


@register
def binned_light_curve_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = fixtures.lineitem_light_curves(spark, sf_dir).transform(
        binning.binned_light_curve, fixtures.LINEITEM_BIN_WIDTH
    )
    return bins.select(
        "name", "band", "bin_id", "time", "e_time", rounded("flux", 4), rounded("e_flux", 4), "upperlimit", "n_obs"
    )


# --- Validation ---------------------------------------------------------------------------------------


def _check(min_observations: int = MIN_BINS) -> validation.Check:
    return validation.minimum_observations(min_observations=min_observations)


def _checks() -> list[validation.Check]:
    return [_check(MIN_BINS), _check(STRICT_MIN_BINS)]


@register
def band_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.event_light_curves(spark, sf_dir).transform(validation.band_statistics)


@register
def photometry_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    results_ = _check().validate(fixtures.event_tables(spark, sf_dir))
    return results_.where(F.col("message") == validation.NO_PHOTOMETRY).select("name", "is_valid", "message")


@register
def min_observations_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _check().validate(fixtures.event_tables(spark, sf_dir)).select("name", "is_valid", "message")


@register
def min_observations_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as candidates against all line items, many bins per band."""
    suppliers = fixtures.read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("name"), F.lit(True).alias("has_photometry")
    )
    tables = validation.Tables(suppliers, fixtures.lineitem_light_curves(spark, sf_dir))
    check = validation.minimum_observations(
        {name: dims.BANDSETS[name] for name in ("BRI", "gri")}, 55, bin_width=fixtures.LINEITEM_BIN_WIDTH
    )
    return check.validate(tables).select("name", "is_valid", "message")


@register
def bandset_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = validation.bandset_results(fixtures.event_tables(spark, sf_dir), min_observations=MIN_BINS)
    return outcome.select("name", F.inline("bandsets")).select("name", "bandset", "is_valid", "message")


@register
def no_bandsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    check = validation.minimum_observations(bandsets={})
    return check.validate(fixtures.event_tables(spark, sf_dir)).select("name", "is_valid", "message")


@register
def every_band_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    check = validation.minimum_observations(min_observations=MIN_BINS, all_bands=True)
    return check.validate(fixtures.event_tables(spark, sf_dir)).select("name", "is_valid", "message")


@register
def available_bandsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = _check().validate(fixtures.event_tables(spark, sf_dir))
    return outcome.select("name", F.array_join("available_bandsets", ",").alias("available"))


@register
def bandset_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _check().validate(fixtures.event_tables(spark, sf_dir)).transform(validation.bandset_flags)


@register
def check_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.check_results(fixtures.event_tables(spark, sf_dir), _checks())


@register
def check_results_fail_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.check_results(fixtures.event_tables(spark, sf_dir), _checks(), fail_fast=True)


@register
def candidate_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = fixtures.event_tables(spark, sf_dir)
    return validation.candidate_validity(tables.candidates, validation.check_results(tables, _checks()))


@register
def valid_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = fixtures.event_tables(spark, sf_dir)
    return validation.filter_valid(tables.candidates, validation.check_results(tables, _checks()))


@register
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = validation.check_results(fixtures.event_tables(spark, sf_dir), _checks())
    return validation.report(outcome, only_errors=False)


@register
def validation_report_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.report(validation.check_results(fixtures.event_tables(spark, sf_dir), _checks()))


@register
def valid_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = fixtures.event_tables(spark, sf_dir)
    validity = validation.candidate_validity(tables.candidates, validation.check_results(tables, [_check()]))
    return validation.valid_ratio(validity).select("n_valid", "n_total", rounded("percent_valid"))


@register
def valid_ratio_nominal(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = fixtures.event_tables(spark, sf_dir)
    validity = validation.candidate_validity(tables.candidates, validation.check_results(tables, [_check()]))
    return validation.valid_ratio(validity, NOMINAL_SIZE).select("n_valid", "n_total", rounded("percent_valid"))


@register
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported table, read back from its files."""
    tables, check = fixtures.event_tables(spark, sf_dir), _check()
    outcome = check.validate(tables)
    valid = validation.filter_valid(validation.bandset_flags(outcome), outcome)
    path = scratch_dir(spark)
    results.write_csv(valid, path)
    return spark.read.csv(path, header=True, schema="name STRING, BRI STRING, gri STRING, `g'r'i'` STRING")


# --- Catalogue files and structuring ------------------------------------------------------------------


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.catalog_texts(spark, sf_dir).transform(structure_objects)


def _catalog_files(spark: SparkSession, sf_dir: str) -> str:
    """Folder with the catalogue written as one file per object."""
    path = scratch_dir(spark)
    fixtures.write_object_files(fixtures.catalog_texts(spark, sf_dir), path)
    return path


def _catalog_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    observations = unnest.observations(_objects(spark, sf_dir), unnest.LIGHT_CURVE_FIELDS)
    return lc.light_curves(observations.transform(lc.derive_flux_and_magnitude), unnest.OBJECT)


def _observation_columns(observations: DataFrame) -> DataFrame:
    return observations.transform(lc.derive_flux_and_magnitude).select(
        "name",
        "pos",
        "time",
        "band_raw",
        rounded("flux", 9),
        rounded("magnitude", 9),
        rounded("e_flux"),
        "zeropoint",
        "upperlimit",
    )


@register
def catalog_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_files(spark, _catalog_files(spark, sf_dir)).select("file_name")


@register
def catalog_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan the catalogue folder and unnest the photometry of its well-formed objects."""
    texts = catalog.read_texts(spark, _catalog_files(spark, sf_dir))
    return texts.transform(structure_objects).transform(unnest.observations).transform(_observation_columns)


@register
def catalog_load_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = catalog.read_text(spark, _catalog_files(spark, sf_dir), "0.0")
    return text.transform(structure_objects).transform(unnest.observations).transform(_observation_columns)


def _table_files(spark: SparkSession, sf_dir: str) -> str:
    """Folder with the catalogue in another format, one table per object. Tables and rejects are two branches, so objects are structured once before."""
    path = scratch_dir(spark)
    objects = written_table(_objects(spark, sf_dir).select("file_stem", "name", "photometry", "reason"))
    fixtures.write_object_files(fixtures.photometry_tables(objects), path, formats.PhotometryTables.suffix)
    return path


@register
def catalog_format_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The photometry of a catalogue in another format."""
    objects = formats.read_catalog(spark, formats.PhotometryTables, _table_files(spark, sf_dir))
    return candidates(objects).transform(unnest.observations).transform(_observation_columns)


@register
def catalog_format_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = formats.read_catalog(spark, formats.PhotometryTables, _table_files(spark, sf_dir))
    return rejects(objects).select("file_stem", "reason", "detail")


@register
def catalog_table_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One object from the stored table."""
    path = scratch_dir(spark)
    object_table.write_objects(_objects(spark, sf_dir), path, clustered=True)
    found = candidates(object_table.read_object(spark, path, "0.0"))
    return found.transform(unnest.observations).transform(_observation_columns)


@register
def catalog_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects per micro-batch of a streamed ingest."""
    objects = scratch_dir(spark)
    ingest_stream(spark, _catalog_files(spark, sf_dir), objects, scratch_dir(spark), STREAM_BATCH)
    return (
        read_batches(spark, spark.read, "parquet", objects)
        .groupBy(F.col("batch_id").cast("bigint").alias("batch_id"))
        .agg(F.count(F.lit(1)).alias("n_objects"))
    )


@register
def catalog_stream_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of a streamed ingest, which equal those of the batch scan."""
    objects = scratch_dir(spark)
    ingest_stream(spark, _catalog_files(spark, sf_dir), objects, scratch_dir(spark), STREAM_BATCH)
    return read_batches(spark, spark.read, "parquet", objects).select("file_stem", "has_photometry", "reason")


@register
def catalog_stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Well-formed objects per batch of objects of a streamed ingest."""
    objects = scratch_dir(spark)
    ingest_object_batches(spark, _catalog_files(spark, sf_dir), objects, scratch_dir(spark), scratch_dir(spark), STREAM_BATCH)
    return read_batches(spark, spark.read, "parquet", objects).groupBy("object_batch").agg(F.count(F.lit(1)).alias("n_objects"))


@register
def catalog_stream_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid objects and their band sets from a streamed validation."""
    exported = scratch_dir(spark)
    validate_stream(
        spark, _catalog_files(spark, sf_dir), exported, scratch_dir(spark), STREAM_BATCH, min_observations=CATALOG_MIN_BINS
    )
    columns = "name STRING, " + ", ".join(f"`{flag}` BOOLEAN" for flag in results.CSV_FLAGS.values())
    return read_batches(spark, spark.read.schema(f"{columns}, batch_id INT").option("header", True), "csv", exported).drop("batch_id")


@register
def catalog_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts from the documents themselves."""
    verdicts = document_verdicts(candidates(_objects(spark, sf_dir)), min_observations=CATALOG_MIN_BINS)
    return verdicts.select("name", "is_valid", "message", F.array_join("available_bandsets", ",").alias("available"))


@register
def catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = (entry[0] for entry in dims.CATALOGS)
    origin = F.when(F.length("file_stem") % 2 == 0, first).otherwise(second)
    objects = _objects(spark, sf_dir).withColumn("catalog", origin)
    return results.catalog_summary(dims.catalogs(spark), objects).select(
        "catalog", "path", "nr_datapoints", "n_loaded", "n_rejected"
    )


@register
def catalog_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _objects(spark, sf_dir).transform(unnest.observations).transform(_observation_columns)


@register
def catalog_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(_objects(spark, sf_dir)).select("file_stem", "name", "schema", "has_photometry")


@register
def catalog_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects(_objects(spark, sf_dir))


@register
def time_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    observations = unnest.observations(_objects(spark, sf_dir), ("time",))
    return observations.select("name", "pos", "time")


@register
def field_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    observations = unnest.observations(_objects(spark, sf_dir), ("e_time", "e_flux", "upperlimit", "zeropoint"))
    return observations.groupBy("name").agg(
        F.count_if(F.isnan("e_time")).alias("n_nan_e_time"),
        F.count_if(F.isnan("e_flux")).alias("n_nan_e_flux"),
        F.count_if(~F.col("upperlimit")).alias("n_not_limit"),
        F.count_if(F.col("zeropoint").isNull()).alias("n_no_zeropoint"),
    )


@register
def sources_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unnest.sources(_objects(spark, sf_dir)).select(
        "name", "pos", F.col("alias").cast("bigint").alias("alias"), "source_name", "secondary"
    )


@register
def quantities_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unnest.quantities(_objects(spark, sf_dir)).select(
        "name",
        "quantity",
        "pos",
        "value_str",
        "value_num",
        "source",
        "e_value",
        F.col("correlation.quantity").alias("correlation_quantity"),
        F.col("correlation.value_num").alias("correlation_value"),
    )


@register
def spectra_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unnest.spectra(_objects(spark, sf_dir)).select(
        "name",
        "pos",
        "time",
        "u_wavelengths",
        "u_fluxes",
        F.col("exclude.above").alias("exclude_above"),
        F.size("data").cast("bigint").alias("n_points"),
    )


@register
def spectrum_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = unnest.spectra(_objects(spark, sf_dir)).transform(unnest.spectrum_points)
    return points.select("name", "point_pos", "wavelength", "flux")


@register
def catalog_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From JSON documents to binned light curves. Binning reads its points in two branches, so the documents are parsed once before."""
    bins = binning.binned_light_curve(written_table(_catalog_curves(spark, sf_dir)), by=unnest.OBJECT)
    return bins.select("name", "band", "bin_id", rounded("flux"), rounded("e_flux"), "upperlimit", "n_obs")


# --- Logs and plot data -------------------------------------------------------------------------------


def _log_files(spark: SparkSession, sf_dir: str) -> str:
    """Folder of log files holding the events' log lines in order of their ids."""
    path = scratch_dir(spark)
    ordered = fixtures.log_lines(spark, sf_dir).repartitionByRange("event_id").sortWithinPartitions("event_id")
    ordered.select("value").write.text(path)
    return path


@register
def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.read_log_lines(spark, _log_files(spark, sf_dir)).select("value")


@register
def log_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_ops.filter_lines(fixtures.log_lines(spark, sf_dir), "error")


@register
def log_keyword_negated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_ops.filter_lines(fixtures.log_lines(spark, sf_dir), "click", negate=True)


@register
def log_unfiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_ops.filter_lines(fixtures.log_lines(spark, sf_dir))


@register
def log_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.log_lines(spark, sf_dir).transform(log_ops.message_text).select("event_id", "text")


@register
def log_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = log_ops.filter_lines(logs.read_log_lines(spark, _log_files(spark, sf_dir)), "click")
    return kept.transform(log_ops.number_lines).select("number", "value")


@register
def log_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = log_ops.filter_lines(logs.read_log_lines(spark, _log_files(spark, sf_dir)), "error")
    path = scratch_dir(spark)
    logs.write_collection(kept, "errors", path)
    return spark.read.schema("number BIGINT, record STRING, text STRING, collection STRING").json(path)


@register
def plot_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_of(fixtures.event_light_curves(spark, sf_dir))


@register
def plot_series_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = fixtures.event_light_curves(spark, sf_dir).transform(binning.binned_light_curve)
    selected = {name: dims.BANDSETS[name] for name in ("BRI", "gri")}
    return series_of(bins, selected).select("name", "bandset", "series", "x", rounded("y"), rounded("y_error"))
