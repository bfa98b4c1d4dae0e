"""Incremental ingest and validation of a catalogue folder.

New files are registered first: a job lists the folder (``sources.listing``), leaves out the names registered before, orders the rest
by age and name, and deals them out in batches of ``batch_size`` files. Then a stream goes through the registered names, and
its tasks read the files. A micro-batch takes whole batches, as many as ``FILES_PER_TRIGGER`` files fill (one at least), so
that small batches do not cost a micro-batch each, and the driver keeps neither paths nor a log of all files.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, DataFrameReader, DataFrameWriter, SparkSession, Window
from pyspark.sql import functions as F

from skyfold.dims import BANDSETS
from skyfold.operators.document_checks import document_verdicts
from skyfold.operators.structuring import candidates, structure_objects
from skyfold.operators.unnest import OBJECT
from skyfold.operators.validation import bandset_flags
from skyfold.session import written_table
from skyfold.sources.catalog import document_names, is_hidden, task_path, texts_of
from skyfold.sources.folders import folder_names
from skyfold.sources.listing import NAMES_PER_TASK, STATS_PER_TASK, spread, with_status
from skyfold.sources.results import csv_rows

FILES_PER_TRIGGER = 100_000
REGISTERED = "file_name STRING, batch_id INT"
BATCH = ("batch_id", *OBJECT)
# Tasks that list the folders of batches: Spark's own setting means a task for each folder, which takes longer than its listing.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
LISTING_TASKS_PER_CORE = 4


def _read_once(batch: DataFrame) -> DataFrame:
    """Each name of a micro-batch once, also if a folder that changed while it was listed gave one twice.

    Only names and reading numbers are exchanged, and as many are broadcast as a micro-batch has files.
    """
    numbered = batch.withColumn("reading", F.monotonically_increasing_id())
    first = numbered.groupBy("file_stem").agg(F.min("reading").alias("reading"))
    return numbered.join(F.broadcast(first), ["file_stem", "reading"]).drop("reading")


def ingest_stream(spark: SparkSession, path: str, objects_path: str, checkpoint: str, batch_size: int) -> None:
    """Structure the files not yet seen, in batches of ``batch_size`` files, and stop.

    A batch replaces its own partition, so a batch repeated after a failure leaves the same table. Files are
    counted, not well-formed objects.
    """

    def write(texts: DataFrame, _: int) -> None:
        _by_batch(texts.transform(structure_objects)).parquet(objects_path)

    _each_batch(spark, path, checkpoint, batch_size, write)


def ingest_object_batches(
    spark: SparkSession, path: str, objects_path: str, counts_path: str, checkpoint: str, batch_size: int
) -> None:
    """Like ``ingest_stream``, with a column ``object_batch`` that counts well-formed objects: ``batch_size`` to a batch.

    The batches of objects go on over micro-batches, in order of batches and file names within one, and rejects (null) do not use
    them up. The number of objects so far is carried in ``counts_path``, one row per micro-batch, written before its
    objects and read by the next; a repeated micro-batch starts from the same number.
    """

    def write(texts: DataFrame, trigger: int) -> None:
        before = 0
        if trigger:
            before = spark.read.parquet(f"{counts_path}/batch_id={trigger - 1}").first().n_objects
        objects = texts.transform(structure_objects).persist()
        try:
            # One window over the names of a micro-batch, of which there are at most those of ``_files_per_trigger``.
            place = F.row_number().over(Window.orderBy("batch_id", "file_stem"))
            named = candidates(objects).select("file_stem", place.alias("place"))
            numbered = named.selectExpr("file_stem", f"({before} + place - 1) div {batch_size} AS object_batch")
            total = before + candidates(objects).count()
            spark.range(1).selectExpr(f"{total}L AS n_objects").write.mode("overwrite").parquet(f"{counts_path}/batch_id={trigger}")
            _by_batch(objects.join(F.broadcast(numbered), "file_stem", "left")).parquet(objects_path)
        finally:
            objects.unpersist()

    _each_batch(spark, path, checkpoint, batch_size, write)


def validate_stream(
    spark: SparkSession,
    path: str,
    csv_path: str,
    checkpoint: str,
    batch_size: int,
    bandsets: dict[str, tuple[str, ...]] = BANDSETS,
    min_observations: int = 3,
) -> None:
    """Validate the files not yet seen and export the valid objects with their band sets, batch by batch.

    Verdicts come from each document's own row, so a micro-batch reads its files, and writes. A batch replaces its
    own folder of CSV files.
    """

    def write(texts: DataFrame, _: int) -> None:
        objects = texts.transform(structure_objects)
        verdicts = document_verdicts(candidates(objects), bandsets, min_observations, by=BATCH)
        flags = bandset_flags(verdicts.where("is_valid"), by=BATCH)
        _by_batch(csv_rows(flags, kept=("batch_id",))).csv(csv_path, header=True)

    _each_batch(spark, path, checkpoint, batch_size, write)


def read_batches(spark: SparkSession, reader: DataFrameReader, file_format: str, path: str) -> DataFrame:
    """What ``reader`` finds in the stored batches below ``path``; their folders are listed now, each task listing many."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(LISTING_TASKS_PER_CORE * spark.sparkContext.defaultParallelism))
    try:
        return reader.format(file_format).load(path)
    finally:
        spark.conf.set(LISTING, before)


def _by_batch(rows: DataFrame) -> DataFrameWriter:
    """Writes ``rows`` in place of their batches."""
    return rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id")


def _files_per_trigger(batch_size: int) -> int:
    return max(1, FILES_PER_TRIGGER // batch_size) * batch_size


def _each_batch(
    spark: SparkSession, path: str, checkpoint: str, batch_size: int, write: Callable[[DataFrame, int], None]
) -> None:
    """``write(texts, number of the micro-batch)`` for the new files of ``path``: ``(file_stem, value, batch_id)``."""
    registered = f"{checkpoint}/registered"

    def read(batch: DataFrame, trigger: int) -> None:
        once = batch.withColumn("file_stem", F.col("file_name")).transform(_read_once).drop("file_stem")
        # The files of a small batch go to one task, which writes them as one file.
        part = F.pmod(F.xxhash64("file_name"), F.lit(-(-batch_size // NAMES_PER_TASK)))
        names = spread(once.withColumn("part", part), "batch_id", "part", n_names=batch.count()).drop("part")
        write(texts_of(spark, names, path), trigger)

    if not _register(spark, path, checkpoint, registered, batch_size):
        return
    query = (
        spark.readStream.schema(REGISTERED)
        .option("maxFilesPerTrigger", 1)
        .option("maxFileAge", "36500d")
        .parquet(registered)
        .writeStream.foreachBatch(read)
        .option("checkpointLocation", f"{checkpoint}/stream")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _register(spark: SparkSession, path: str, checkpoint: str, registered: str, batch_size: int) -> bool:
    """Deal the files not yet registered to batches, and write their names, a file for each micro-batch; whether any are registered.

    A batch never goes on with the files of a later call. Files whose names start with ``_`` or ``.`` are not streamed; a
    warning tells their number.
    """
    listed = document_names(spark, path)
    hidden = is_hidden(F.col("file_name"))
    n_listed, n_hidden = listed.agg(F.count(F.lit(1)), F.count_if(hidden)).first()
    if n_hidden:
        warnings.warn(f"{n_hidden} files are not streamed, as their names start with _ or .", stacklevel=4)
    new, n_new, n_batches = listed.where(~hidden), n_listed - n_hidden, 0
    known = "registered" in folder_names(spark, checkpoint)
    if known:
        before = spark.read.schema(REGISTERED).parquet(registered)
        new, n_new = new.join(before, "file_name", "left_anti"), None
        n_batches = before.agg(F.coalesce(F.max("batch_id") + 1, F.lit(0))).first()[0]
    # The oldest first. Ages are written down, as a sort reads its rows twice. Places go on within a partition of the sort, whose
    # offsets are summed over one row for each.
    spread_out = spread(new, n_names=n_new, per_task=STATS_PER_TASK)
    aged = written_table(with_status(spread_out, task_path(spark, path)).select("modified", "file_name"))
    ordered = written_table(aged.orderBy("modified", "file_name").withColumn("place", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("part", F.shiftright("place", 33))
    parts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    n_new, n_files = ordered.count() if n_new is None else n_new, _files_per_trigger(batch_size)
    if n_new:
        numbered = ordered.join(F.broadcast(parts), "part").withColumn("number", F.expr("offset + place - first"))
        numbered.selectExpr(
            "file_name", f"int({n_batches} + number div {batch_size}) AS batch_id", f"int(number div {n_files}) AS trigger"
        ).repartitionById(-(-n_new // n_files), F.col("trigger")).drop("trigger").write.mode("append").parquet(registered)
    return known or n_new > 0
