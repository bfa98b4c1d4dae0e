"""Log files of one JSON object per line."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skyfold.operators.logs import message_text, number_lines
from skyfold.sources.catalog import escaped, load_folder


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file, or of every file directly inside a folder, with the place they were read from."""
    if _is_file(spark, path):
        lines = spark.read.text(escaped(path))
    else:
        lines = load_folder(spark.read.format("text"), spark, path, "*")
    return lines.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        "value",
    )


def _is_file(spark: SparkSession, path: str) -> bool:
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = named.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(named) and system.getFileStatus(named).isFile()


def write_collection(lines: DataFrame, collection: str, path: str) -> bool:
    """Write kept lines as the named collection: number, record and message text.

    The layout is partitioned JSON files instead of two files per record. Without lines nothing is written.
    """
    records = lines.transform(number_lines).transform(message_text)
    written = Observation()
    records.select(
        F.lit(collection).alias("collection"), "number", F.col("value").alias("record"), "text"
    ).observe(written, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("collection").json(path)
    if not written.get["n"]:
        warnings.warn("no lines to write", stacklevel=2)
        return False
    return True
