"""Keyword mining of structured log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyfold.session import written_table

# A row per file split, path and three numbers, may be broadcast up to this many.
BROADCAST_SPLITS = 100_000

def filter_lines(lines: DataFrame, keyword: str | None = None, negate: bool = False) -> DataFrame:
    """Lines containing ``keyword`` (case-sensitive), or with ``negate`` those not containing it."""
    if keyword is None:
        return lines
    matches = F.col("value").contains(keyword)
    return lines.where(~matches if negate else matches)


def message_text(lines: DataFrame) -> DataFrame:
    """Add ``text``, the message of a JSON log line; null where the line has none."""
    return lines.withColumn("text", F.get_json_object("value", "$.text"))


def number_lines(lines: DataFrame) -> DataFrame:
    """Number lines of ``read_log_lines`` from 1 in file and line order.

    The lines are read and written once, each with its place in its task; counts, offsets and numbers all come from what was
    written, so they agree however the files are split. Each split gets an offset from the counts of those before
    it: first within its file, then over the files. Up to ``BROADCAST_SPLITS`` offsets are broadcast, so that lines stay
    where they were written; beyond that Spark joins by split. The last window runs over one row per file, counts and no
    text.
    """
    placed = written_table(lines.withColumn("line_id", F.monotonically_increasing_id()))
    splits = placed.groupBy("file_path", "block_start").agg(
        F.count(F.lit(1)).alias("n_lines"), F.min("line_id").alias("first_line_id")
    )
    in_file = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)
    files = splits.groupBy("file_path").agg(F.sum("n_lines").alias("file_lines"))
    files = files.withColumn("file_offset", F.coalesce(F.sum("file_lines").over(before), F.lit(0)))
    offsets = written_table(
        splits.withColumn("in_file", F.coalesce(F.sum("n_lines").over(in_file), F.lit(0)))
        .join(files, "file_path")
        .selectExpr("file_path", "block_start", "first_line_id", "file_offset + in_file AS offset")
    )
    if offsets.count() <= BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    return (
        placed.join(offsets, ["file_path", "block_start"])
        .withColumn("number", F.col("offset") + F.col("line_id") - F.col("first_line_id") + 1)
        .drop("line_id", "first_line_id", "offset")
    )
