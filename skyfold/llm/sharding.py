"""Contiguous, balanced shards from global prefix sums of byte sizes.

Documents are put in identifier order by a range exchange of small rows (identifier, size, checksum; never the text).
Rows of one identifier, null ones too, are cut by size and checksum, and equal rows by where they were read, so that no
identifier meets in one partition. Each partition's totals are summed up over the partitions before it (one row per partition), and a window within
the partition adds the rest, which gives every row's place in the corpus in bytes and rows. The corpus is cut at
equal byte targets: a row belongs to the shard in which its middle lies, so that a shard misses its target by
less than the size of one document.

DataFrame and SQL functions only.

Defined cases: a null text has no bytes; rows without identifier come first; rows equal in identifier, size and
checksum are interchangeable; documents larger than a target leave shards empty; an empty table gives no rows. Texts
are only measured, whatever their length; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyfold.llm.common import identified
from skyfold.session import written_table

ROW_OVERHEAD = 16


def byte_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, shard, slot``; slots count from 0 within a shard."""
    sized = identified(docs, id_col, text_col).selectExpr(
        "doc_id", f"bigint(coalesce(octet_length(text), 0)) + {ROW_OVERHEAD} AS size", "crc32(coalesce(text, '')) AS text_crc32"
    )
    # Written, since a range exchange computed again may cut elsewhere.
    read = sized.withColumn("read", F.monotonically_increasing_id())
    ranges = read.repartitionByRange("doc_id", "size", "text_crc32", "read").drop("read")
    placed = written_table(ranges.withColumn("part", F.spark_partition_id()))
    totals = placed.groupBy("part").agg(F.sum("size").alias("part_size"), F.count(F.lit(1)).alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    numbered = placed.withColumn("size_to", F.sum("size").over(inside)).withColumn("row", F.row_number().over(inside))
    cut = written_table(
        numbered.join(offsets, "part").selectExpr(
            "doc_id",
            "size",
            "text_crc32",
            # Twice the middle of the row; decimals of a bigint's digits (a plain decimal has ten), as bytes times shards may exceed one.
            f"int((CAST(2 * (size_before + size_to) - size AS DECIMAL(20, 0)) * {shards}) div (2 * total)) AS shard",
            "rows_before + row - 1 AS place",
        )
    )
    firsts = cut.groupBy("shard").agg(F.min("place").alias("first_place"))
    # One row per shard: the number of shards bounds what is broadcast.
    return cut.join(F.broadcast(firsts), "shard").selectExpr(
        "doc_id", "size", "text_crc32", "shard", "place - first_place AS slot"
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write whole documents, one folder per shard, in slot order by file name and row. Identifiers must be unique.

    A shard is written by several tasks, each with a range of its slots.
    """
    places = assigned.select(F.col("doc_id").alias("_id"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    joined = docs.join(places, docs[id_col].eqNullSafe(places["_id"])).drop("_id")
    joined.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot").drop("_slot").withColumnRenamed(
        "_shard", "shard"
    ).write.partitionBy("shard").parquet(path)
