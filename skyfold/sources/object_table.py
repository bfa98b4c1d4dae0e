"""The stored table of objects, laid out so that one object is found without reading the others.

Files hold their objects in the order of ``file_stem`` and a Bloom filter of the stems beside each row group. A lookup
reads the footers, skips the row groups whose smallest and largest stem or Bloom filter exclude the one sought, and
reads the rest. Without ``clustered`` nothing is exchanged: the objects stay in the tasks that parsed them, and the Bloom
filters do the work. With it a range exchange of the objects gives every file stems of its own, so that most
files are excluded by their bounds alone. The exchange samples the objects before it reads them, so they are written to the scratch
folder first and structured once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.session import written_table

# Small row groups, since one is what a lookup reads at least.
ROW_GROUP_BYTES = 16 << 20
FALSE_POSITIVES = 0.001


def write_objects(objects: DataFrame, path: str, clustered: bool = False, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Write structured objects, rejected ones included, in place of what ``path`` holds."""
    placed = written_table(objects).repartitionByRange("file_stem") if clustered else objects
    placed.sortWithinPartitions("file_stem").write.mode("overwrite").options(
        **{
            "parquet.block.size": row_group_bytes,
            "parquet.bloom.filter.enabled#file_stem": "true",
            "parquet.bloom.filter.adaptive.enabled": "true",
            "parquet.bloom.filter.fpp#file_stem": FALSE_POSITIVES,
        }
    ).parquet(path)


def read_object(spark: SparkSession, path: str, file_stem: str) -> DataFrame:
    """The rows of one object; none if it is not in the table."""
    return spark.read.parquet(path).where(F.col("file_stem") == file_stem)
