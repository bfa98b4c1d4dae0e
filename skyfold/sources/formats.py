"""Catalogues of other formats, as data sources that Spark reads by name.

A format is a subclass of ``CatalogFormat``: its name, the suffix of its files and a function from one file to objects. Once
registered (``spark.dataSource.register``), ``spark.read.format(name).load(folder)`` gives one row per object, its
document in the same JSON envelope as the files of ``sources.catalog``, or the reason why a file has none;
``read_catalog`` structures these rows, so that coercion and rejects are those of every other catalogue.

``read_catalog`` has the folder listed by tasks (``sources.listing``), which write the names down in as many lists as there are
partitions to fill by bytes; the driver plans a partition for each list and keeps no path. Read by format name alone, without such
lists, a folder is listed by the driver, which keeps a path and a size per file, as Spark's own file sources do. A
task holds one file at a time. Files of sub-folders are left out, names with ``_`` or ``.`` in front are read. A folder without such
files gives no rows; one that does not exist is an error.
"""

from __future__ import annotations

import csv
import json
from abc import abstractmethod
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skyfold.operators.structuring import REJECTED_INVALID, REJECTED_SCHEMA, structure_objects
from skyfold.schemas import PHOTOMETRY_FIELDS
from skyfold.session import scratch_dir, written_table
from skyfold.sources.catalog import task_path
from skyfold.sources.listing import list_names, located, spread, with_status

# A partition is full at so many bytes, where opening a file counts as reading some: about 0.1 ms were measured, and partitions
# of few small files take longer to plan and start than to read.
PARTITION_BYTES = 64 << 20
OPEN_COST_BYTES = 32 << 10

Objects = Iterable[tuple[str, dict[str, Any]]]


class UnknownLayout(ValueError):
    """The file is not laid out as its format demands."""


class CatalogFormat(DataSource):
    """Base of formats. ``name``, ``suffix`` and ``objects`` are the format's own.

    Options: ``partitionBytes`` and ``openCostBytes`` decide how files are packed; ``lists`` names a folder of Parquet files
    which hold the names to read (``file_name``), one for each partition, in place of listing and packing.
    """

    suffix: str

    @staticmethod
    @abstractmethod
    def objects(file_stem: str, content: bytes) -> Objects:
        """The objects of one file, as ``(stem, fields)``.

        A ``ValueError`` rejects the file as ``invalid``, an ``UnknownLayout`` as ``schema``; objects given before it stay.
        Any other exception fails the job.
        """

    def schema(self) -> str:
        return "file_stem string, value string, reason string, detail string"

    def reader(self, schema: Any) -> DataSourceReader:
        return FolderReader(
            self.options["path"],
            self.suffix,
            self.objects,
            int(self.options.get("partitionBytes", PARTITION_BYTES)),
            int(self.options.get("openCostBytes", OPEN_COST_BYTES)),
            self.options.get("lists"),
        )


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class ListedFiles(InputPartition):
    """The files whose names the Parquet file ``names`` holds."""

    names: str


@dataclass
class FolderReader(DataSourceReader):
    path: str
    suffix: str
    objects: Callable[[str, bytes], Objects]
    partition_bytes: int
    open_cost_bytes: int
    lists: str | None = None

    def partitions(self) -> list[InputPartition]:
        if self.lists is not None:
            system, folder = located(self.lists)
            written = system.get_file_info(FileSelector(folder))
            return [ListedFiles(f.path) for f in written if f.base_name.endswith(".parquet")] or [Files([])]
        system, folder = located(self.path)
        listed = system.get_file_info(FileSelector(folder))
        files = [(f.path, f.size) for f in listed if f.type == FileType.File and f.base_name.endswith(self.suffix)]
        return [Files(paths) for paths in packed(files, self.partition_bytes, self.open_cost_bytes)] or [Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str | None, str | None, str | None]]:
        system, _ = located(self.path)
        for path in self.paths(partition):
            file_stem = path.rsplit("/", 1)[-1].removesuffix(self.suffix)
            with system.open_input_stream(path, compression=None) as stream:
                content = stream.read()
            try:
                for stem, fields in self.objects(file_stem, content):
                    yield stem, json.dumps({stem: fields}, allow_nan=False), None, None
            except UnknownLayout as error:
                yield file_stem, None, REJECTED_SCHEMA, str(error)
            except ValueError as error:
                yield file_stem, None, REJECTED_INVALID, str(error)

    def paths(self, partition: InputPartition) -> Iterator[str]:
        if isinstance(partition, Files):
            yield from partition.paths
            return
        _, folder = located(self.path)
        system, _ = located(self.lists)
        with system.open_input_file(partition.names) as file:
            for batch in pq.ParquetFile(file).iter_batches(columns=["file_name"]):
                yield from (f"{folder}/{name}" for name in batch["file_name"].to_pylist())


def packed(files: list[tuple[str, int]], partition_bytes: int, open_cost_bytes: int) -> list[list[str]]:
    """Paths by partition, large files first; a file beyond the size of a partition has one to itself."""
    partitions: list[list[str]] = []
    filled = partition_bytes
    for path, size in sorted(files, key=lambda file: (-file[1], file[0])):
        if filled + size + open_cost_bytes > partition_bytes:
            partitions.append([])
            filled = 0
        partitions[-1].append(path)
        filled += size + open_cost_bytes
    return partitions


def read_catalog(spark: SparkSession, source: type[CatalogFormat], path: str, **options: Any) -> DataFrame:
    """Structured objects and rejects of a folder in another format."""
    spark.dataSource.register(source)
    folder = task_path(spark, path)
    lists = _name_lists(spark, folder, source.suffix, **options)
    documents = spark.read.format(source.name()).options(**options, lists=lists).load(folder)
    named = documents.withColumnsRenamed({"reason": "file_reason", "detail": "file_detail"})
    return structure_objects(named).selectExpr(
        "* EXCEPT (reason, detail, file_reason, file_detail)",
        "coalesce(file_reason, reason) AS reason",
        "if(file_reason IS NULL, detail, file_detail) AS detail",
    )


def _name_lists(
    spark: SparkSession, folder: str, suffix: str, partitionBytes: int = PARTITION_BYTES, openCostBytes: int = OPEN_COST_BYTES, **_: Any
) -> str:
    """A folder with the names of the files, dealt to one list for each partition."""
    sized = written_table(with_status(spread(list_names(spark, folder, suffix)), folder).select("file_name", "n_bytes"))
    n_bytes = sized.agg(F.sum(F.col("n_bytes") + int(openCostBytes))).first()[0] or 0
    path = scratch_dir(spark)
    sized.select("file_name").repartition(max(1, -(-n_bytes // int(partitionBytes))), "file_name").write.parquet(path)
    return task_path(spark, path)


class PhotometryTables(CatalogFormat):
    """One object per file: lines ``# key: value`` about the object, then its photometry as a table with column names.

    The columns are photometric fields under their catalogue names; an empty cell is an absent field, and flags are spelled
    ``true`` or ``false`` in letters of either case. ``# source:`` may repeat and numbers the sources; observations without a ``source`` of their own come from the first. Other keys
    become fields of the object (``name``, ``schema``).
    """

    suffix = ".csv"

    @classmethod
    def name(cls) -> str:
        return "photometry_tables"

    @staticmethod
    def objects(file_stem: str, content: bytes) -> Objects:
        lines = content.decode("utf-8").splitlines()
        about = [line[1:].partition(":") for line in lines if line.startswith("#")]
        rows = csv.reader((line for line in lines if line and not line.startswith("#")), strict=True)
        columns = next(rows, None)
        if columns is None or not set(columns) <= PHOTOMETRY_FIELDS.keys() or len(set(columns)) < len(columns):
            raise UnknownLayout("no photometric column names")
        try:
            table = [dict(zip(columns, row, strict=True)) for row in rows]
        except csv.Error as error:
            raise ValueError(f"table: {error}") from error
        fields: dict[str, Any] = {key.strip(): value.strip() for key, _, value in about if key.strip() != "source"}
        names = [value.strip() for key, _, value in about if key.strip() == "source"]
        fields["sources"] = [{"alias": str(i), "name": name} for i, name in enumerate(names, 1)]
        fields["photometry"] = [
            {"source": "1"} | {column: _value(column, cell) for column, cell in row.items() if cell != ""} for row in table
        ]
        yield file_stem, fields


def _value(column: str, cell: str) -> str | bool:
    if PHOTOMETRY_FIELDS[column] != "bool":
        return cell
    if cell.lower() not in ("true", "false"):
        raise ValueError(f"{column}: neither true nor false")
    return cell.lower() == "true"
