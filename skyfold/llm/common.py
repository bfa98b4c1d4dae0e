"""What the document operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# White space that separates words: the class [\x20\x09-\x0D], for Java and DuckDB patterns alike.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(id_col: str, modulus: int, remainder: int) -> str:
    """SQL for "the checksum of the identifier's text has this remainder"; null identifiers count as empty text."""
    return f"crc32(coalesce(CAST({quoted(id_col)} AS STRING), '')) % {modulus} = {remainder}"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def identified(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the named columns, as ``doc_id`` (bigint), ``text`` and further ones: extra columns cannot clash."""
    return docs.select(
        F.col(quoted(id_col)).cast("bigint").alias("doc_id"), F.col(quoted(text_col)).alias("text"), *map(quoted, more)
    )


def let(value: str, name: str, body: str) -> str:
    """SQL ``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def sql_list(values: Iterable[str]) -> str:
    return ", ".join("'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" for value in values)
