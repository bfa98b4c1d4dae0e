"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition turns its texts into digests. A run is the sorted list of one partition's distinct digests,
each with the identifier to keep and the number of rows. Runs are exchanged in rounds as in a binomial tree of
arity ``FAN_IN``: a round splits every run by the next digit of the digest and sends the pieces of ``FAN_IN``
neighbouring runs to one place, where they are merged and equal digests collapse to one entry. After
``log(runs)`` rounds one run is left per digest range, so no task ever holds the whole list, and a text that makes
up a third of the corpus is one entry per run after the first step.

Equal means: the same text after lower-casing A-Z only. Entries are merged only if digest, byte length and a second,
independent hash agree, at every level.

Defined cases: a null text counts as empty; a null identifier never wins over another; rows that repeat
identifier and text all carry the same decision (they are one document); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import identified
from skyfold.session import written_table

FAN_IN = 16
DIGIT_BITS = 4
NO_ID = np.iinfo(np.int64).min

DIGESTS = "doc_id bigint, run int, head bigint, digest binary, check bigint, n_bytes bigint"
RUNS = "cell bigint, run int, head bigint, digest binary, check bigint, n_bytes bigint, keep_id bigint, group_size bigint"
TEXT_KEY = ["digest", "check", "n_bytes"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its digest and the input partition (``run``) it was met in. Narrow."""
    texts = identified(docs, id_col, text_col).selectExpr("doc_id", "CAST(coalesce(text, '') AS BINARY) AS text")
    return texts.mapInArrow(_digest, DIGESTS)


def exact_groups(digested: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row per distinct text: ``digest, check, n_bytes, keep_id, group_size``.

    ``digested`` must be a written table, so that ``run`` stays what it was.
    """
    last_run = digested.agg(F.max("run")).first()[0] or 0
    # Identifiers are negated where the largest stays, so that every level retains the smallest.
    signed = "doc_id" if keep == "smallest" else "-doc_id"
    entries = digested.selectExpr(
        "bigint(0) AS cell", "run", "head", *TEXT_KEY, f"coalesce({signed}, {2**63 - 1}) AS keep_id", "bigint(1) AS group_size"
    )
    runs = _merged(entries)
    level = 0
    while last_run or not level:
        digit = f"shiftright(head, {56 - DIGIT_BITS * level}) & {FAN_IN - 1}"
        runs = _merged(runs.withColumn("cell", F.expr(f"cell * {FAN_IN} + ({digit})")).withColumn("run", F.expr(f"int(run div {FAN_IN})")))
        last_run //= FAN_IN
        level += 1
    kept = f"nullif(keep_id, {2**63 - 1})"
    return runs.selectExpr(*TEXT_KEY, f"{kept if keep == 'smallest' else f'-{kept}'} AS keep_id", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep`` names the identifier that stays in a group of equal texts, ``smallest`` or ``largest``.
    """
    digested = written_table(digests(docs, id_col, text_col))
    groups = exact_groups(digested, keep)
    # A group's result goes back over its runs, then to its rows within a run: the key of a frequent text is
    # spread over as many keys as there are runs.
    by_run = digested.groupBy("run", *TEXT_KEY).agg(F.lit(1).alias("one")).join(groups, TEXT_KEY).drop("one")
    return digested.join(by_run, ["run", *TEXT_KEY]).selectExpr(
        "doc_id", "keep_id", "group_size", "doc_id <=> keep_id AS kept", "lower(hex(digest)) AS text_sha256"
    )


def _merged(entries: DataFrame) -> DataFrame:
    """Bring the pieces of a run together in digest order and collapse equal entries."""
    placed = entries.repartition("cell", "run").sortWithinPartitions("cell", "run", *TEXT_KEY)
    return placed.mapInArrow(_collapse, RUNS)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = TaskContext.get().partitionId()
    for batch in batches:
        texts = [text.lower() for text in batch.column(1).to_pylist()]  # bytes: lowers A-Z only
        sums = [hashlib.sha256(text).digest() for text in texts]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(np.full(len(texts), run, np.int32)),
                pa.array([int.from_bytes(s[:8], "big") >> 4 for s in sums], pa.int64()),
                pa.array(sums, pa.binary()),
                pa.array([xxhash.xxh3_64_intdigest(text) >> 1 for text in texts], pa.int64()),
                pa.array([len(text) for text in texts], pa.int64()),
            ],
            ["doc_id", "run", "head", "digest", "check", "n_bytes"],
        )


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge neighbouring entries of one text; the last entry of a batch waits for the next batch."""
    waiting: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if waiting is not None:
            table = pa.concat_tables([waiting.cast(table.schema), table]).combine_chunks()
        columns = {name: table.column(name).to_numpy() for name in ("cell", "run", "check", "n_bytes", "keep_id", "group_size")}
        words = np.frombuffer(b"".join(table.column("digest").to_pylist()), np.uint64).reshape(-1, 4)
        new = np.ones(table.num_rows, bool)
        new[1:] = (words[1:] != words[:-1]).any(axis=1)
        for name in ("cell", "run", "check", "n_bytes"):
            new[1:] |= columns[name][1:] != columns[name][:-1]
        starts = np.flatnonzero(new)
        merged = table.take(pa.array(starts))
        for name, combine in (("keep_id", np.minimum), ("group_size", np.add)):
            at = merged.schema.get_field_index(name)
            merged = merged.set_column(at, merged.schema.field(at), pa.array(combine.reduceat(columns[name], starts)))
        waiting = merged.slice(len(starts) - 1)
        if len(starts) > 1:
            yield from merged.slice(0, len(starts) - 1).to_batches()
    if waiting is not None:
        yield from waiting.to_batches()
