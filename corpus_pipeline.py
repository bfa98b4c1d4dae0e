"""A corpus from raw documents: language, exact copies, near copies, mixing, tokens.

Every stage takes ``(spark, docs, sf_dir)``; the next one gets its written result. All but the last return the columns of
``docs``, whatever further ones there are.

Defined cases: decisions are made by row, also where an identifier is null or repeated. Of equal texts and of near copies the smallest
identifier stays; rows whose identifier is null or repeated come after all others, in the order they are read. Null texts
and texts without a letter go in the first stage, texts without words therefore too. An empty table passes through.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.llm import exact_dedup, language_id, mixing, ngram_join, sentencepiece_codec
from skyfold.llm.common import quoted, read_documents
from skyfold.session import written_table

# Identifiers that may be broadcast, 8 bytes each.
BROADCAST_ROWS = 1_000_000
BATCH_ROWS = 2000
NEAR_WORDS = 5
NEAR_PERCENT = 80
PIECE_MODEL = os.environ.get("SKYFOLD_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be determined: no text or no letter."""
    keyed, row = _keyed(spark, docs)
    profiles = language_id.learn_profiles(keyed)
    if profiles.isEmpty():  # no language was learned: only what identification could never determine goes
        return _staying(keyed, row, language_id.lettered(keyed, row).selectExpr("doc_id", "has_letter AS kept"))
    found = language_id.identify(keyed, profiles, row)
    return _staying(keyed, row, found.selectExpr("doc_id", f"lang_pred <> '{language_id.UNDETERMINED}' AS kept"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest identifier stays."""
    keyed, row = _keyed(spark, docs)
    return _staying(keyed, row, exact_dedup.exact_dedup(keyed, row, keep="smallest").select("doc_id", "kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a component of near copies the document with the smallest identifier stays."""
    keyed, row = _keyed(spark, docs)
    components = ngram_join.jaccard_components(keyed, NEAR_WORDS, NEAR_PERCENT, row, count_links=False)
    return _staying(keyed, row, components.selectExpr("doc_id", "doc_id = component_id AS kept"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat every document as often as the mix takes it; documents not taken go."""
    keyed, row = _keyed(spark, docs)
    mixed = mixing.mix(keyed, id_col=row)
    taken = mixed.where("times > 0").selectExpr("doc_id AS _taken", "array_repeat(0, times) AS _copies")
    joined = keyed.join(taken, keyed[row] == taken["_taken"])
    return joined.select(*[keyed[quoted(name)] for name in docs.columns], F.explode(taken["_copies"]).alias("_copy")).drop("_copy")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The identifiers of every document, verified against the reference encoder and by decoding."""
    _bound_batches(spark)
    return sentencepiece_codec.encode(docs, PIECE_MODEL)


STAGES = [
    ("language", identify_language),
    ("exact_copies", drop_exact_copies),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: SQL cannot express rank-order profiles, the budget fitting and the encoding; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def _keyed(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells rows apart, and its name.

    It is the identifier where that is the row's own. Only if an identifier is null or repeated, ``docs`` is written once more, with new
    numbers for such rows, beyond all identifiers.
    """
    _bound_batches(spark)
    row = "_row"
    while row in docs.columns:
        row += "_"
    shared = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL")
    if shared.isEmpty():
        return docs.withColumn(row, F.col("doc_id")), row
    shared = written_table(shared.select(F.col("doc_id").alias("_shared_id")))
    if shared.count() <= BROADCAST_ROWS:
        shared = F.broadcast(shared)
    least, most = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    number = F.monotonically_increasing_id()
    new = F.lit((most or 0) + 1) + number if (most or 0) < 2**62 else F.lit(least - 1) - number
    joined = docs.join(shared.withColumn("_is_shared", F.lit(True)), docs["doc_id"].eqNullSafe(shared["_shared_id"]), "left")
    own = F.when(F.col("_is_shared"), new).otherwise(docs["doc_id"]).alias(row)
    return written_table(joined.select(*[docs[quoted(name)] for name in docs.columns], own)), row


def _bound_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of at most ``BATCH_ROWS`` rows, to bound the memory of workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def _staying(keyed: DataFrame, row: str, decisions: DataFrame) -> DataFrame:
    """The rows that are to stay, without ``row``; ``decisions`` has one ``doc_id, kept`` for each value of ``row``.

    What goes is written and counted: up to ``BROADCAST_ROWS`` numbers are broadcast, so that texts stay in place;
    beyond that Spark joins by exchange.
    """
    going = written_table(decisions.where("NOT kept").select(F.col("doc_id").alias("_going")))
    if going.count() <= BROADCAST_ROWS:
        going = F.broadcast(going)
    return keyed.join(going, keyed[row] == going["_going"], "left_anti").drop(row)
