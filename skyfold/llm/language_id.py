"""Language identification by rank-order profiles.

A profile is a list of the most frequent character n-grams in order of frequency. Training counts the n-grams of all
labelled documents, summed first within a batch and partition, then per language over the cluster; a language keeps
its ``PROFILE`` most frequent ones, picked by each task first, so that no task holds all n-grams of a language. A document is compared with every language by the out-of-place distance: for each
of its own most frequent n-grams the difference of its ranks in document and language, and the greatest possible
difference where the language lacks it.

Letters are lower-cased; everything that is no letter separates words and counts as one space. N-grams have one to
three characters, packed into 63 bits. The broadcast profiles have at most ``PROFILE`` rows per language, and
``MAX_LANGUAGES`` bounds the languages; more are an error, not a cut.

Defined cases: text that is null or without any letter gets ``und`` and score 0; equal distances are resolved by the
language's name; equal counts by the n-gram; without labelled documents every text is ``und``. Whole texts are read however long
they are; repeated rows are rows of their own and count each time; an empty table gives no rows; further columns are not
read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyfold.llm.common import identified
from skyfold.session import written_table

UNDETERMINED = "und"
ORDERS = (1, 2, 3)
CHARACTER_BITS = 21
SPACE = 32
PROFILE = 400
MAX_LANGUAGES = 1000
CHUNK_CHARACTERS = 1_000_000


def learn_profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> DataFrame:
    """``lang, gram, rank`` from documents with a language; rank counts from 0."""
    texts = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    return written_table(ranked_grams(texts.mapInArrow(_count, "lang string, gram bigint, n bigint"), size))


def ranked_grams(counted: DataFrame, size: int) -> DataFrame:
    """``lang, gram, rank`` of the ``size`` most frequent n-grams of each language."""
    counts = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # Spark limits the groups before the exchange only where the place itself is bounded.
    ranked = counts.withColumn("place", F.row_number().over(by_count)).where(F.col("place") <= size)
    return ranked.selectExpr("lang", "gram", "place - 1 AS rank")


def identify(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """``doc_id, lang_pred, score``; the score is the distance to the next best language, relative to the greatest
    possible distance and raised so that a clear decision comes near 1.
    """
    n_languages = profiles.select("lang").distinct().count()
    if n_languages > MAX_LANGUAGES:
        raise ValueError(f"{n_languages} languages; at most {MAX_LANGUAGES} profiles are compared")
    learned = profiles.orderBy("lang", "rank").toPandas()  # at most size * MAX_LANGUAGES rows
    shared = docs.sparkSession.sparkContext.broadcast(_tables(learned, size))
    texts = identified(docs, id_col, text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, grams, ranks = shared.value
        for batch in batches:
            found = [_closest(text.as_py(), names, grams, ranks, size) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return texts.mapInArrow(predict, "doc_id bigint, lang_pred string, score double")


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def lettered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, has_letter``: whether a language can be determined at all."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([has_letter(text.as_py()) for text in batch.column(1)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["doc_id", "has_letter"])

    return identified(docs, id_col, text_col).mapInArrow(look, "doc_id bigint, has_letter boolean")


def grams_of(text: str) -> np.ndarray:
    """All n-grams of a text, packed."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, at = np.unique(points, return_inverse=True)
    letters = np.array([chr(c).isalpha() if c < 0x110000 else False for c in kinds.tolist()], bool)
    points = np.where(letters, kinds, SPACE)[at].astype(np.int64)
    points = np.concatenate(([SPACE], points, [SPACE]))
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != SPACE) | (points[:-1] != SPACE)
    points = points[keep]
    packed, parts = points, [points[points != SPACE]]
    for order in ORDERS[1:]:
        packed = (packed[:-1] << CHARACTER_BITS) | points[order - 1 :]
        # A space belongs to the word before or after it, not between two letters.
        parts.append(packed[points[1 : len(points) - order + 2] != SPACE] if order == 3 else packed)
    return np.concatenate(parts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_lang: dict[str, list[np.ndarray]] = {}
        size = 0
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            grams = grams_of(text.as_py())
            by_lang.setdefault(lang.as_py(), []).append(grams)
            size += len(grams)
            if size > CHUNK_CHARACTERS * len(ORDERS):
                yield from _summed(by_lang)
                by_lang, size = {}, 0
        yield from _summed(by_lang)


def _summed(by_lang: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for lang, parts in by_lang.items():
        grams, n = np.unique(np.concatenate(parts), return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n.astype(np.int64))], ["lang", "gram", "n"]
        )


def _tables(learned: pd.DataFrame, size: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language names, all profile n-grams in order, and their ranks per language (``size`` where absent)."""
    names = sorted(learned["lang"].unique())
    grams = np.unique(learned["gram"].to_numpy(np.int64))
    ranks = np.full((len(names), len(grams)), size, np.int32)
    where = {name: i for i, name in enumerate(names)}
    ranks[[where[x] for x in learned["lang"]], np.searchsorted(grams, learned["gram"])] = learned["rank"]
    return names, grams, ranks


def _closest(text: str | None, names: list[str], grams: np.ndarray, ranks: np.ndarray, size: int) -> tuple[str, float]:
    if not names or not has_letter(text):
        return UNDETERMINED, 0.0
    own, n = np.unique(grams_of(text), return_counts=True)
    top = own[np.argsort(-n, kind="stable")[:size]]
    at = np.minimum(np.searchsorted(grams, top), len(grams) - 1)
    known = grams[at] == top
    place = np.arange(len(top))
    # Out-of-place distance; an n-gram that no language knows is as far from each.
    differences = np.where(known, np.abs(ranks[:, at] - place), size)
    differences[(ranks[:, at] == size) & known] = size
    distances = differences.sum(axis=1)
    best = int(np.argmin(distances))
    others = np.delete(distances, best)
    margin = (others.min() - distances[best]) / (size * len(top)) if len(others) else 1.0
    return names[best], float(1 - np.exp(-10 * margin))
