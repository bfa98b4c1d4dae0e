"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed where the texts lie. Training takes a bounded, documented number of labelled
rows (``MAX_TRAINING_ROWS``, those with the smallest identifier hash), bins every statistic at its quantiles and grows
complete trees of fixed depth from gradient histograms. A model is a few flat arrays (split statistic, threshold,
leaf value per tree), so that scoring a batch is ``trees x depth`` numpy steps over all its rows at once.

Defined cases: null and empty texts have statistics of zero and are scored like any other; labels without a value
are ignored, of repeated labels of a document the largest counts; without any label every score is 0.5; with labels
of one kind only the scores are that kind's smoothed share.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import identified

MAX_TRAINING_ROWS = 20_000
BINS = 64
DEPTH = 4
TREES = 80
LEARNING_RATE = 0.15
LEAF_PENALTY = 1.0
MIN_HESSIAN = 1.0

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "word_length", "word_length_spread", "longest_word", "distinct_words", "repeated_triples",
    "commonest_word", "short_words", "sentence_ends", "words_a_line", "repeated_lines", "letters", "capitals", "digits", "spaces",
    "commas_and_stops", "symbols", "exclamations", "other_marks", "byte_entropy",
)


class Model(NamedTuple):
    """Trees as arrays: ``split`` and ``threshold`` per inner node, level by level; ``leaf`` per leaf."""

    base: float
    split: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray


def statistics(text: bytes) -> list[float]:
    if not text:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = len(text)
    words = text.split()
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    tally: dict[bytes, int] = {}
    for word in words:
        tally[word] = tally.get(word, 0) + 1
    triples = max(len(words) - 2, 1)
    lines = [line for line in text.split(b"\n") if line.strip()]
    lower, upper = int(counts[97:123].sum()), int(counts[65:91].sum())
    beyond = int(counts[192:].sum())  # lead bytes of characters outside ASCII
    share = counts[counts > 0] / size
    marks = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
    stops = int(counts[[44, 46]].sum())
    symbols = int(counts[[35, 42, 36, 37, 38, 124, 60, 62]].sum())
    return [
        np.log1p(size),
        np.log1p(len(words)),
        np.log1p(len(lines)),
        lengths.mean(),
        lengths.std(),
        np.log1p(lengths.max()),
        len(tally) / n,
        1 - len(set(zip(words, words[1:], words[2:]))) / triples if len(words) > 2 else 0.0,
        max(tally.values(), default=0) / n,
        float((lengths <= 3).mean()),
        sum(word.endswith(b".") for word in words) / n,
        len(words) / max(len(lines), 1),
        1 - len(set(lines)) / max(len(lines), 1),
        (lower + upper + beyond) / size,
        upper / max(lower + upper, 1),
        int(counts[48:58].sum()) / size,
        int(counts[[9, 10, 11, 12, 13, 32]].sum()) / size,
        stops / n,
        symbols / n,
        int(counts[33]) / n,
        (marks - stops - symbols - int(counts[33])) / n,
        float(-(share * np.log2(share)).sum()),
    ]


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_rows: int = MAX_TRAINING_ROWS,
) -> Model:
    """Fit on at most ``max_rows`` labelled documents; the statistics of these, and no texts, come to the driver."""
    chosen = (
        labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where("doc_id IS NOT NULL AND label IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    # ``max_rows`` bounds what is broadcast.
    rows = identified(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("label", "text")
    table = rows.mapInArrow(_labelled, "label int, statistics array<float>").toPandas()
    if table.empty:
        return fit(np.zeros((0, len(STATISTICS))), np.zeros(0))
    return fit(np.array(table["statistics"].tolist(), np.float32), table["label"].to_numpy(np.float64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score``. Narrow."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = predict(model, _matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "score"])

    return identified(docs, id_col, text_col).mapInArrow(scored, "doc_id bigint, score double")


def predict(model: Model, x: np.ndarray) -> np.ndarray:
    total = np.full(len(x), model.base)
    rows = np.arange(len(x))
    for split, threshold, leaf in zip(model.split, model.threshold, model.leaf, strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, split[node]] > threshold[node])
        total += leaf[node - (2**DEPTH - 1)]
    return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost complete trees on the logistic loss; all randomness-free, so equal rows give equal models."""
    n, width = x.shape
    inner = 2**DEPTH - 1
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    if not n or y.min() == y.max():
        return Model(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(width)])
    margin = np.full(n, base)
    splits, thresholds, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - y, p * (1 - p)
        split, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-6)
            cut = np.full(count, -1)
            for j in range(width):
                if not len(edges[j]):
                    continue
                cell = (node - first) * BINS + binned[j]
                g = np.bincount(cell, gradient, count * BINS).reshape(count, BINS).cumsum(axis=1)
                h = np.bincount(cell, hessian, count * BINS).reshape(count, BINS).cumsum(axis=1)
                gain = _gain(g, h) + _gain(g[:, -1:] - g, h[:, -1:] - h) - _gain(g[:, -1:], h[:, -1:])
                gain[(h < MIN_HESSIAN) | (h[:, -1:] - h < MIN_HESSIAN)] = 0
                gain = gain[:, : len(edges[j])]
                at = gain.argmax(axis=1)
                top = gain[np.arange(count), at]
                better = top > best
                best[better], cut[better] = top[better], at[better]
                split[first : first + count][better] = j
                threshold[first : first + count][better] = edges[j][at[better]]
            goes_right = x[np.arange(n), split[node]] > threshold[node]
            node = 2 * node + 1 + goes_right
        g = np.bincount(node - inner, gradient, inner + 1)
        h = np.bincount(node - inner, hessian, inner + 1)
        leaf = -LEARNING_RATE * g / (h + LEAF_PENALTY)
        margin += leaf[node - inner]
        splits.append(split)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Model(base, np.array(splits), np.array(thresholds), np.array(leaves))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + LEAF_PENALTY)


def _matrix(texts: pa.Array) -> np.ndarray:
    rows = [statistics((text or "").encode("utf-8", "surrogatepass")) for text in texts.to_pylist()]
    return np.array(rows, np.float32).reshape(len(rows), len(STATISTICS))


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        matrix = _matrix(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(matrix), pa.list_(pa.float32()))], ["label", "statistics"])


