"""Language-model scores from a log-frequency Bloom filter.

Counting. A pass over the training texts counts words and word pairs in chunks, packs the counts into binary blocks by
hash segment, and Spark brings the blocks of a segment together: segments grow in number, not in size, with the corpus.

Filter. A count of a pair is quantised to the levels of ``LEVELS``; the pair is entered once for every level up to its
own, each time under another hash. Asking for level 1, 2, ... until one is missing gives the quantised count; a false
positive can only raise it. Every segment owns a stretch of the bit array, of ``PAIR_BITS`` per training token whatever the
corpus. The stretches stay in a written table, one row per segment; neither the driver nor a task holds them all.

Score. Documents are packed in chunks. A chunk asks every segment for its distinct pairs and its distinct words that are
not frequent; the segments answer in the order asked, and the answers return to the chunk in a shuffle. Counts of the most
frequent words (``MAX_FREQUENT``, 16 bytes each) are broadcast, other words are answered from their segment: all word
counts are exact. The probability of a word after another is interpolated, ``w c(uv) / c(u) + (1 - w) p(v)``, with the
pair's quantised count, add-one ``p(v) = (c(v) + 1) / (N + V + 1)`` and a weight ``w`` that grows with ``c(u)``.

Base. The add-one unigram score, from the same exact counts.

Every text ends with one end token; words are lower-cased in A-Z. Words are known by 64-bit hashes.

Defined cases: a null or empty text is the end token alone; repeated rows are scored, and counted, each; without
training documents all counts are zero; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import identified
from skyfold.llm.hashing import mixed, word_hashes
from skyfold.session import written_table

END = np.uint64(0xE4D0E4D0E4D0E4D0)
BEGIN = np.uint64(0xBE610BE610BE610B)
LEVELS = np.unique(np.concatenate(([1, 2, 3, 4], np.round(2 ** (np.arange(5, 96) / 2)).astype(np.int64))))
PROBES = 3
PAIR_BITS = 6  # per training token
MAX_FREQUENT = 400_000
PAIR_WEIGHT = 0.4
RELIABLE_COUNT = 5.0
CHUNK_BYTES = 6_000_000
ROW_BYTES = 16  # that a row counts besides its text
SEGMENT_TOKENS = 2_000_000
MIN_SEGMENTS = 64
LOW = np.uint64((1 << 40) - 1)
# Rows of megabytes are written, and read, one by one: the size of a row group would not be looked at before a hundred rows.
LARGE_ROWS = {"parquet.block.row.count.limit": 1}

BLOCKS = "segment int, kind string, grams binary, counts binary"
COUNTS = "segment int, grams binary, counts binary, types bigint, tokens bigint, by_level array<bigint>"
PACKED = "chunk bigint, doc_ids array<bigint>, texts array<binary>"
ASKED = "chunk bigint, segment int, grams binary"
ANSWERED = "chunk bigint, segment int, kind string, answer binary"
SCORED = "doc_id bigint, n_tokens bigint, n_known bigint, logs double, score double"


class Filter(NamedTuple):
    """Bits of all segments, each ``segment_bits`` long."""

    bits: np.ndarray
    segments: int
    segment_bits: int

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """Quantised counts: the middle of the highest level reached, 0 for grams not met."""
        return _MIDDLES[self.levels(grams)]

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """Number of levels reached."""
        level = np.zeros(len(grams), np.int64)
        if not self.segment_bits:
            return level
        active = np.arange(len(grams))
        start = segment_of(grams, self.segments).astype(np.int64) * self.segment_bits
        low = grams & LOW
        for j in range(len(LEVELS)):
            hit = np.ones(len(active), bool)
            for place in _places(low[active], j, self.segment_bits):
                at = start[active] + place
                hit &= (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            active = active[hit]
            if not len(active):
                break
            level[active] = j + 1
        return level


class LanguageModel(NamedTuple):
    tokens: int
    types: int
    documents: int
    counted: DataFrame  # exact word counts, one row per segment
    pairs: DataFrame  # bits of the pairs' filter, one row per segment
    pair_bits: int  # of a segment
    segments: int
    frequent: Broadcast  # of (frequent words, their counts)


_MIDDLES = np.concatenate(([0], np.floor(np.sqrt(LEVELS[:-1].astype(float) * np.maximum(LEVELS[1:] - 1, LEVELS[:-1]))), LEVELS[-1:])).astype(np.int64)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LanguageModel:
    spark = docs.sparkSession
    texts = identified(docs, id_col, text_col).selectExpr("CAST(coalesce(text, '') AS BINARY) AS text")
    documents, size = texts.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    segments = max(MIN_SEGMENTS, (size or 0) // (4 * SEGMENT_TOKENS))
    blocks = texts.mapInArrow(_counter(segments, "word"), BLOCKS)
    counted = written_table(blocks.groupBy("segment").applyInArrow(_summed, COUNTS))
    totals = counted.agg(F.sum("types"), F.sum("tokens")).first()
    types, tokens = (int(x or 0) for x in totals)
    pair_bits = _segment_bits(PAIR_BITS * tokens, segments)
    blocks = texts.mapInArrow(_counter(segments, "pair"), BLOCKS)
    pairs = written_table(blocks.groupBy("segment").applyInArrow(_bits_of_blocks(pair_bits), "segment int, bits binary"))
    frequent = spark.sparkContext.broadcast(_frequent(counted))
    return LanguageModel(tokens, types, int(documents), counted, pairs, pair_bits, segments, frequent)


def score(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score``; logarithms to base 10."""
    texts = identified(docs, id_col, text_col).selectExpr("doc_id", "CAST(coalesce(text, '') AS BINARY) AS text")
    packed = written_table(texts.mapInArrow(_packed, PACKED), **LARGE_ROWS)  # written: numbers of chunks must not change
    words = packed.mapInArrow(_asked("word", model.segments, model.frequent), ASKED).groupBy("segment")
    pairs = packed.mapInArrow(_asked("pair", model.segments, model.frequent), ASKED).groupBy("segment")
    answers = words.cogroup(model.counted.groupBy("segment")).applyInArrow(_word_answers, ANSWERED)
    answers = answers.unionByName(pairs.cogroup(model.pairs.groupBy("segment")).applyInArrow(_pair_answers(model.pair_bits), ANSWERED))
    numbers = (model.tokens, model.types, model.documents, model.segments)
    scored = packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scorer(model.frequent, *numbers), SCORED)
    unit = float(np.log10(model.tokens + model.types + 1))
    return scored.selectExpr(
        "doc_id",
        "n_tokens",
        "n_known",
        f"bigint({model.tokens}) AS train_tokens",
        f"logs - n_tokens * {unit!r}D AS base_score",
        "score",
    )


def segment_of(grams: np.ndarray, segments: int) -> np.ndarray:
    return (grams >> np.uint64(40)) % np.uint64(segments)


def pair_hashes(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mixed(mixed(before) ^ words)


def _segment_bits(bits: int, segments: int) -> int:
    """Bits per segment, whole bytes, for so many bits in all."""
    return -(-bits // segments) // 8 * 8 + 8 if bits else 0


def _frequent(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The words from the lowest level on at which they are at most ``MAX_FREQUENT``, with counts, sorted by hash."""
    levels = counted.selectExpr("posexplode(by_level) AS (level, n)").groupBy("level").agg(F.sum("n").alias("n")).toPandas()
    by_level = levels.sort_values("level", ascending=False)
    fitting = by_level[by_level["n"].cumsum() <= MAX_FREQUENT]["level"]
    if fitting.empty:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least = int(LEVELS[fitting.min()])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grams, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams, counts = np.frombuffer(grams, np.int64), np.frombuffer(counts, np.int64)
                keep = counts >= least
                yield pa.RecordBatch.from_arrays([pa.array(grams[keep]), pa.array(counts[keep])], ["gram", "n"])

    table = counted.select("grams", "counts").mapInArrow(pick, "gram bigint, n bigint").toPandas()
    grams = table["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], table["n"].to_numpy(np.int64)[order]


# --- inside tasks -------------------------------------------------------------------------------------


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[bytes]]]:
    """Identifiers (the first of two columns) and texts of rows of about ``CHUNK_BYTES``."""
    size, ids, texts = 0, [], []
    for batch in batches:
        for i, text in enumerate(batch.column(batch.num_columns - 1)):
            text = text.as_py()
            if texts and size + len(text) > CHUNK_BYTES:
                yield ids, texts
                size, ids, texts = 0, [], []
            ids.append(batch.column(0)[i].as_py() if batch.num_columns > 1 else None)
            texts.append(text)
            size += len(text) + ROW_BYTES
    if texts:
        yield ids, texts


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens with the end of each row, the token before each, and the number of tokens per row."""
    rows = [word_hashes(text.lower()) for text in texts]
    end, begin = np.array([END]), np.array([BEGIN])
    tokens = np.concatenate([x for row in rows for x in (row, end)])
    before = np.concatenate([x for row in rows for x in (begin, row)])
    return tokens, before, np.array([len(row) + 1 for row in rows])


def _counter(segments: int, kind: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _chunks(batches):
            tokens, before, _ = _tokens(texts)
            grams, counts = np.unique(tokens if kind == "word" else pair_hashes(before, tokens), return_counts=True)
            yield from _blocks(kind, grams, counts, segments)

    return count


def _blocks(kind: str, grams: np.ndarray, counts: np.ndarray, segments: int) -> Iterator[pa.RecordBatch]:
    """One block per segment. Pairs keep the 40 bits that the filter looks at; counts of one are not written, as these
    grams stand last."""
    where = segment_of(grams, segments).astype(np.int64)
    order = np.lexsort((counts == 1, where))
    grams, counts, where = grams[order], counts[order], where[order]
    cuts = np.searchsorted(where, np.arange(segments + 1))
    found = [s for s in range(segments) if cuts[s] < cuts[s + 1]]
    packed = np.ascontiguousarray(grams).view(np.uint8).reshape(-1, 8)
    if kind == "pair":
        packed = packed[:, :5]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(found, pa.int32()),
            pa.array([kind] * len(found), pa.string()),
            pa.array([packed[cuts[s] : cuts[s + 1]].tobytes() for s in found], pa.binary()),
            pa.array([_many(counts[cuts[s] : cuts[s + 1]]).astype(np.int32).tobytes() for s in found], pa.binary()),
        ],
        ["segment", "kind", "grams", "counts"],
    )


def _many(counts: np.ndarray) -> np.ndarray:
    return counts[: int((counts > 1).sum())]


def _merged(blocks: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    parts, counts = [], []
    for grams, many in zip(blocks.column("grams").to_pylist(), blocks.column("counts").to_pylist(), strict=True):
        raw = np.frombuffer(grams, np.uint8).reshape(-1, width)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :width] = raw
        parts.append(wide.view(np.uint64).ravel())
        own = np.ones(len(raw), np.int64)
        many = np.frombuffer(many, np.int32)
        own[: len(many)] = many
        counts.append(own)
    grams, n = np.concatenate(parts), np.concatenate(counts)
    order = np.argsort(grams)
    grams, n = grams[order], n[order]
    starts = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    return grams[starts], np.add.reduceat(n, starts)


def _summed(blocks: pa.Table) -> pa.Table:
    grams, n = _merged(blocks, 8)
    level = np.searchsorted(LEVELS, n, side="right")
    return pa.table({
        "segment": pa.array([blocks.column("segment")[0].as_py()], pa.int32()),
        "grams": [grams.tobytes()],
        "counts": [n.tobytes()],
        "types": [len(grams)],
        "tokens": [int(n.sum())],
        "by_level": pa.array([np.bincount(level - 1, minlength=len(LEVELS)).tolist()], pa.list_(pa.int64())),
    })


def _places(low: np.ndarray, level: int, segment_bits: int) -> Iterator[np.ndarray]:
    """Places of the probes of a level within the segment, by double hashing."""
    first = mixed(low ^ (np.uint64(level + 1) << np.uint64(48)))
    second = (first >> np.uint64(32)) | np.uint64(1)
    first = first & np.uint64(0xFFFFFFFF)
    for i in range(PROBES):
        yield ((first + np.uint64(i) * second) % np.uint64(segment_bits)).astype(np.int64)


def _filled(grams: np.ndarray, n: np.ndarray, segment_bits: int) -> bytes:
    bits = np.zeros(segment_bits, bool)
    low = grams & LOW
    for j, least in enumerate(LEVELS):
        keep = n >= least
        if not keep.any():
            break
        low, n = low[keep], n[keep]
        for place in _places(low, j, segment_bits):
            bits[place] = True
    return np.packbits(bits).tobytes()


def _bits_of_blocks(segment_bits: int):
    def fill(blocks: pa.Table) -> pa.Table:
        bits = _filled(*_merged(blocks, 5), segment_bits)
        return pa.table({"segment": blocks.column("segment").slice(0, 1), "bits": pa.array([bits], pa.binary())})

    return fill


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per chunk."""
    number = TaskContext.get().partitionId() << 40
    for ids, texts in _chunks(batches):
        columns = [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.binary()))]
        yield pa.RecordBatch.from_arrays(columns, ["chunk", "doc_ids", "texts"])
        number += 1


def _known(words: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the words are frequent, and their counts, 0 for the others."""
    if not len(frequent):
        return np.zeros(len(words), bool), np.zeros(len(words), np.int64)
    place = np.minimum(np.searchsorted(frequent, words), len(frequent) - 1)
    exact = frequent[place] == words
    return exact, np.where(exact, counts[place], 0)


def _by_segment(grams: np.ndarray, segments: int) -> np.ndarray:
    """The order in which a chunk asks for its distinct grams."""
    return np.argsort(segment_of(grams, segments), kind="stable")


def _asked(kind: str, segments: int, shared: Broadcast):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, texts in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                tokens, before, _ = _tokens(texts.as_py())
                grams = np.unique(tokens if kind == "word" else pair_hashes(before, tokens))
                if kind == "word":
                    grams = grams[~_known(grams, *shared.value)[0]]
                grams = grams[_by_segment(grams, segments)]
                cuts = np.searchsorted(segment_of(grams, segments).astype(np.int64), np.arange(segments + 1))
                found = [s for s in range(segments) if cuts[s] < cuts[s + 1]]
                packed = np.ascontiguousarray(grams).view(np.uint8).reshape(-1, 8)
                if kind == "pair":
                    packed = packed[:, :5]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([chunk] * len(found), pa.int64()),
                        pa.array(found, pa.int32()),
                        pa.array([packed[cuts[s] : cuts[s + 1]].tobytes() for s in found], pa.binary()),
                    ],
                    ["chunk", "segment", "grams"],
                )

    return ask


def _wide(grams: list[bytes], width: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(grams), np.uint8).reshape(-1, width)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :width] = raw
    return wide.view(np.uint64).ravel()


def _answers(asked: pa.Table, kind: str, width: int, values: np.ndarray) -> pa.Table:
    """The values of all grams asked, as one row for each row asked."""
    cuts = np.cumsum([0, *(len(x) // width for x in asked.column("grams").to_pylist())])
    return pa.table({
        "chunk": asked.column("chunk"),
        "segment": asked.column("segment"),
        "kind": pa.array([kind] * asked.num_rows, pa.string()),
        "answer": pa.array([values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
    })


def _word_answers(asked: pa.Table, counted: pa.Table) -> pa.Table:
    """Exact counts of one segment's words."""
    words = _wide(asked.column("grams").to_pylist(), 8)
    grams = np.frombuffer(counted.column("grams")[0].as_py() if counted.num_rows else b"", np.uint64)
    counts = np.frombuffer(counted.column("counts")[0].as_py() if counted.num_rows else b"", np.int64)
    return _answers(asked, "word", 8, _known(words, grams, counts)[1])


def _pair_answers(pair_bits: int):
    """Levels of one segment's pairs."""

    def answer(asked: pa.Table, bits: pa.Table) -> pa.Table:
        pairs = _wide(asked.column("grams").to_pylist(), 5)
        stretch = bits.column("bits")[0].as_py() if bits.num_rows else b""
        levels = Filter(np.frombuffer(stretch, np.uint8), 1, pair_bits if bits.num_rows else 0).levels(pairs)
        return _answers(asked, "pair", 5, levels.astype(np.uint8))

    return answer


def _returned(answers: pa.Table, kind: str, dtype: type) -> np.ndarray:
    """The answers to a chunk in the order in which it asked."""
    rows = zip(*(answers.column(name).to_pylist() for name in ("kind", "segment", "answer")), strict=True)
    return np.frombuffer(b"".join(answer for own, _, answer in sorted(rows) if own == kind), dtype)


def _scorer(shared: Broadcast, n_tokens: int, n_types: int, n_documents: int, segments: int):
    def scored(packed: pa.Table, answers: pa.Table) -> pa.Table:
        unit = n_tokens + n_types + 1
        tokens, before, sizes = _tokens(packed.column("texts")[0].as_py())
        starts = np.cumsum(sizes) - sizes
        distinct, at = np.unique(tokens, return_inverse=True)
        exact, count = _known(distinct, *shared.value)
        rare = np.flatnonzero(~exact)
        count[rare[_by_segment(distinct[rare], segments)]] = _returned(answers, "word", np.int64)
        # The token before is the one before in the row, or the beginning.
        own = count[at]
        earlier = np.empty_like(own)
        earlier[1:] = own[:-1]
        earlier[starts] = n_documents
        grams, at = np.unique(pair_hashes(before, tokens), return_inverse=True)
        level = np.empty(len(grams), np.int64)
        level[_by_segment(grams, segments)] = _returned(answers, "pair", np.uint8)
        pair = np.minimum(_MIDDLES[level][at], np.minimum(own, earlier))
        weight = PAIR_WEIGHT * earlier / (earlier + RELIABLE_COUNT)
        p = weight * pair / np.maximum(earlier, 1) + (1 - weight) * (own + 1) / unit
        return pa.table({
            "doc_id": packed.column("doc_ids").combine_chunks().flatten(),
            "n_tokens": sizes.astype(np.int64),
            "n_known": np.add.reduceat((own > 0).astype(np.int64), starts),
            "logs": np.add.reduceat(np.log10(own + 1.0), starts),
            "score": np.add.reduceat(np.log10(p), starts),
        })

    return scored
