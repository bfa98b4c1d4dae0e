"""Hard negatives by Strassen products of anchor and candidate tiles.

1. Vectors become 64-bit integers (``floor(scale * x)``) and are packed in tiles: matrices of bounded size with the rows'
   keys, identifiers and labels. Anchors are dealt into tiles of about ``ANCHOR_ROWS``, candidates stay in scan order.
2. Every anchor tile meets every candidate tile in a grid of (anchor tile, candidate group) cells: a stated set of queries
   against all rows, in blocks. A task holds one anchor tile, one candidate tile and their scores at a time.
3. Scores come from Strassen's recursion: matrices are padded with zeros to even halves, seven products of halves replace
   eight, small ones are multiplied directly. All additions are integer ones, so scores are exact.
4. Heaps keep the best few entries of an anchor (positives: same label) or of an anchor and positive (negatives within the
   window of the positive's score). They merge over the tiles of a task, and the heaps of all tasks merge once more by
   a limit per group. Negatives need the positives' scores, hence a second pass.

The work is (rows x anchors x width) by the nature of the task. A candidate is sent once per anchor tile, an anchor once
per candidate group; no label, however frequent, and no identifier is a key of any exchange.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part; a null identifier is
no anchor and comes last among ties; vectors of different lengths are padded with zeros, so an empty one scores 0;
repeated rows and repeated identifiers are rows of their own: a row is never its own positive, its copies may be, and
every anchor row is mined for itself; components beyond 64 bits take the nearest limit, and scores are exact as long as they fit
64 bits themselves; a positive of negative score has an empty window; an empty table gives no rows. Other columns are not
looked at. There is no text here, thus no long one; vectors of any width fit, since wider ones make tiles of fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyfold.llm.common import quoted
from skyfold.session import written_table

ANCHOR_ROWS = 1024
CANDIDATE_ROWS = 2048
TILE_VALUES = 1 << 20
GROUP_TILES = 4
LEAF = 16

TILE_ROWS = "keys array<bigint>, ids array<bigint>, labels array<bigint>, lows array<bigint>, highs array<bigint>, kind string, cells binary"
HEAP_ROWS = "anchor bigint, place int, score bigint, id bigint, key bigint"
LEAST = np.iinfo(np.int64).min


def hard_negatives(
    vectors: DataFrame,
    anchors: str = "vec_id % 100 = 0",
    n_positives: int = 5,
    n_negatives: int = 5,
    percent: int = 80,
    scale: int = 256,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` is a condition on ``vec_id`` and ``label``. A negative's score lies between ``percent`` / 100 of the positive's
    score and that score; per anchor and positive the best ``n_negatives`` are returned, ties by smaller identifier.
    """
    known = vectors.select(
        F.col(quoted(id_col)).cast("bigint").alias("vec_id"),
        F.col(quoted(label_col)).cast("bigint").alias("label"),
        F.col(quoted(vector_col)).cast("array<double>").alias("vector"),
    ).where("label IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND abs(x) < double('infinity'))")
    rows = written_table(
        known.selectExpr(
            "monotonically_increasing_id() AS key", "vec_id", "label", f"transform(vector, x -> floor({float(scale)!r}D * x)) AS vector"
        )
    )
    chosen = rows.where(f"coalesce({anchors}, false) AND vec_id IS NOT NULL")
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    n_tiles = -(-chosen.count() // max(1, min(ANCHOR_ROWS, TILE_VALUES // max(width, 1)))) or 1
    candidates = written_table(
        rows.selectExpr("key", "vec_id", "label", "vector", "CAST(NULL AS array<bigint>) AS lows", "CAST(NULL AS array<bigint>) AS highs")
        .mapInArrow(_packer(width), TILE_ROWS)
        .selectExpr("monotonically_increasing_id() AS number", "*")
    )
    groups = -(-candidates.count() // GROUP_TILES) or 1

    bare = chosen.selectExpr("*", "CAST(NULL AS array<bigint>) AS lows", "CAST(NULL AS array<bigint>) AS highs")
    positives = written_table(
        _best(_scored(_anchor_tiles(bare, width, n_tiles), candidates, n_tiles, groups, width, n_positives), n_positives)
        .selectExpr("anchor", "rank - 1 AS place", "id AS positive_id", "score AS positive_score")
    )
    # The least integer not below percent / 100 of the score, in steps that stay within 64 bits.
    low = f"{percent} * floor_div + ({percent} * remainder + 99) div 100"
    windows = (
        positives.selectExpr("*", "pmod(positive_score, 100L) AS remainder")
        .selectExpr("*", "(positive_score - remainder) div 100 AS floor_div")
        .selectExpr("anchor AS key", "place", f"{low} AS low", "positive_score AS high")
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("place", "low", "high"))).alias("windows"))
        .selectExpr("key", "windows.low AS lows", "windows.high AS highs")
    )
    framed = _anchor_tiles(chosen.join(windows, "key"), width, n_tiles)
    negatives = _best(_scored(framed, candidates, n_tiles, groups, width, n_negatives), n_negatives)
    ids = chosen.selectExpr("key AS anchor", "vec_id AS anchor_id")
    return negatives.join(positives, ["anchor", "place"]).join(ids, "anchor").selectExpr(
        "anchor_id", "positive_id", "rank", "id AS negative_id", "positive_score", "score AS negative_score"
    )


def _anchor_tiles(anchors: DataFrame, width: int, n_tiles: int) -> DataFrame:
    """``tile`` and the packed rows; a tile number may come more than once, if its rows are too wide for one tile."""
    dealt = anchors.selectExpr("pmod(xxhash64(key), {}) AS tile".format(n_tiles), "key", "vec_id", "label", "vector", "lows", "highs")
    pack = _packer(width)

    def packed(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        tile = rows.column("tile")[0].as_py()
        tiles = pa.Table.from_batches(pack(iter(rows.drop_columns(["tile"]).to_batches())))
        return tiles.add_column(0, "tile", pa.array([tile] * tiles.num_rows, pa.int64()))

    return written_table(dealt.groupBy("tile").applyInArrow(packed, f"tile bigint, {TILE_ROWS}"))


def _scored(anchors: DataFrame, candidates: DataFrame, n_tiles: int, groups: int, width: int, most: int) -> DataFrame:
    """Heaps of at most ``most`` entries per anchor (and window) and task."""
    cell = f"pmod(number, {groups}) AS cell"
    sent = candidates.selectExpr(cell, f"explode(sequence(0L, {n_tiles - 1}L)) AS tile", "number", "* EXCEPT (number)")
    asked = anchors.selectExpr(f"explode(sequence(0L, {groups - 1}L)) AS cell", "tile", "CAST(NULL AS BIGINT) AS number", "* EXCEPT (tile)")
    grid = asked.unionByName(sent).repartition("tile", "cell").sortWithinPartitions("tile", "cell", F.asc_nulls_first("number"))
    return grid.mapInArrow(_meeting(width, most), HEAP_ROWS)


def _best(heaps: DataFrame, most: int) -> DataFrame:
    """The heaps of one anchor (and window) merged; ``rank`` from 1."""
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"), "key")
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


# --- inside tasks -------------------------------------------------------------------------------------


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Product of two integer matrices, modulo 2**64; exact if the entries of the result fit 64 bits."""
    rows, inner, columns = a.shape[0], a.shape[1], b.shape[1]
    halvings, least = 0, min(rows, inner, columns)
    while least > leaf:
        halvings, least = halvings + 1, -(-least // 2)
    step = 1 << halvings
    a = np.pad(a, ((0, -rows % step), (0, -inner % step)))
    b = np.pad(b, ((0, -inner % step), (0, -columns % step)))
    return _halved_product(a, b, halvings)[:rows, :columns]


def _halved_product(a: np.ndarray, b: np.ndarray, halvings: int) -> np.ndarray:
    if not halvings:
        return a @ b
    r, k, c = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :k], a[:r, k:], a[r:, :k], a[r:, k:]
    b11, b12, b21, b22 = b[:k, :c], b[:k, c:], b[k:, :c], b[k:, c:]

    def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return _halved_product(left, right, halvings - 1)

    out = np.zeros((2 * r, 2 * c), np.int64)
    out11, out12, out21, out22 = out[:r, :c], out[:r, c:], out[r:, :c], out[r:, c:]
    # Each product is added where it belongs and forgotten, so that one of them is held at a time.
    part = product(a11 + a22, b11 + b22)
    out11 += part
    out22 += part
    part = product(a21 + a22, b11)
    out21 += part
    out22 -= part
    part = product(a11, b12 - b22)
    out12 += part
    out22 += part
    part = product(a22, b21 - b11)
    out11 += part
    out21 += part
    part = product(a11 + a12, b22)
    out11 -= part
    out12 += part
    out22 += product(a21 - a11, b11 + b12)
    out11 += product(a12 - a22, b21 + b22)
    return out


def _packer(width: int):
    """Rows to tiles; the vectors are padded to ``width`` and stored in the narrowest integer type."""
    size = max(1, min(CANDIDATE_ROWS, TILE_VALUES // max(width, 1)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                cells = padded(part.column("vector"), width)
                kind = next(k for k in ("<i2", "<i4", "<i8") if k == "<i8" or _fits(cells, k))
                nothing = pa.array([None], pa.list_(pa.int64()))
                lists = [pa.array([part.column(name).to_pylist()], pa.list_(pa.int64())) for name in ("key", "vec_id", "label")]
                # Windows of an anchor are padded to a common number; an empty one holds nothing.
                lows, highs = part.column("lows").to_pylist(), part.column("highs").to_pylist()
                frames = [nothing, nothing]
                if any(x is not None for x in lows):
                    most = max(len(x) for x in lows)
                    frames = [
                        pa.array([[v for x in lists_of for v in [*x, *[fill] * (most - len(x))]]], pa.list_(pa.int64()))
                        for lists_of, fill in ((lows, 1), (highs, 0))
                    ]
                yield pa.RecordBatch.from_arrays(
                    [*lists, *frames, pa.array([kind]), pa.array([cells.astype(kind).tobytes()], pa.binary())],
                    ["keys", "ids", "labels", "lows", "highs", "kind", "cells"],
                )

    return pack


def _fits(cells: np.ndarray, kind: str) -> bool:
    limits = np.iinfo(kind)
    return not cells.size or (limits.min <= cells.min() and cells.max() <= limits.max)


def padded(vectors: pa.Array, width: int) -> np.ndarray:
    """A matrix of ``width`` columns with zeros after the end of a vector."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    cells = np.zeros((len(vectors), width), np.int64)
    cells[np.arange(width) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return cells


@dataclass
class Tile:
    """Rows in the order of ties: identifiers rising, null last, then keys."""

    keys: np.ndarray
    ids: np.ndarray
    has_id: np.ndarray
    labels: np.ndarray
    cells: np.ndarray
    lows: np.ndarray
    highs: np.ndarray


def _tile(row: dict, width: int) -> Tile:
    keys, labels = (np.array(row[name], np.int64) for name in ("keys", "labels"))
    has_id = np.array([x is not None for x in row["ids"]], bool)
    ids = np.array([0 if x is None else x for x in row["ids"]], np.int64)
    cells = np.frombuffer(row["cells"], row["kind"]).astype(np.int64).reshape(len(keys), width)
    frames = [np.array(row[name] or [], np.int64).reshape(len(keys), -1) for name in ("lows", "highs")]
    order = np.lexsort((keys, ids, ~has_id))
    return Tile(*(x[order] for x in (keys, ids, has_id, labels, cells, *frames)))


class Heaps:
    """The best ``most`` entries of each of ``n`` slots, by score falling, then identifier (null last) and key rising."""

    def __init__(self, n: int, most: int):
        self.n, self.most = n, most
        self.slot, self.score, self.id, self.key = (np.zeros(0, np.int64) for _ in range(4))
        self.has_id = np.zeros(0, bool)

    def least(self) -> np.ndarray:
        """Score of each slot's last entry, the least integer where there is room."""
        lasts = np.full(self.n, LEAST)
        counts = np.bincount(self.slot, minlength=self.n)
        full = counts >= self.most
        lasts[full] = self.score[np.cumsum(counts)[full] - 1]
        return lasts

    def merge(self, slot: np.ndarray, score: np.ndarray, has_id: np.ndarray, ids: np.ndarray, key: np.ndarray) -> None:
        slot, score, has_id, ids, key = (
            np.concatenate(pair)
            for pair in ((self.slot, slot), (self.score, score), (self.has_id, has_id), (self.id, ids), (self.key, key))
        )
        # The complement reverses the order of integers without overflow.
        order = np.lexsort((key, ids, ~has_id, ~score, slot))
        slot = slot[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        starts = np.flatnonzero(first)
        rank = np.arange(len(slot)) - np.repeat(starts, np.diff(np.append(starts, len(slot))))
        order = order[rank < self.most]
        self.slot, self.score, self.has_id, self.id, self.key = slot[rank < self.most], score[order], has_id[order], ids[order], key[order]


def offer(heaps: Heaps, slots: np.ndarray, scores: np.ndarray, allowed: np.ndarray, tile: Tile) -> None:
    """Merge the allowed entries of a score matrix, whose rows belong to ``slots``, into the heaps."""
    held = np.where(allowed, scores, LEAST)
    limit = heaps.least()[slots]
    if held.shape[1] > heaps.most:
        limit = np.maximum(limit, np.partition(held, held.shape[1] - heaps.most, axis=1)[:, -heaps.most])
    row, column = np.nonzero(allowed & (scores >= limit[:, None]))
    heaps.merge(slots[row], scores[row, column], tile.has_id[column], tile.ids[column], tile.keys[column])


def _meeting(width: int, most: int):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: tuple[int, int] | None = None
        asked: list[tuple[Tile, Heaps]] = []

        def emptied() -> Iterator[pa.RecordBatch]:
            for anchors, heaps in asked:
                places = max(1, anchors.lows.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchors.keys[heaps.slot // places]),
                        pa.array((heaps.slot % places).astype(np.int32)),
                        pa.array(heaps.score),
                        pa.array(heaps.id, mask=~heaps.has_id),
                        pa.array(heaps.key),
                    ],
                    ["anchor", "place", "score", "id", "key"],
                )

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if (row["tile"], row["cell"]) != cell:
                    yield from emptied()
                    cell, asked = (row["tile"], row["cell"]), []
                tile = _tile(row, width)
                if row["number"] is None:
                    asked.append((tile, Heaps(len(tile.keys) * max(1, tile.lows.shape[1]), most)))
                    continue
                for anchors, heaps in asked:
                    scores = strassen(anchors.cells, np.ascontiguousarray(tile.cells.T))
                    same = anchors.labels[:, None] == tile.labels[None, :]
                    places = anchors.lows.shape[1]
                    if not places:
                        offer(heaps, np.arange(len(anchors.keys)), scores, same & (anchors.keys[:, None] != tile.keys[None, :]), tile)
                    for place in range(places):
                        inside = (scores >= anchors.lows[:, place, None]) & (scores <= anchors.highs[:, place, None])
                        offer(heaps, np.arange(len(anchors.keys)) * places + place, scores, inside & ~same, tile)
        yield from emptied()

    return meet
