"""Mixing sources to target weights by subset-sum budget fitting.

1. A document's size is its number of words. Sizes are counted per source and exact size: a histogram whose rows are
   distinct sizes, however many documents a source has.
2. Targets: the sources' weights share ``share`` times all words; a target stops at ``most`` times its source's words
   and the excess is shared again by weight (water filling, by windows over one row per source).
3. Per source, a task fits the budget on the histogram alone: whole passes first, then, but for the last
   ``PROGRAMME_WORDS`` words, of every size the same share of its documents, rounded down, then a bounded-knapsack dynamic
   programme over the remaining words, which hits the budget to the word wherever the sizes allow it.
4. Documents are selected by a seeded order within source and size, which follows identifier and text. A group is cut by its
   counts per hash bucket, the bucket at the cut by its counts per document and place of reading, and only the rows at that
   cut are ranked, so a source, a size, an identifier or a repeated row holding most of all rows meets in no single task.

Defined cases: a null text and a text without words have size 0, count no words and go only with the whole passes of
their source; a null source is a source of its
own, ordered last; rows equal in identifier and text are interchangeable; an empty table gives no rows. Words are counted in
whole texts, however long; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfold.llm.common import WORD_CLASS, identified
from skyfold.session import written_table

SEED = 42
BUCKETS = 256
# Words left to the dynamic programme; the rest of a budget is filled by whole documents before.
PROGRAMME_WORDS = 32_768


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, times``; ``times`` is how often the mix
    repeats the document. Sources in code-point order, null last, take the ``weights`` in turn.
    """
    columns = identified(docs, id_col, text_col, source_col)
    source = F.col(columns.columns[2])
    sizes = written_table(
        columns.select(
            "doc_id",
            source.alias("source"),
            F.coalesce(F.concat(F.lit("="), source), F.lit("null")).alias("key"),
            F.coalesce(F.regexp_count("text", F.lit(f"{WORD_CLASS}+")), F.lit(0)).cast("bigint").alias("size"),
            F.xxhash64(F.lit(seed), "doc_id", "text").alias("lot"),
            F.spark_partition_id().alias("part"),
        ).withColumn("bucket", F.expr(f"int(pmod(lot, {BUCKETS}))"))
    )
    by_bucket = sizes.groupBy("key", "size", "bucket").agg(F.max("source").alias("source"), F.count(F.lit(1)).alias("n"))
    histogram = by_bucket.groupBy("key", "size").agg(F.max("source").alias("source"), F.sum("n").alias("n"))
    plan = written_table(_fitted(histogram, weights, share, most))
    cuts = by_bucket.drop("source").join(plan, ["key", "size"]).withColumn("more", _share_of("extra", ["key", "size"], ["bucket"]))
    placed = sizes.join(cuts.drop("extra"), ["key", "size", "bucket"])
    result = ("doc_id", "source", "size", "source_size", "target")
    whole = placed.where("more = 0 OR more = n").selectExpr(*result, "passes + int(more > 0) AS times")
    return whole.unionByName(_torn(placed.where("more > 0 AND more < n")).selectExpr(*result, "passes + int(rank <= cell_more) AS times"))


def _torn(rows: DataFrame) -> DataFrame:
    """Rows of the buckets at a cut, with ``cell_more`` of those equal in lot and part to be taken, by ``rank``."""
    cell = ["key", "size", "lot", "part"]
    counted = rows.groupBy(*cell).agg(F.max("more").alias("bucket_more"), F.count(F.lit(1)).alias("n"))
    cells = counted.withColumn("cell_more", _share_of("bucket_more", ["key", "size"], ["lot", "part"]))
    ranked = Window.partitionBy(*cell).orderBy("doc_id")
    return rows.join(cells.select(*cell, "cell_more"), cell).withColumn("rank", F.row_number().over(ranked))


def targets(histogram: DataFrame, weights: Sequence[float], share: float, most: int) -> DataFrame:
    """``key, source_size, target`` per source. The windows run over one row per source."""
    sources = histogram.groupBy("key").agg(F.max("source").alias("source"), F.sum(F.expr("size * n")).alias("source_size"))
    cycle = f"element_at(array({', '.join(f'{float(w)!r}D' for w in weights)}), int((place - 1) % {len(weights)}) + 1)"
    weighed = sources.withColumn("place", F.expr("row_number() OVER (ORDER BY source ASC NULLS LAST)")).withColumn(
        "weight", F.expr(cycle)
    )
    # Sources reach their limit in the order of limit per weight. The level is the words per weight that remain for
    # the sources not at their limit, at the first source that does not reach it.
    ratio = f"{most} * source_size / weight"
    before = f"(ORDER BY {ratio}, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    levels = weighed.selectExpr(
        "*",
        f"""({float(share)!r}D * sum(source_size) OVER () - {most} * coalesce(sum(source_size) OVER {before}, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER {before}, 0)) AS level""",
    )
    reached = f"min_by(level, CASE WHEN level <= {ratio} THEN struct({ratio} AS ratio, place) END) OVER ()"
    return levels.selectExpr(
        "key", "source_size", f"least(double({most} * source_size), coalesce({reached}, {most} * source_size / weight) * weight) AS target"
    )


def _fitted(histogram: DataFrame, weights: Sequence[float], share: float, most: int) -> DataFrame:
    goals = histogram.join(targets(histogram, weights, share, most), "key").drop("source")
    schema = "key string, size bigint, source_size bigint, target double, passes int, extra bigint"
    return goals.groupBy("key").applyInPandas(_fit_source, schema)


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size", ignore_index=True)
    total, target = int(rows["source_size"][0]), float(rows["target"][0])
    passes = int((target + 0.5) // total) if total else 0
    extra = fit_budget(rows["size"].tolist(), rows["n"].tolist(), round(target) - passes * total)
    return rows[["key", "size", "source_size", "target"]].assign(passes=passes, extra=extra)


def fit_budget(sizes: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many documents of each size to take, at most ``counts``, for a total near ``budget``."""
    total = sum(size * count for size, count in zip(sizes, counts, strict=True))
    if budget <= 0 or not total:
        return [0] * len(sizes)
    if budget >= total:
        return list(counts)
    # The programme gets its words first, so that small sources are fitted by it alone.
    by_share = max(0, budget - PROGRAMME_WORDS)
    taken = [count * by_share // total if size else 0 for size, count in zip(sizes, counts, strict=True)]
    left = budget - sum(size * n for size, n in zip(sizes, taken, strict=True))
    largest_first = sorted((i for i, size in enumerate(sizes) if size), key=lambda i: -sizes[i])
    for most in (1, None):  # one more of each size, then as many as there are
        for i in largest_first:
            more = min(counts[i] - taken[i], max(0, left - PROGRAMME_WORDS) // sizes[i], most or counts[i])
            taken[i] += more
            left -= more * sizes[i]
    mixed_order = sorted(largest_first, key=lambda i: (sizes[i] * 2654435761 % 2**32, i))  # neither short nor long first
    for i, more in _programme([(i, sizes[i], counts[i] - taken[i]) for i in mixed_order], left):
        taken[i] += more
    return taken


def _programme(items: list[tuple[int, int, int]], budget: int) -> list[tuple[int, int]]:
    """Bounded knapsack: the reachable sum nearest to ``budget`` from ``(index, size, count)`` items."""
    most = budget + min(budget, PROGRAMME_WORDS)
    reached = np.zeros(most + 1, bool)
    reached[0] = True
    by = np.full(most + 1, -1, np.int32)
    parts: list[tuple[int, int, int]] = []
    for index, size, count in items:
        copies = 1
        while count > 0 and size * min(copies, count) <= most and not reached[budget]:
            part = min(copies, count)
            step = size * part
            new = np.flatnonzero(reached[: most + 1 - step] & ~reached[step:]) + step
            by[new] = len(parts)
            reached[new] = True
            parts.append((index, part, step))
            count -= part
            copies *= 2
    sums = np.flatnonzero(reached)
    at = int(sums[np.abs(sums - budget).argmin()])
    used = []
    while at:
        index, part, step = parts[by[at]]
        used.append((index, part))
        at -= step
    return used


def _share_of(total: str, by: list[str], order: list[str]) -> Column:
    """How many of a row's ``n`` fall to it when the first ``total`` of its group are given out in order."""
    earlier = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    return F.least(F.col("n"), F.greatest(F.col(total) - before, F.lit(0)))
