"""N-gram Jaccard join with a prefix tree.

A document is the set of its word n-grams (64-bit hashes). All sets follow one global order: n-grams that many
documents share come last, by frequency; the others come by the count of their rarest word (in powers of the root of
two, from a table of ``1 << WORD_BITS`` cells in which words may share a cell), then by hash. Two sets of similarity ``percent`` or more share an n-gram
in their leading parts of ``n - ceil(s n) + 1`` entries, so only these parts are exchanged.

1. ``sets``: one pass gives every document its set's size and digest; documents with equal sets are one set from here
   on. The pass also counts words by cell and finds the frequent n-grams: those frequent in a batch, summed over batches.
2. ``shared``: leading entries meet by n-gram, packed in binary blocks per segment; those of one set only are dropped.
   Frequent n-grams are known to be shared and pass through the segments unsorted, dealt out evenly. An entry stays
   only if the list has another one of a fitting size.
3. Star candidates: in every n-gram's list, the set with the fewest entries before it against all others.
4. Verification: the candidates of a set are kept in a prefix tree (sorted sequences with the lengths of their common
   beginnings), in groups of bounded size. A traversal carries the overlap of a shared beginning over to the next
   sequence and leaves a subtree as soon as what remains cannot reach the overlap required.
5. Components of the verified links. All other candidates (pairs of different components, by size, place in the list
   and sketch) are then verified too, and the components taken again: no component is missed, while the pairs within
   a group of near copies, already connected, are not written.
6. Number of links: every link lies within a component. The sets of a component are dealt into parts of bounded size, and
   a task counts the links between two parts by products of their incidence matrices. The work is quadratic in a
   component's size; no pair leaves the task.

A sketch holds, for each of up to ``SKETCH_BITS`` cells, whether an odd number of a set's n-grams falls there. Every cell
in which two sketches differ needs an n-gram that only one set has, so the number of such cells bounds the difference
of the sets from below: a pair is dropped only if it cannot be a link.

Defined cases: null texts and texts without words have no n-grams and no links; with fewer words than ``n`` the whole
sequence is the only n-gram; repeated rows and equal texts share one set; a null identifier never names a component
unless no other does; an empty table gives no rows. Two different sets would be taken for one only if both their
64-bit digests and sizes agreed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import identified
from skyfold.llm.components import connected_components
from skyfold.llm.hashing import gram_hashes, mixed, set_of, shingle_set, word_hashes
from skyfold.session import written_table

# An n-gram is frequent if it is in one of this many documents; of frequent ones at most MAX_FREQUENT (16 bytes each)
# are ordered by frequency. Both concern the order, thus speed, and no link.
FREQUENT_SHARE = 2000
MIN_FREQUENT = 4
MAX_FREQUENT = 2_000_000
SEGMENT_ENTRIES = 500_000
GROUP_SETS = 256
# Parts of a component between which links are counted: at most about so many sets and n-grams.
PART_SETS = 2048
PART_GRAMS = 1_000_000
COLUMNS = 2048
STEP = 64
SKETCH_BITS = 1024
WORD_BITS = 23
WORD_SEGMENTS = 64
CHUNK_BYTES = 12_000_000
# Rows of (identifier, set) that may be broadcast, 16 bytes each, to find the texts of candidates.
BROADCAST_ROWS = 1_000_000

SET_ROWS = "doc_id bigint, n bigint, set_id bigint, sketch array<bigint>, grams array<bigint>, counts array<bigint>, cells binary"
BLOCK_ROWS = "segment int, entries binary"
SHARED_ROWS = "gram bigint, set_id bigint, n bigint, place bigint"
ENTRY = np.dtype([("gram", "<i8"), ("set_id", "<i8"), ("n", "<i4"), ("place", "<i4")])


def jaccard_components(
    docs: DataFrame, words: int, percent: int, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True
) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links``.

    ``component_id`` is the smallest identifier reachable over links of similarity ``percent`` / 100 or more;
    ``n_links`` counts the other sets to which the document's set has that similarity. Without ``count_links`` it is left
    out, and with it step 6, whose work is quadratic in a component's size.
    """
    texts = identified(docs, id_col, text_col).selectExpr("doc_id", "CAST(coalesce(text, '') AS BINARY) AS text")
    scanned = written_table(texts.mapInArrow(_scanner(words), SET_ROWS))
    members = scanned.where("n >= 0").select("doc_id", "n", "set_id")
    sketches = scanned.where("n > 0").groupBy("set_id").agg(F.any_value("sketch").alias("sketch"))
    sets = members.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n"))
    shared = _shared_entries(texts, scanned, words, percent)
    links = _links(texts, members, shared, sketches, words, percent)
    placed = written_table(
        sets.join(connected_components(links).withColumnRenamed("node", "set_id"), "set_id", "left")
        .selectExpr("set_id", "first_id", "n", "coalesce(component, set_id) AS component")
    )
    if count_links:
        placed = placed.join(_degrees(texts, members, placed, words, percent), "set_id", "left")
    n_links = ["n_links"] if count_links else []
    names = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = placed.join(names, "component").select("set_id", "component_id", *n_links)
    return members.join(named, "set_id", "left").selectExpr(
        "doc_id", "n AS n_shingles", "CASE WHEN n = 0 THEN doc_id ELSE component_id END AS component_id", *[f"coalesce({name}, 0) AS {name}" for name in n_links]
    )


def _links(
    texts: DataFrame, members: DataFrame, shared: DataFrame, sketches: DataFrame, words: int, percent: int
) -> DataFrame:
    """All verified links between sets of different components, and a spanning choice within: ``a, b``."""
    fits = _fits(percent)
    centres = shared.groupBy("gram").agg(F.expr("min(struct(place, set_id, n)) AS centre"))
    starred = shared.join(centres, "gram").where("set_id <> centre.set_id").selectExpr(
        "set_id", "n", "place", "centre.set_id AS other", "centre.n AS other_n", "centre.place AS other_place"
    )
    stars = starred.where(fits).select("set_id", "n", "other", "other_n").distinct()
    stars = stars.join(sketches, "set_id").join(sketches.selectExpr("set_id AS other", "sketch AS other_sketch"), "other")
    near = _near(percent)
    star_pairs = written_table(stars.where(near).selectExpr("least(set_id, other) AS a", "greatest(set_id, other) AS b").distinct())
    star_links = written_table(_verified(texts, members, star_pairs, words, percent))
    components = connected_components(star_links).selectExpr("node AS set_id", "component")
    entries = shared.join(components, "set_id", "left").withColumn("component", F.expr("coalesce(component, set_id)"))
    # Within a list only sets outside its most frequent component need a partner.
    sizes = entries.groupBy("gram", "component").agg(F.count(F.lit(1)).alias("size"))
    mixed_lists = (
        sizes.groupBy("gram")
        .agg(F.expr("max_by(component, struct(size, component)) AS main"), F.count(F.lit(1)).alias("components"))
        .where("components > 1")
        .select("gram", "main")
    )
    open_entries = written_table(entries.join(mixed_lists, "gram").join(sketches, "set_id"))
    outside = open_entries.where("component <> main").drop("main")
    partners = open_entries.selectExpr(
        "gram", "set_id AS other", "n AS other_n", "place AS other_place", "component AS other_component", "component = main AS in_main",
        "sketch AS other_sketch",
    )
    rest = (
        outside.join(partners, "gram")
        .where(f"component <> other_component AND (in_main OR set_id < other) AND {fits} AND {near}")
        .selectExpr("least(set_id, other) AS a", "greatest(set_id, other) AS b")
        .distinct()
        .join(star_pairs, ["a", "b"], "left_anti")
    )
    rest_links = _verified(texts, members, written_table(rest), words, percent)
    return written_table(star_links.unionByName(rest_links))


def _fits(percent: int) -> str:
    """SQL: sizes and places of a common entry allow the required overlap."""
    overlap = f"ceil({percent} * (n + other_n) / {100 + percent})"
    return (
        f"{percent} * greatest(n, other_n) <= 100 * least(n, other_n) AND "
        f"least(place, other_place) + least(n - place, other_n - other_place) >= {overlap}"
    )


def _near(percent: int) -> str:
    """SQL: the sketches, the longer one folded to the length of the other, allow the required overlap."""
    cells = "least(size(sketch), size(other_sketch))"
    folded = "aggregate(sequence(0, size({0}) div {1} - 1), 0L, (sum, k) -> sum ^ {0}[k * {1} + i])"
    one, other = folded.format("sketch", cells), folded.format("other_sketch", cells)
    differing = f"aggregate(transform(sequence(0, {cells} - 1), i -> bit_count({one} ^ {other})), 0, (sum, n) -> sum + n)"
    return f"{differing} <= n + other_n - 2 * ceil({percent} * (n + other_n) / {100 + percent})"


def _shared_entries(texts: DataFrame, scanned: DataFrame, words: int, percent: int) -> DataFrame:
    """Leading entries whose n-gram more than one set leads with: ``gram, set_id, n, place``; written."""
    spark = texts.sparkSession
    totals = scanned.where("n >= 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    least = max(2 * MIN_FREQUENT, totals[0] // (2 * FREQUENT_SHARE))
    counted = scanned.where("n = -1").selectExpr("inline(arrays_zip(grams, counts))").groupBy("grams").agg(F.sum("counts").alias("df"))
    frequent = counted.where(F.col("df") >= least).orderBy(F.desc("df"), "grams").limit(MAX_FREQUENT).toPandas()
    order = np.argsort(frequent["grams"].to_numpy(np.int64).view(np.uint64))
    grams = frequent["grams"].to_numpy(np.int64).view(np.uint64)[order]
    counts = frequent["df"].to_numpy(np.int64)[order]
    segments = max(64, int((totals[1] or 0) * (100 - percent) / 100 / SEGMENT_ENTRIES))
    by_segment = scanned.where("n = -2").select("set_id", "cells").groupBy("set_id")
    levels = np.zeros(1 << WORD_BITS, np.uint8)
    size = len(levels) // WORD_SEGMENTS
    found = by_segment.applyInArrow(_cell_levels, "segment bigint, levels binary").toPandas()  # one byte per cell
    for segment, part in zip(found["segment"], found["levels"], strict=True):
        levels[segment * size : (segment + 1) * size] = np.frombuffer(part, np.uint8)
    known = spark.sparkContext.broadcast((grams, counts, levels))
    blocks = texts.mapInArrow(_leader(words, percent, segments, known), BLOCK_ROWS)
    met = written_table(blocks.groupBy("segment").applyInArrow(_meeting(segments, percent), f"{SHARED_ROWS}, hot boolean"))
    hot = written_table(met.where("hot").drop("hot").distinct())
    return met.where("NOT hot").drop("hot").unionByName(hot)


def _verified(texts: DataFrame, members: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` that are links."""
    needed = pairs.selectExpr("a AS set_id").union(pairs.selectExpr("b AS set_id")).distinct()
    found = written_table(_texts_of(texts, members, needed, words).dropDuplicates(["set_id"]))
    ends = pairs.selectExpr("a AS probe", "b AS member").union(pairs.selectExpr("b AS probe", "a AS member"))
    degrees = ends.groupBy("probe").agg(F.count(F.lit(1)).alias("degree"))
    sides = pairs.join(degrees.selectExpr("probe AS a", "degree AS of_a"), "a").join(degrees.selectExpr("probe AS b", "degree AS of_b"), "b")
    # The end with more pairs is the probe; its members are dealt into groups of about GROUP_SETS.
    chosen = sides.selectExpr(
        "if(of_a >= of_b, a, b) AS probe", "if(of_a >= of_b, b, a) AS member", "greatest(of_a, of_b) AS degree"
    ).withColumn("part", F.expr(f"int(pmod(xxhash64(member), degree div {GROUP_SETS} + 1))"))
    chosen = written_table(chosen)
    member_rows = chosen.join(found, chosen["member"] == found["set_id"]).select("probe", "part", "member", "text")
    probe_rows = chosen.select("probe", "part").distinct().join(found, F.col("probe") == found["set_id"])
    rows = member_rows.unionByName(probe_rows.selectExpr("probe", "part", "CAST(NULL AS BIGINT) AS member", "text"))
    grouped = rows.repartition("probe", "part").sortWithinPartitions("probe", "part", F.asc_nulls_first("member"))
    return grouped.mapInArrow(_tree_links(words, percent), "a bigint, b bigint")


def _texts_of(texts: DataFrame, members: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """``set_id, text`` of the sets ``needed``, more than once where texts or identifiers repeat.

    Identifiers only narrow the rows down, one for each set; a row's own digest tells its set. So rows without an
    identifier, all of which are looked at if a set has no other, and repeated identifiers find their sets.
    """
    first = written_table(members.join(needed, "set_id").groupBy("set_id").agg(F.min("doc_id").alias("doc_id")))
    few = first.count() <= BROADCAST_ROWS
    ids, set_ids = first.where("doc_id IS NOT NULL").select("doc_id").distinct(), first.select("set_id")
    rows = texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    if not first.where("doc_id IS NULL").isEmpty():
        rows = rows.unionByName(texts.where("doc_id IS NULL"))
    own = rows.select("text").mapInArrow(_own_sets(words), "set_id bigint, text binary")
    return own.join(F.broadcast(set_ids) if few else set_ids, "set_id", "left_semi")


def _degrees(texts: DataFrame, members: DataFrame, placed: DataFrame, words: int, percent: int) -> DataFrame:
    """``set_id, n_links`` of the sets in components of two or more."""
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("grams")).where("size > 1")
    sizes = sizes.selectExpr("component", "size", f"greatest(size div {PART_SETS}, grams div {PART_GRAMS}) + 1 AS parts")
    joined = placed.join(sizes, "component")
    dealt = written_table(joined.where("size > 2").selectExpr("set_id", "component", "parts", "pmod(xxhash64(set_id), parts) AS part"))
    found = _texts_of(texts, members, dealt.select("set_id"), words).dropDuplicates(["set_id"])
    rows = dealt.join(found, "set_id").selectExpr(
        "set_id", "text", "component", "part", "explode(sequence(0L, parts - 1)) AS other"
    )
    rows = rows.selectExpr("component", "least(part, other) AS one", "greatest(part, other) AS two", "part", "set_id", "text")
    grouped = rows.repartition("component", "one", "two").sortWithinPartitions("component", "one", "two")
    counted = grouped.mapInArrow(_link_counts(words, percent), "set_id bigint, n_links bigint")
    pairs = joined.where("size = 2").selectExpr("set_id", "1L AS n_links")
    return counted.unionByName(pairs).groupBy("set_id").agg(F.sum("n_links").alias("n_links"))


# --- inside tasks -------------------------------------------------------------------------------------


def set_digest(grams: np.ndarray) -> int:
    """A set's identifier: an order-free sum of its n-grams, mixed with its size."""
    total = np.array([np.add.reduce(mixed(grams ^ np.uint64(0x5851F42D4C957F2D))) ^ np.uint64(len(grams))], np.uint64)
    return int(mixed(total).view(np.int64)[0])


def levelled_set(text: bytes, n: int, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_set`` and, for each n-gram, the level of its rarest word."""
    words = word_hashes(text)
    if not len(words):
        return words, np.zeros(0, np.uint8)
    n = min(n, len(words))
    grams = gram_hashes(words, n)
    of_words = levels[(words >> np.uint64(64 - WORD_BITS)).astype(np.int64)]
    of_grams = of_words[: len(grams)]
    for i in range(1, n):
        of_grams = np.minimum(of_grams, of_words[i : i + len(grams)])
    order = np.argsort(grams)
    grams, of_grams = grams[order], of_grams[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = grams[1:] != grams[:-1]
    return grams[keep], of_grams[keep]


def leading(grams: np.ndarray, levels: np.ndarray, percent: int, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The leading entries of a set in global order, and how many of them are not frequent. Empty for sets that
    are too small to be similar to another."""
    n = len(grams)
    if n * (100 - percent) < percent:
        return grams[:0], 0
    size = n - -(-percent * n // 100) + 1
    is_frequent = np.zeros(n, bool)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
        is_frequent = frequent[at] == grams
    plain, plain_levels = grams[~is_frequent], levels[~is_frequent]
    plain = plain[np.argsort(plain_levels, kind="stable")]
    if len(plain) >= size:
        return plain[:size], size
    common, common_at = grams[is_frequent], at[is_frequent]
    common = common[np.lexsort((common, counts[common_at]))]
    return np.concatenate((plain, common[: size - len(plain)])), len(plain)


def tree_links(probe: np.ndarray, members: list[np.ndarray], percent: int) -> list[int]:
    """Indices of the members similar to the probe.

    The members, sorted as sequences, are the leaves of a prefix tree in the order of its traversal: the common
    beginning with the sequence before is the path shared with it, whose overlap is known.
    """
    size = len(probe)
    least = -(-percent * size // 100)
    found: list[int] = []
    before = probe[:0]
    overlap = np.zeros(1, np.int64)  # after each entry of the current path
    dead = None  # depth of a subtree that cannot hold a link
    for i in sorted(range(len(members)), key=lambda i: members[i].astype(">u8").tobytes()):
        path = members[i]
        common = min(len(before), len(path), len(overlap) - 1 if dead is None else dead)
        differs = np.flatnonzero(before[:common] != path[:common])
        shared = int(differs[0]) if len(differs) else common
        if dead is not None and shared >= dead:
            continue
        dead = None
        n = len(path)
        required = -(-percent * (size + n) // (100 + percent))
        overlap = overlap[: shared + 1]
        before = path
        depth, alive = shared, True
        while depth < n:
            step = path[depth : depth + STEP]
            at = np.searchsorted(probe, step)
            hits = np.cumsum(probe[np.minimum(at, size - 1)] == step)
            overlap = np.concatenate((overlap, overlap[-1] + hits))
            depth += len(step)
            left = size - int(at[-1])
            if overlap[-1] + left < least:
                dead, alive = depth, False
                break
            if overlap[-1] + min(left, n - depth) < required:
                alive = False
                break
        if alive and 100 * int(overlap[-1]) >= percent * (size + n - int(overlap[-1])):
            found.append(i)
    return found


def sketch(grams: np.ndarray) -> np.ndarray:
    """Parity of the number of n-grams per cell, 64 cells to an integer; the cells follow the size of the set."""
    bits = min(max(64, 1 << (len(grams) - 1).bit_length()), SKETCH_BITS)
    # Cell i + 64 k is bit i of integer k; halves of the integers fold onto each other.
    odd = np.bincount((grams >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _chunks(texts: pa.Array) -> Iterator[list[tuple[int, bytes]]]:
    """Row numbers and lower-cased texts in lists of bounded size."""
    chunk, size = [], 0
    for i, text in enumerate(texts):
        lowered = text.as_py().lower()
        chunk.append((i, lowered))
        size += len(lowered)
        if size > CHUNK_BYTES:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def _scanner(words: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in _chunks(batch.column(1)):
                sizes, set_ids, sketches, seen, parts, cells = [], [], [], set(), [], []
                for _, text in chunk:
                    hashes = word_hashes(text)
                    grams = set_of(hashes, words)
                    set_id = set_digest(grams) if len(grams) else 0
                    sizes.append(len(grams))
                    set_ids.append(set_id)
                    sketches.append(sketch(grams) if len(grams) else [])
                    if len(grams) and set_id not in seen:
                        seen.add(set_id)
                        parts.append(grams)
                        cells.append((hashes >> np.uint64(64 - WORD_BITS)).astype(np.uint32))
                grams, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
                often = counts >= max(MIN_FREQUENT, len(chunk) // FREQUENT_SHARE)
                blocks = _cell_blocks(np.concatenate([np.zeros(0, np.uint32), *cells]))
                ids = batch.column(0).slice(chunk[0][0], len(chunk)).to_pylist()
                more = 1 + len(blocks)
                empty: list[list[int]] = [[]] * len(chunk)
                gap: list[list[int]] = [[]] * len(blocks)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*ids, *[None] * more], pa.int64()),
                        pa.array([*sizes, -1, *[-2] * len(blocks)], pa.int64()),
                        pa.array([*set_ids, 0, *[segment for segment, _ in blocks]], pa.int64()),
                        pa.array([*sketches, [], *gap], pa.list_(pa.int64())),
                        pa.array([*empty, grams[often].view(np.int64), *gap], pa.list_(pa.int64())),
                        pa.array([*empty, counts[often].astype(np.int64), *gap], pa.list_(pa.int64())),
                        pa.array([*[None] * (len(chunk) + 1), *[block for _, block in blocks]], pa.binary()),
                    ],
                    ["doc_id", "n", "set_id", "sketch", "grams", "counts", "cells"],
                )

    return scan


def _cell_blocks(cells: np.ndarray) -> list[tuple[int, bytes]]:
    """Cells with their counts, one block per segment."""
    cells, counts = np.unique(cells, return_counts=True)
    pairs = np.stack((cells, counts.astype(np.uint32)), axis=1)
    cuts = np.searchsorted(cells, np.arange(WORD_SEGMENTS + 1) * ((1 << WORD_BITS) // WORD_SEGMENTS))
    return [(s, pairs[cuts[s] : cuts[s + 1]].tobytes()) for s in range(WORD_SEGMENTS) if cuts[s] < cuts[s + 1]]


def _cell_levels(blocks: pa.Table) -> pa.Table:
    """Summed counts of a segment's cells as levels, in half powers of two."""
    segment, size = blocks.column("set_id")[0].as_py(), (1 << WORD_BITS) // WORD_SEGMENTS
    totals = np.zeros(size)
    for block in blocks.column("cells").to_pylist():
        pairs = np.frombuffer(block, np.uint32).reshape(-1, 2)
        totals[pairs[:, 0] - np.uint32(segment * size)] += pairs[:, 1]
    levels = np.ceil(2 * np.log2(totals + 1)).astype(np.uint8)
    return pa.table({"segment": [segment], "levels": pa.array([levels.tobytes()], pa.binary())})


def _leader(words: int, percent: int, segments: int, known: Broadcast):
    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts, table = known.value
        for batch in batches:
            seen: set[int] = set()
            for chunk in _chunks(batch.column(1)):
                plain, hot = [np.zeros(0, ENTRY)], [np.zeros(0, ENTRY)]
                for _, text in chunk:
                    grams, levels = levelled_set(text, words, table)
                    first, unmet = leading(grams, levels, percent, frequent, counts)
                    if not len(first) or (set_id := set_digest(grams)) in seen:
                        continue
                    seen.add(set_id)
                    entries = np.empty(len(first), ENTRY)
                    entries["gram"], entries["set_id"], entries["n"] = first.view(np.int64), set_id, len(grams)
                    entries["place"] = np.arange(len(first))
                    plain.append(entries[:unmet])
                    hot.append(entries[unmet:])
                yield from _dealt(np.concatenate(plain), "gram", segments, 0)
                yield from _dealt(np.concatenate(hot), "set_id", segments, segments)

    return lead


def _dealt(entries: np.ndarray, by: str, segments: int, first: int) -> Iterator[pa.RecordBatch]:
    """One block of entries per segment, numbered from ``first``."""
    where = ((entries[by].view(np.uint64) >> np.uint64(33)) % np.uint64(segments)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    entries, where = entries[order], where[order]
    cuts = np.searchsorted(where, np.arange(segments + 1))
    found = [s for s in range(segments) if cuts[s] < cuts[s + 1]]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([first + s for s in found], pa.int32()),
            pa.array([entries[cuts[s] : cuts[s + 1]].tobytes() for s in found], pa.binary()),
        ],
        ["segment", "entries"],
    )


def _meeting(segments: int, percent: int):
    """Entries of one segment whose n-gram belongs to more than one set; hot segments pass through."""

    def meet(blocks: pa.Table) -> pa.Table:
        entries = np.frombuffer(b"".join(blocks.column("entries").to_pylist()), ENTRY)
        hot = blocks.column("segment")[0].as_py() >= segments
        if not hot:
            entries = entries[np.lexsort((entries["set_id"], entries["n"], entries["gram"]))]
            gram, set_id = entries["gram"], entries["set_id"]
            new = np.ones(len(entries), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (set_id[1:] != set_id[:-1])
            entries = entries[new]
            # In order of size, an entry fits any other of its list only if it fits a neighbour.
            gram, n = entries["gram"], entries["n"].astype(np.int64)
            pairs = (gram[1:] == gram[:-1]) & (percent * n[1:] <= 100 * n[:-1])
            entries = entries[np.append(pairs, False) | np.append(False, pairs)]
        return pa.table({
            "gram": entries["gram"],
            "set_id": entries["set_id"],
            "n": entries["n"].astype(np.int64),
            "place": entries["place"].astype(np.int64),
            "hot": np.full(len(entries), hot),
        })

    return meet


def _own_sets(words: int):
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            for chunk in _chunks(batch.column(0)):
                ids, rows = [], []
                for i, text in chunk:
                    set_id = set_digest(grams) if len(grams := shingle_set(text, words)) else 0
                    if set_id not in seen:
                        seen.add(set_id)
                        ids.append(set_id)
                        rows.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column(0).take(pa.array(rows, pa.int64()))], ["set_id", "text"])

    return own


def link_counts(one: list[np.ndarray], two: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set of both lists the number of similar sets in the other; without ``two``, of the others in ``one``."""
    sets = one + (two or [])
    sizes = np.array([len(x) for x in sets], np.float64)
    grams = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    column = np.cumsum(new) - 1
    often = np.bincount(column, minlength=1) > 1 if len(column) else np.zeros(0, bool)
    keep = often[column]
    owner, column = owner[keep], (np.cumsum(often) - 1)[column[keep]]
    rows = slice(0, len(one))
    others = rows if two is None else slice(len(one), len(sets))
    overlap = np.zeros((rows.stop, others.stop - others.start))
    cuts = np.searchsorted(column, np.arange(0, int(often.sum()) + COLUMNS, COLUMNS))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        held = np.zeros((len(sets), int(column[b - 1]) - k * COLUMNS + 1 if b > a else 0), np.float32)
        held[owner[a:b], column[a:b] - k * COLUMNS] = 1
        overlap += held[rows] @ held[others].T
    similar = 100 * overlap >= percent * (sizes[rows][:, None] + sizes[others][None, :] - overlap)
    if two is None:
        np.fill_diagonal(similar, False)
        return similar.sum(axis=1), np.zeros(0, np.int64)
    return similar.sum(axis=1), similar.sum(axis=0)


def _link_counts(words: int, percent: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple[int, int, int] | None = None
        ids: tuple[list[int], list[int]] = ([], [])
        sets: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])

        def counted() -> pa.RecordBatch:
            n = link_counts(sets[0], sets[1] if group[1] != group[2] else None, percent)
            columns = [pa.array(ids[0] + ids[1], pa.int64()), pa.array(np.concatenate(n).astype(np.int64))]
            return pa.RecordBatch.from_arrays(columns, ["set_id", "n_links"])

        for batch in batches:
            for component, one, two, part, set_id, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if (component, one, two) != group:
                    if group:
                        yield counted()
                    group, ids, sets = (component, one, two), ([], []), ([], [])
                ids[part != one].append(set_id)
                sets[part != one].append(shingle_set(text.lower(), words))
        if group:
            yield counted()

    return count


def _tree_links(words: int, percent: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple[int, int] | None = None
        probe: np.ndarray | None = None
        ids: list[int] = []
        sets: list[np.ndarray] = []

        def linked() -> pa.RecordBatch:
            if ids and probe is None:
                raise RuntimeError(f"no text of set {group}")
            hits = [ids[i] for i in tree_links(probe, sets, percent)] if ids else []
            own = group[0] if group else 0
            return pa.RecordBatch.from_arrays(
                [pa.array([min(own, x) for x in hits], pa.int64()), pa.array([max(own, x) for x in hits], pa.int64())], ["a", "b"]
            )

        for batch in batches:
            for own, part, member, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if (own, part) != group:
                    if ids:
                        yield linked()
                    group, probe, ids, sets = (own, part), None, [], []
                grams = shingle_set(text.lower(), words)
                if member is None:
                    probe = grams
                else:
                    ids.append(member)
                    sets.append(grams)
        if ids:
            yield linked()

    return link
