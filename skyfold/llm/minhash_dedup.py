"""Near-duplicate components by one-permutation MinHash with optimal densification.

A document is the set of its word shingles (64-bit hashes); equal sets are one set from the first pass on, identified by
two independent 64-bit sums.

1. Signature: one permutation, the order of the hashes, split into ``bands * rows`` bins; a bin holds its smallest hash. Empty
   bins are densified optimally: each follows a fixed pseudo-random sequence of bins and copies the first that was not
   empty, so that two sets fill an empty bin from the same source if they can.
2. Bands of ``rows`` bins are hashed to buckets. A bucket is kept only if two different sets are in it.
3. Star: every set is paired with one centre, the smallest of the centres of its buckets; a centre is the smallest set
   of a bucket. So there are at most as many pairs as sets, however large a bucket is. Pairs are confirmed on full sets
   and connected.
4. The rest: buckets whose sets are still in different components. Their sets are dealt into parts of bounded size, two parts
   meet in a task, and pairs of different components are compared by size and signature. What leaves a task is a forest
   over the pairs that may be links, so at most a row per set, and its trees form clusters. In the same manner the
   full sets of a cluster meet, part by part, and their overlaps are products of incidence matrices. Parts of the cluster's
   largest component do not meet each other. No bucket is capped: this step is quadratic within a bucket or cluster, inside
   tasks, no pair is written, and a group of near copies that the stars have connected does not take part.

A pair of similarity ``percent`` / 100 shares a bucket with probability ``1 - (1 - s**rows)**bands`` (0.9993 at 0.8, 0.99998 at
0.85). A pair whose signatures agree five standard deviations below the bound is not looked at further. What is confirmed
is exact, so no false link arises.

Defined cases: null texts and texts without words have an empty set and no links; with fewer words than ``words`` the whole
sequence is the only shingle; repeated rows and equal sets share one component; a null identifier never names a
component unless no other does, and such a row is kept only then; rows that share an identifier are kept together if it
names the component; texts of any length are hashed in blocks, and sent one by one; an empty table gives no rows. Other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import identified
from skyfold.llm.components import connected_components
from skyfold.llm.hashing import mixed, shingle_set
from skyfold.session import written_table

BANDS = 24
ROWS = 6
CHUNK_BYTES = 12_000_000
# Members that a task compares with one centre, and sets of a part of a bucket.
GROUP_SETS = 256
PART_SETS = 512
PART_SHINGLES = 1_000_000
# Rows of (identifier, set) that may be broadcast, 24 bytes each, to find the texts of pairs.
BROADCAST_ROWS = 1_000_000
STRIP = 4096
COLUMNS = 4096
CELL = ["gathered", "one", "two"]

SET_ROWS = "doc_id bigint, n bigint, key binary, signature binary, buckets array<bigint>"


def near_duplicates(
    docs: DataFrame,
    words: int,
    percent: int,
    bands: int = BANDS,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``; the smallest identifier of a component is kept."""
    texts = identified(docs, id_col, text_col).selectExpr("doc_id", "CAST(coalesce(text, '') AS BINARY) AS text")
    members = written_table(texts.mapInArrow(_scanner(words, percent, bands, rows), SET_ROWS))
    sets = written_table(
        members.where("key IS NOT NULL")
        .groupBy("key")
        .agg(
            F.min("doc_id").alias("first_id"),
            F.max("n").alias("n"),
            F.expr("any_value(signature, true)").alias("signature"),
            F.expr("any_value(buckets, true)").alias("buckets"),
        )
    )
    links = candidate_links(texts, sets, words, percent, bands * rows)
    placed = sets.select("key", "first_id").join(connected_components(links).withColumnRenamed("node", "key"), "key", "left")
    placed = placed.selectExpr("key", "first_id", "coalesce(component, key) AS component")
    names = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = placed.join(names, "component").select("key", "component_id")
    found = members.select("doc_id", "n", "key").join(named, "key", "left")
    return found.selectExpr("doc_id", "n AS n_shingles", "CASE WHEN n = 0 THEN doc_id ELSE component_id END AS component_id").selectExpr(
        "*", "doc_id <=> component_id AS kept"
    )


def candidate_links(texts: DataFrame, sets: DataFrame, words: int, percent: int, bins: int) -> DataFrame:
    """Confirmed links ``a, b`` between sets: stars first, then between components that share a bucket."""
    entries = sets.where("buckets IS NOT NULL").selectExpr("key", "n", "explode(buckets) AS bucket")
    live = entries.groupBy("bucket").agg(F.min(F.struct("key", "n")).alias("centre"), F.max("key").alias("last")).where("centre.key < last")
    met = written_table(entries.join(live.drop("last"), "bucket"))
    fitting = met.where(f"key <> centre.key AND {percent} * greatest(n, centre.n) <= 100 * least(n, centre.n)")
    stars = written_table(fitting.groupBy("key").agg(F.min("centre.key").alias("centre")).selectExpr("centre AS a", "key AS b"))
    star_links = written_table(_confirmed(texts, sets, stars, words, percent))

    components = connected_components(star_links).selectExpr("node AS key", "component")
    placed = met.drop("centre").join(components, "key", "left").withColumn("component", F.expr("coalesce(component, key)"))
    cells = _cells(written_table(placed), "bucket", None).join(sets.select("key", "signature"), "key")
    cells = cells.select(*CELL, "part", "key", "n", "component", "signature")
    cells = cells.repartition(*CELL).sortWithinPartitions(*CELL)
    likely = written_table(cells.mapInArrow(_likely(percent, bins), "a binary, b binary").distinct())

    clusters = connected_components(likely).selectExpr("node AS key", "component AS cluster")
    gathered = clusters.join(components, "key", "left").join(sets.select("key", "n"), "key")
    gathered = written_table(gathered.withColumn("component", F.expr("coalesce(component, key)")))
    found = written_table(_texts_of(texts, sets, gathered.select("key"), words).dropDuplicates(["key"]))
    cells = _cells(gathered, "cluster", PART_SHINGLES).join(found, "key").select(*CELL, "part", "key", "component", "text")
    cells = cells.repartition(*CELL).sortWithinPartitions(*CELL)
    return written_table(star_links.unionByName(cells.mapInArrow(_linked(words, percent), "a binary, b binary")))


def _cells(rows: DataFrame, group: str, shingles: int | None) -> DataFrame:
    """The rows ``key, n, component`` of every group, dealt into parts, once for each part that theirs meets.

    Groups of one component go. The rows of the largest component meet those of the others only; ``part`` tells the
    sides ``one`` and ``two`` of a cell apart.
    """
    of_components = rows.groupBy(group, "component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
    largest = "max_by({}, struct(size, component))"
    totals = of_components.groupBy(group).agg(
        F.expr(largest.format("component")).alias("main"),
        F.expr(largest.format("struct(size, shingles)")).alias("of_main"),
        F.expr("struct(sum(size) AS size, sum(shingles) AS shingles)").alias("of_all"),
    )

    def parts(size: str, amount: str) -> str:
        by_amount = f", ({amount}) div {shingles}" if shingles else ", 0L"
        return f"greatest(({size}) div {PART_SETS}{by_amount}) + 1"

    totals = totals.where("of_main.size < of_all.size").selectExpr(
        group,
        "main",
        f"{parts('of_main.size', 'of_main.shingles')} AS main_parts",
        f"{parts('of_all.size - of_main.size', 'of_all.shingles - of_main.shingles')} AS rest_parts",
    )
    dealt = rows.join(totals, group).selectExpr(
        f"{group} AS gathered",
        "key",
        "n",
        "component",
        "if(component = main, pmod(xxhash64(key), main_parts), main_parts + pmod(xxhash64(key), rest_parts)) AS part",
        "explode(sequence(if(component = main, main_parts, 0L), main_parts + rest_parts - 1)) AS facing",
    )
    return dealt.selectExpr("gathered", "least(part, facing) AS one", "greatest(part, facing) AS two", "part", "key", "n", "component")


def _confirmed(texts: DataFrame, sets: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar; ``a`` is the centre of its pairs."""
    needed = pairs.selectExpr("a AS key").union(pairs.selectExpr("b AS key")).distinct()
    found = written_table(_texts_of(texts, sets, needed, words).dropDuplicates(["key"]))
    degrees = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
    dealt = pairs.join(degrees, "a").selectExpr("a", "b", f"pmod(xxhash64(b), degree div {GROUP_SETS} + 1) AS part")
    centres = dealt.select("a", "part").distinct().join(found.withColumnRenamed("key", "a"), "a")
    arms = dealt.join(found.withColumnRenamed("key", "b"), "b").select("a", "part", "b", "text")
    rows = centres.selectExpr("a", "part", "CAST(NULL AS BINARY) AS b", "text").unionByName(arms)
    grouped = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    return grouped.mapInArrow(_similar(words, percent), "a binary, b binary")


def _texts_of(texts: DataFrame, sets: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """``key, text`` of the sets ``needed``, perhaps more than once.

    Identifiers narrow the rows down; the set a row belongs to is told by its own text, so repeated identifiers do no
    harm. Rows without an identifier are looked at if a set has no other.
    """
    first = written_table(sets.select("key", "first_id").join(needed, "key"))
    few = first.count() <= BROADCAST_ROWS
    ids, keys = first.where("first_id IS NOT NULL").selectExpr("first_id AS doc_id").distinct(), first.select("key")
    rows = texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    if not first.where("first_id IS NULL").isEmpty():
        rows = rows.unionByName(texts.where("doc_id IS NULL"))
    own = rows.select("text").mapInArrow(_keyed(words), "key binary, text binary")
    return own.join(F.broadcast(keys) if few else keys, "key", "left_semi")


# --- inside tasks -------------------------------------------------------------------------------------


def set_key(shingles: np.ndarray) -> bytes:
    """Two independent order-free sums of a set, mixed with its size."""
    size = np.uint64(len(shingles))
    sums = [np.add.reduce(mixed(shingles ^ np.uint64(salt))) ^ size for salt in (0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1)]
    return mixed(np.array(sums, np.uint64)).tobytes()


class Hops:
    """The sequence of bins every empty bin follows, as a table that grows with use."""

    def __init__(self, bins: int):
        self.bins = bins
        self.table = np.zeros((0, bins), np.int64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            numbers = np.arange(len(self.table) * self.bins, n * self.bins, dtype=np.uint64)
            more = (mixed(numbers ^ np.uint64(0x510E527FADE682D1)) % np.uint64(self.bins)).astype(np.int64)
            self.table = np.concatenate((self.table, more.reshape(-1, self.bins)))
        return self.table[:n]


def signature(shingles: np.ndarray, edges: np.ndarray, hops: Hops) -> np.ndarray:
    """Smallest hash of every bin of the sorted ``shingles``; empty bins copy the first filled one on their way."""
    cuts = np.append(np.searchsorted(shingles, edges), len(shingles))
    filled = cuts[1:] > cuts[:-1]
    values = shingles[np.minimum(cuts[:-1], len(shingles) - 1)]
    empty = np.flatnonzero(~filled)
    before, upto = 0, 32
    while len(empty):
        way = hops.upto(upto)[before:, empty]
        hits = filled[way]
        at = hits.argmax(axis=0)
        met = hits.any(axis=0)
        values[empty[met]] = values[way[at[met], np.flatnonzero(met)]]
        empty = empty[~met]
        before, upto = upto, upto * 4
    return values


def bin_edges(bins: int) -> np.ndarray:
    return np.array([-(-(i << 64) // bins) for i in range(bins)], np.uint64)


def band_buckets(values: np.ndarray, bands: int) -> np.ndarray:
    rows = values.reshape(bands, -1)
    total = mixed(np.arange(bands, dtype=np.uint64))
    for column in rows.T:
        total = mixed(total ^ column)
    return total


def least_agreement(n: np.ndarray, percent: int, bins: int) -> np.ndarray:
    """Agreeing bins five standard deviations below the bound; a set of ``n`` shingles fills only part of the bins."""
    share = percent / 100
    filled = bins * -np.expm1(-n / bins)
    return bins * (share - 5 * np.sqrt(share * (1 - share) / np.maximum(filled, 1)))


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Lower-cased texts (bytes: A-Z only) in lists of bounded size, with the number of the first."""
    chunk: list[bytes] = []
    size, first = 0, 0
    for i, text in enumerate(texts):
        lowered = text.as_py().lower()
        chunk.append(lowered)
        size += len(lowered)
        if size > CHUNK_BYTES:
            yield first, chunk
            chunk, size, first = [], 0, i + 1
    if chunk:
        yield first, chunk


def _scanner(words: int, percent: int, bands: int, rows: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = bands * rows
        edges, hops = bin_edges(bins), Hops(bins)
        for batch in batches:
            seen: set[bytes] = set()
            for first, chunk in _chunks(batch.column(1)):
                sizes, keys, signatures, buckets = [], [], [], []
                for text in chunk:
                    shingles = shingle_set(text, words)
                    n = len(shingles)
                    key = set_key(shingles) if n else None
                    sizes.append(n)
                    keys.append(key)
                    # A set this small is similar to no other; of equal sets in a batch one has the signature.
                    alone = 100 * n < percent * (n + 1)
                    values = None if alone or key in seen else signature(shingles, edges, hops)
                    seen.add(key)
                    signatures.append(None if values is None else (mixed(values) >> np.uint64(56)).astype(np.uint8).tobytes())
                    buckets.append(None if values is None else band_buckets(values, bands).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(chunk)),
                        pa.array(sizes, pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.array(signatures, pa.binary()),
                        pa.array(buckets, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n", "key", "signature", "buckets"],
                )

    return scan


def _keyed(words: int):
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[bytes] = set()
            for first, chunk in _chunks(batch.column(0)):
                keys, places = [], []
                for i, text in enumerate(chunk, first):
                    key = set_key(shingles) if len(shingles := shingle_set(text, words)) else b""
                    if key not in seen:
                        seen.add(key)
                        keys.append(key)
                        places.append(i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), batch.column(0).take(pa.array(places, pa.int64()))], ["key", "text"]
                )

    return own


def similar(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Of two sorted sets."""
    short, long = (one, other) if len(one) <= len(other) else (other, one)
    if 100 * len(short) < percent * len(long):
        return False
    at = np.searchsorted(long, short)
    shared = int((long[np.minimum(at, len(long) - 1)] == short).sum())
    return 100 * shared >= percent * (len(one) + len(other) - shared)


def _similar(words: int, percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple[bytes, int] | None = None
        centre: np.ndarray | None = None
        for batch in batches:
            ones, others = [], []
            for i in range(batch.num_rows):  # one text at a time
                a, part, b, text = (batch.column(c)[i].as_py() for c in range(4))
                shingles = shingle_set(text.lower(), words)
                if b is None:
                    group, centre = (a, part), shingles
                elif (a, part) != group:
                    raise RuntimeError("no text of a centre")
                elif similar(centre, shingles, percent):
                    ones.append(a)
                    others.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ones, pa.binary()), pa.array(others, pa.binary())], ["a", "b"])

    return confirm


def likely_pairs(n: np.ndarray, component: np.ndarray, part: np.ndarray, bytes_of: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A forest over the pairs whose components differ and whose sizes and signatures allow a link.

    If there are rows of two parts, only pairs between them count: pairs within a part have a cell of their own. Pairs
    that the forest connects already are not looked at.
    """
    least = least_agreement(n, percent, bytes_of.shape[1])
    both = part.min() != part.max()
    tree = np.arange(len(n))
    found = []
    for i in range(len(n)):
        facing = slice(i + 1, None)
        able = (component[facing] != component[i]) & (tree[facing] != tree[i])
        able &= percent * np.maximum(n[facing], n[i]) <= 100 * np.minimum(n[facing], n[i])
        if both:
            able &= part[facing] != part[i]
        places = np.flatnonzero(able) + i + 1
        for start in range(0, len(places), STRIP):
            strip = places[start : start + STRIP]
            agreeing = (bytes_of[strip] == bytes_of[i]).sum(axis=1)
            found += _grown(tree, i, strip[agreeing >= np.minimum(least[strip], least[i])])
    return found


def _grown(tree: np.ndarray, i: int, partners: np.ndarray) -> list[tuple[int, int]]:
    """Add the edges from ``i`` that connect two trees; ``tree`` numbers the tree of every place."""
    added = []
    for j in partners:
        if tree[i] != tree[j]:
            tree[tree == tree[j]] = tree[i]
            added.append((i, int(j)))
    return added


def overlaps(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of the sets of both lists, by products of incidence matrices of the shared entries."""
    entries = np.concatenate([np.zeros(0, np.uint64), *one, *two])
    owner = np.repeat(np.arange(len(one) + len(two)), [len(x) for x in [*one, *two]])
    _, column, counts = np.unique(entries, return_inverse=True, return_counts=True)
    often = counts > 1
    keep = often[column]
    owner, column = owner[keep], (np.cumsum(often) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(one), len(two)))
    for first in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        held = np.zeros((len(one) + len(two), COLUMNS), np.float32)
        held[owner[a:b], column[a:b] - first] = 1
        total += held[: len(one)] @ held[len(one) :].T
    return total


def linked_pairs(sets: list[np.ndarray], component: np.ndarray, part: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A forest over the links between different components, with parts as in ``likely_pairs``."""
    ones = np.flatnonzero(part == part.min())
    others = np.flatnonzero(part == part.max())
    sizes = np.array([len(x) for x in sets])
    shared = overlaps([sets[i] for i in ones], [sets[j] for j in others])
    links = 100 * shared >= percent * (sizes[ones][:, None] + sizes[others][None, :] - shared)
    links &= component[ones][:, None] != component[others][None, :]
    tree = np.arange(len(sets))
    return [edge for row, i in enumerate(ones) for edge in _grown(tree, int(i), others[links[row]])]


def _cellwise(compare):
    """Apply ``compare`` to the rows of one cell at a time; it gives pairs of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: tuple[bytes, int, int] | None = None
        rows: list[tuple] = []

        def compared() -> pa.RecordBatch:
            part, keys, *rest = zip(*rows, strict=True)
            ends = [sorted((keys[i], keys[j])) for i, j in compare(np.array(part), *rest)]
            columns = [pa.array([end[k] for end in ends], pa.binary()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays(columns, ["a", "b"])

        for batch in batches:
            for i in range(batch.num_rows):
                gathered, one, two, *row = (column[i].as_py() for column in batch.columns)
                if (gathered, one, two) != cell:
                    if rows:
                        yield compared()
                    cell, rows = (gathered, one, two), []
                rows.append(tuple(row))
        if rows:
            yield compared()

    return run


def _numbered(components: tuple[bytes, ...]) -> np.ndarray:
    numbers = {component: i for i, component in enumerate(dict.fromkeys(components))}
    return np.array([numbers[c] for c in components])


def _likely(percent: int, bins: int):
    def compare(part, n, components, signatures):
        matrix = np.frombuffer(b"".join(signatures), np.uint8).reshape(len(n), bins)
        return likely_pairs(np.array(n, np.int64), _numbered(components), part, matrix, percent)

    return _cellwise(compare)


def _linked(words: int, percent: int):
    def compare(part, components, texts):
        return linked_pairs([shingle_set(text.lower(), words) for text in texts], _numbered(components), part, percent)

    return _cellwise(compare)
