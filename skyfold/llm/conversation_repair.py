"""Repair of conversation structure: the cheapest edits to ``(s?(ua)+)?``, by Four-Russians block tables.

The rows of a conversation, by turn, are kept (cost 0), given the role user or assistant (``R``, 2), deleted (``D``, 3) or
preceded by inserted rows without text (``I``, 2 each), so that the initials of the roles read: nothing, or an optional system
row and then user and assistant in turn. Blank rows and duplicates (role and text seen earlier) must be deleted; a truncated row
(its last character but white space is not ``.``, ``!`` or ``?``) adds 1 unless it is deleted. Each row's first fault counts.

1. A row is one of nine symbols: must be deleted, or its initial (s, u, a, other) and whether it is truncated. The costs of
   everything after a row form a vector over the four states of the pattern. Less its least entry, only a few vectors
   exist, since edits bound the differences.
2. Block tables: for every block of ``BLOCK`` symbols and every such vector, the vector before the block and the cost added.
   A conversation is processed from its end, one lookup per block.
3. Tracing goes forward: a block is expanded backward, from the vector behind it, into those behind its rows, and in each
   state the least letter that is still cheapest is taken. So of all cheapest edits the ASCII-least are found.

Conversations are exchanged by identifier and sorted; a task holds one at a time. Those of more than ``LONG_ROWS`` rows or
``LONG_BYTES`` bytes never meet in a task: their rows are sorted by range, cut into chunks, and a chunk's table from vector to
vector is composed with those of the others (a few hundred bytes a chunk), likewise the states; duplicates are told
by joins on digests. Only the digest of a repaired conversation, which is sequential by its nature, is taken in one task,
chunk by chunk.

Defined cases: a null identifier is one conversation; null turns come first; rows of one turn are ordered by role and text;
a null role or text counts as one space; a role without characters has no initial and cannot be kept; repeated rows are
duplicates; texts of any length are kept whole; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import quoted
from skyfold.session import written_table

BLOCK = 4
LONG_ROWS = 50_000
LONG_BYTES = 64_000_000
CHUNK_ROWS = 16_384
CHUNK_BYTES = 8_000_000
# Identifiers of long conversations that may be broadcast, 8 bytes each; beyond that Spark joins by exchange.
BROADCAST_ROWS = 1_000_000

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SYMBOLS, MUST_DELETE = 9, 8
# States: nothing yet, after system, after user, after assistant. What is put next is a user row, after user an assistant row.
NEXT = (2, 2, 3, 2)
ACCEPTED = (0, 3)
ROLE_OF_STATE = {2: "user", 3: "assistant"}
MOVES = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
INITIALS = "sua"
LEGAL = ("su", "ua", "au")
WHITE = r"\t\n\u000B\u000C\r "

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = ", ".join(f"{name} bigint" for name in ("conv_id", *COUNTS)) + ", audit string, repaired_sha256 string"
EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()


def repair_conversations(
    turns: DataFrame,
    identifiers: DataFrame | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``, one row per conversation.

    With ``identifiers``, a table that has ``conv_col``, its conversations without rows get zeros, an empty audit and the
    digest of nothing.
    """
    rows = turns.select(
        F.col(quoted(conv_col)).cast("bigint").alias("conv_id"),
        F.col(quoted(turn_col)).cast("bigint").alias("turn"),
        F.coalesce(F.col(quoted(role_col)), F.lit(" ")).alias("role"),
        F.coalesce(F.col(quoted(text_col)), F.lit(" ")).alias("text"),
    )
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("octet_length(role) + octet_length(text)")).alias("bytes"))
    long = written_table(sizes.where(f"n > {LONG_ROWS} OR bytes > {LONG_BYTES}").selectExpr("conv_id AS long_id"))
    n_long = long.count()
    result = rows
    if n_long:
        long = F.broadcast(long) if n_long <= BROADCAST_ROWS else long
        same = rows["conv_id"].eqNullSafe(long["long_id"])
        result = rows.join(long, same, "left_anti")
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    faults = ["*", f"rtrim('{WHITE}', text) AS trimmed"]
    judged = ["conv_id", "turn", "role", "text", "trimmed = '' AS blank", "right(trimmed, 1) NOT IN ('.', '!', '?') AS truncated"]
    result = result.repartition("conv_id").sortWithinPartitions(*order).selectExpr(*faults).selectExpr(*judged)
    result = result.mapInArrow(_repair_each, RESULT)
    if n_long:
        found = rows.join(long, same, "left_semi").selectExpr(*faults).selectExpr(*judged)
        result = result.unionByName(_repaired_by_chunks(written_table(found.withColumn("row", F.monotonically_increasing_id()))))
    if identifiers is None:
        return result
    wanted = identifiers.select(F.col(quoted(conv_col)).cast("bigint").alias("wanted_id")).distinct()
    joined = wanted.join(result, wanted["wanted_id"].eqNullSafe(result["conv_id"]), "left")
    return joined.selectExpr(
        "wanted_id AS conv_id",
        *[f"coalesce({name}, 0L) AS {name}" for name in COUNTS],
        "coalesce(audit, '') AS audit",
        f"coalesce(repaired_sha256, '{EMPTY_DIGEST}') AS repaired_sha256",
    )


CHUNK_SCHEMA = (
    "conv_id bigint, part int, number int, symbols binary, roles array<string>, texts array<string>, blank bigint, duplicate bigint, "
    "truncated bigint, illegal bigint, first string, last string, moves array<int>, costs array<bigint>"
)
PLACE = ["conv_id", "part", "number"]


def _repaired_by_chunks(rows: DataFrame) -> DataFrame:
    """The conversations in ``rows`` (written, with a number ``row``) without gathering any of them."""
    content = "sha2(concat(length(role), ':', role, text), 256) AS content"
    told = rows.selectExpr("*", content)
    firsts = told.groupBy("conv_id", "content").agg(F.expr("min(struct(turn, row)).row AS first_row"))
    same = told["conv_id"].eqNullSafe(firsts["conv_id"]) & (told["content"] == firsts["content"])
    marked = told.join(firsts, same).select(told["*"], F.expr("row <> first_row AS repeated"))
    by_turn = ["conv_id", F.asc_nulls_first("turn"), "role"]
    ordered = marked.repartitionByRange(*by_turn, F.expr("left(text, 64)")).sortWithinPartitions(*by_turn, "text", "row")
    ordered = ordered.select("conv_id", "role", "text", "blank", "repeated", "truncated")
    chunks = written_table(ordered.mapInArrow(_chunks, CHUNK_SCHEMA))

    tables = chunks.drop("symbols", "roles", "texts")
    behind = tables.groupBy("conv_id").applyInArrow(
        _composed_vectors, "conv_id bigint, part int, number int, behind int, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
    )
    behind = written_table(behind)
    placed = _same_place(chunks.select(*PLACE, "symbols"), behind.select(*PLACE, "behind"))
    ends = written_table(placed.mapInArrow(_end_states, "conv_id bigint, part int, number int, ends array<int>"))
    states = ends.groupBy("conv_id").applyInArrow(_composed_states, "conv_id bigint, part int, number int, state int, closing int")
    known = _same_place(behind.select(*PLACE, "behind"), states)
    pieces = _same_place(chunks.select(*PLACE, "symbols", "roles", "texts"), known)
    pieces = pieces.select(*PLACE, "behind", "state", "closing", "symbols", "roles", "texts")
    pieces = pieces.mapInArrow(_traced_chunks, "conv_id bigint, part int, number int, audit string, repaired binary")
    digests = pieces.repartition("conv_id").sortWithinPartitions(*PLACE).mapInArrow(
        _digested, "conv_id bigint, audit string, repaired_sha256 string"
    )
    span = "coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0L) AS gaps"
    counts = behind.groupBy("conv_id").agg(*[F.sum(name).alias(name) for name in ("blank", "duplicate", "truncated", "illegal", "cost")])
    gaps = rows.groupBy("conv_id").agg(F.expr(span))
    counted = counts.withColumnRenamed("conv_id", "id").join(gaps, F.expr("id <=> conv_id")).drop("id")
    named = digests.withColumnRenamed("conv_id", "id").join(counted, F.expr("id <=> conv_id")).drop("id")
    return named.select("conv_id", *COUNTS, "audit", "repaired_sha256")


def _same_place(one: DataFrame, other: DataFrame) -> DataFrame:
    renamed = other.withColumnsRenamed({name: f"other_{name}" for name in PLACE})
    joined = one.join(renamed, F.expr("conv_id <=> other_conv_id AND part = other_part AND number = other_number"))
    return joined.drop(*[f"other_{name}" for name in PLACE])


# --- block tables -------------------------------------------------------------------------------------


class Tables:
    """Normalised vectors, their transitions over single symbols and blocks, and the letters of the cheapest edits.

    ``before[v][symbol]`` and ``added[v][symbol]``: vector before a row, if ``v`` is the one behind it, and the cost added;
    ``block_before`` and ``block_added`` likewise for the code of a block, whose first symbol is the highest digit;
    ``letters[v][symbol][state]``: edits up to and including the row, and the state after it.
    """

    def __init__(self, block: int):
        self.block = block
        self.vectors = [normalised(closed((0, 99, 99, 0)))[0]]
        numbers = {self.vectors[0]: 0}
        self.before: list[list[int]] = []
        self.added: list[list[int]] = []
        self.letters: list[list[list[tuple[str, int]]]] = []
        for vector in self.vectors:  # grows while new vectors are met
            before, added, letters = [], [], []
            for symbol in range(SYMBOLS):
                found, least = normalised(vector_before(vector, symbol))
                if found not in numbers:
                    numbers[found] = len(self.vectors)
                    self.vectors.append(found)
                before.append(numbers[found])
                added.append(least)
                letters.append([cheapest_letters(vector, symbol, state) for state in range(4)])
            self.before.append(before)
            self.added.append(added)
            self.letters.append(letters)
        single = np.array(self.before), np.array(self.added)
        self.block_before, self.block_added = single
        for _ in range(block - 1):
            # A symbol is put before every shorter block.
            met, cost = self.block_before[:, None, :], self.block_added[:, None, :]
            symbols = np.arange(SYMBOLS)[None, :, None]
            self.block_added = (cost + single[1][met, symbols]).reshape(len(self.vectors), -1)
            self.block_before = single[0][met, symbols].reshape(len(self.vectors), -1)

    def boundaries(self, symbols: bytes, behind: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Vectors behind each block, first block first, and before all; and the costs added.

        ``behind`` are the vectors behind the last symbol, processed side by side. The last block may be short.
        """
        costs = np.zeros(len(behind), np.int64)
        full = len(symbols) - len(symbols) % self.block
        vectors = [behind]
        if full < len(symbols):
            for symbol in reversed(symbols[full:]):
                costs += np.array(self.added)[behind, symbol]
                behind = np.array(self.before)[behind, symbol]
            vectors.append(behind)
        digits = np.frombuffer(symbols, np.uint8, full).reshape(-1, self.block).astype(np.int64)
        codes = digits @ SYMBOLS ** np.arange(self.block - 1, -1, -1)
        for code in codes[::-1]:
            costs += self.block_added[behind, code]
            behind = self.block_before[behind, code]
            vectors.append(behind)
        return vectors[::-1], costs

    def traced(self, symbols: bytes, behind: int, state: int) -> tuple[list[str], int]:
        """The letters up to every row and the state after the last, given the vector behind it."""
        vectors, _ = self.boundaries(symbols, np.array([behind]))
        letters: list[str] = []
        for number, start in enumerate(range(0, len(symbols), self.block)):
            block = symbols[start : start + self.block]
            expanded = [int(vectors[number + 1][0])]
            for symbol in reversed(block[1:]):
                expanded.append(self.before[expanded[-1]][symbol])
            for symbol, vector in zip(block, reversed(expanded), strict=True):
                edits, state = self.letters[vector][symbol][state]
                letters.append(edits)
        return letters, state


def closed(costs: tuple[int, ...]) -> tuple[int, ...]:
    """With up to two inserted rows first; more would only repeat a state."""
    return tuple(min(costs[q], INSERT + costs[NEXT[q]], 2 * INSERT + costs[NEXT[NEXT[q]]]) for q in range(4))


def normalised(costs: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    least = min(costs)
    return tuple(cost - least for cost in costs), least


def row_edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """Letter, cost and next state of what may be done with a row, least letter first."""
    edits = [("D", DELETE, state)]
    if symbol != MUST_DELETE:
        truncated = symbol % 2 * TRUNCATED
        initial = (*INITIALS, "")[symbol // 2]
        if (initial, state) in MOVES:
            edits.append(("K", KEEP + truncated, MOVES[initial, state]))
        edits.append(("R", REROLE + truncated, NEXT[state]))
    return edits


def vector_before(behind: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    return closed(tuple(min(cost + behind[after] for _, cost, after in row_edits(symbol, q)) for q in range(4)))


def cheapest_letters(behind: tuple[int, ...], symbol: int, state: int) -> tuple[str, int]:
    costs = vector_before(behind, symbol)
    letters = ""
    while True:
        left = costs[state]
        edits = [(letter, after) for letter, cost, after in row_edits(symbol, state) if cost + behind[after] == left]
        if INSERT + costs[NEXT[state]] == left and not (edits and edits[0][0] < "I"):
            letters, state = letters + "I", NEXT[state]
        else:
            return letters + edits[0][0], edits[0][1]


def closing_letters(state: int) -> str:
    """Rows to insert after the last one."""
    letters = ""
    while state not in ACCEPTED:
        letters, state = letters + "I", NEXT[state]
    return letters


@functools.cache
def tables(block: int = BLOCK) -> Tables:
    return Tables(block)


def symbol_of(role: str, deleted: bool, truncated: bool) -> int:
    return MUST_DELETE if deleted else 2 * (INITIALS.find(role[0]) % 4 if role else 3) + bool(truncated)


def repaired_lines(letters: list[str], roles: list[str], texts: list[str], state: int, closing: str) -> Iterator[str]:
    for edits, role, text in itertools.chain(zip(letters, roles, texts, strict=True), [(closing, "", "")]):
        for letter in edits:
            if letter == "D":
                continue
            if letter == "K":
                state = MOVES[role[0], state]
                yield f"{role}:{text}"
            else:
                state = NEXT[state]
                yield f"{ROLE_OF_STATE[state]}:{text if letter == 'R' else ''}"


# --- inside tasks -------------------------------------------------------------------------------------


def _repair_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    none = object()
    current: object = none
    rows: list[tuple] = []

    def packed(results: list[tuple]) -> pa.RecordBatch:
        types = [*[pa.int64()] * (1 + len(COUNTS)), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in results], t) for i, t in enumerate(types)], names)

    for batch in batches:
        results = []
        for conv_id, *row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if conv_id != current:
                if rows:
                    results.append((current, *repaired(rows)))
                current, rows = conv_id, []
            rows.append(row)
        yield packed(results)
    if rows:
        yield packed([(current, *repaired(rows))])


def repaired(rows: list[tuple]) -> tuple:
    """Counts, audit and digest of one conversation's ``turn, role, text, blank, truncated`` rows."""
    seen: set[tuple[str, str]] = set()
    counts = [0, 0, 0]
    symbols = bytearray()
    for _, role, text, blank, truncated in rows:
        repeated = (role, text) in seen
        seen.add((role, text))
        symbols.append(symbol_of(role, blank or repeated, truncated))
        if blank or repeated or truncated:
            counts[0 if blank else 1 if repeated else 2] += 1
    turns = {row[0] for row in rows if row[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    roles = [row[1] for row in rows]
    known = tables()
    vectors, costs = known.boundaries(bytes(symbols), np.zeros(1, np.int64))
    letters, state = known.traced(bytes(symbols), 0, 0)
    closing = closing_letters(state)
    lines = repaired_lines(letters, roles, [row[2] for row in rows], 0, closing)
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    cost = int(costs[0]) + known.vectors[int(vectors[0][0])][0]
    return (gaps, *counts, illegal_pairs(roles), cost, "".join(letters) + closing, digest)


def illegal_pairs(roles: list[str]) -> int:
    return sum(one[:1] + other[:1] not in LEGAL for one, other in itertools.pairwise(roles))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as chunks of bounded size, numbered within the partition, with their tables from vector to vector."""
    part, number, held = TaskContext.get().partitionId(), 0, 0
    none = object()
    current: object = none
    rows: list[tuple] = []
    known = tables()

    def packed() -> pa.RecordBatch:
        roles, texts, blanks, repeats, truncations = (list(column) for column in zip(*rows, strict=True))
        symbols = bytes(symbol_of(r, b or d, t) for r, b, d, t in zip(roles, blanks, repeats, truncations, strict=True))
        vectors, costs = known.boundaries(symbols, np.arange(len(known.vectors)))
        faults = [sum(blanks), sum(d and not b for b, d in zip(blanks, repeats, strict=True))]
        faults.append(sum(t and not (b or d) for b, d, t in zip(blanks, repeats, truncations, strict=True)))
        values = [current, part, number, symbols, roles, texts, *faults, illegal_pairs(roles), roles[0][:1], roles[-1][:1]]
        values += [vectors[0].tolist(), costs.tolist()]
        schema = pa.schema([
            ("conv_id", pa.int64()), ("part", pa.int32()), ("number", pa.int32()), ("symbols", pa.binary()),
            ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("blank", pa.int64()), ("duplicate", pa.int64()),
            ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()),
            ("moves", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64())),
        ])
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    for batch in batches:
        for i in range(batch.num_rows):
            conv_id, *row = (column[i].as_py() for column in batch.columns)
            if rows and (conv_id != current or len(rows) >= CHUNK_ROWS or held > CHUNK_BYTES):
                yield packed()
                rows, held, number = [], 0, number + 1
            current = conv_id
            rows.append(tuple(row))
            held += len(row[0]) + len(row[1])
    if rows:
        yield packed()


def _in_order(chunks: pa.Table) -> list[dict]:
    return chunks.sort_by([("part", "ascending"), ("number", "ascending")]).to_pylist()


def _composed_vectors(chunks: pa.Table) -> pa.Table:
    """The vector behind every chunk of a conversation, from the last one back; the first has the conversation's cost."""
    rows = _in_order(chunks)
    vector, total = 0, 0
    for row in reversed(rows):
        row["behind"] = vector
        total += row["costs"][vector]
        vector = row["moves"][vector]
    out = []
    for i, row in enumerate(rows):
        illegal = row["illegal"] + (i > 0 and rows[i - 1]["last"] + row["first"] not in LEGAL)
        cost = 0 if i else total + tables().vectors[vector][0]
        out.append({name: row[name] for name in (*PLACE, "behind", "blank", "duplicate", "truncated")} | {"illegal": illegal, "cost": cost})
    return pa.Table.from_pylist(
        out,
        pa.schema([
            ("conv_id", pa.int64()), ("part", pa.int32()), ("number", pa.int32()), ("behind", pa.int32()), ("blank", pa.int64()),
            ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()),
        ]),
    )


PLACE_TYPES = [("conv_id", pa.int64()), ("part", pa.int32()), ("number", pa.int32())]


def _end_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state after a chunk for each state before it."""
    known = tables()
    for batch in batches:
        rows = batch.to_pylist()
        ends = [[known.traced(row["symbols"], row["behind"], state)[1] for state in range(4)] for row in rows]
        columns = [pa.array([row[name] for row in rows], kind) for name, kind in PLACE_TYPES]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(ends, pa.list_(pa.int32()))], [*PLACE, "ends"])


def _composed_states(chunks: pa.Table) -> pa.Table:
    """The state before every chunk; ``closing`` is the state after the last, null elsewhere."""
    rows, state, out = _in_order(chunks), 0, []
    for i, row in enumerate(rows):
        before, state = state, row["ends"][state]
        closing = state if i == len(rows) - 1 else None
        out.append({name: row[name] for name in PLACE} | {"state": before, "closing": closing})
    return pa.Table.from_pylist(out, pa.schema([*PLACE_TYPES, ("state", pa.int32()), ("closing", pa.int32())]))


def _traced_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = tables()
    for batch in batches:
        for i in range(batch.num_rows):  # one chunk at a time
            *place, behind, state, closing, symbols, roles, texts = (column[i].as_py() for column in batch.columns)
            letters, _ = known.traced(symbols, behind, state)
            last = "" if closing is None else closing_letters(closing)
            lines = "".join(line + "\n" for line in repaired_lines(letters, roles, texts, state, last))
            columns = [pa.array([x], kind) for x, (_, kind) in zip(place, PLACE_TYPES, strict=True)]
            audit, piece = pa.array(["".join(letters) + last]), pa.array([lines.encode()], pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, audit, piece], [*PLACE, "audit", "repaired"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and digest of every conversation from its chunks in order; a line's end counts only before another line."""
    none = object()
    current: object = none
    audits: list[str] = []
    digest, waiting = hashlib.sha256(), b""

    def packed() -> pa.RecordBatch:
        digest.update(waiting[:-1])
        columns = [pa.array([current], pa.int64()), pa.array(["".join(audits)]), pa.array([digest.hexdigest()])]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "audit", "repaired_sha256"])

    for batch in batches:
        for i in range(batch.num_rows):
            conv_id, _, _, audit, piece = (column[i].as_py() for column in batch.columns)
            if conv_id != current:
                if current is not none:
                    yield packed()
                current, audits, digest, waiting = conv_id, [], hashlib.sha256(), b""
            audits.append(audit)
            if piece:
                digest.update(waiting)
                waiting = piece
    if current is not none:
        yield packed()
