"""Secret scan: known forms by pattern, unknown ones by a battery of randomness tests.

Known forms are the kinds ``assign``, ``access`` and ``hex``; their spans always stay. Any other run of at least
``SHORTEST`` characters of an encoding alphabet is a candidate of the kind ``random``:

1. The encoding is inferred from the characters (hex, base32 and base36 of either case, letters and digits, base64 and its
   URL form). An equals sign parts a name from its value; up to two at the end of a run are padding.
2. Three tests against a uniform draw from that alphabet: chi-squared of the character counts, runs of its lower and upper
   half, serial correlation of neighbours. Their standard scores, squared and summed, must stay below the critical
   value, else the run is no random text.
3. The chi-squared statistic of ordinary text grows with its length. How far below that the statistic lies gives a
   p-value for "this is ordinary text", sharper for longer runs.
4. False-discovery control by the step-up rule over all candidates of the corpus, in bands of length: among the accepted
   runs of a band the expected share of ordinary text is at most ``RATE``. The rule works on counts per
   tenth of a decade of p, one small table for any corpus, and rounds to the safe side.

DataFrame and SQL functions only. Positions are code points, ends exclusive.

The work on a text grows with its length and, by a small factor, with its matches: places are sums of lengths in blocks.

Defined cases: null counts as empty; whole texts are read however long they are; further columns are not read; texts without a match have no spans; a candidate that overlaps a known form is left
to it; rows are independent but for the rates, so repeated rows get equal spans; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import identified, let, sql_list
from skyfold.session import written_table

# The known forms, in the order in which their kinds are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

SHORTEST = 20
RUN = f"[A-Za-z0-9+/_-]{{{SHORTEST},}}={{0,2}}"  # '=' only ends a run, as padding
BANDS = (20, 32, 64, 128)
RATE = 0.01
CRITICAL = 16.27  # of the sum of three squared standard scores, exceeded by one random text in a thousand
LETTER_REPEAT = 0.065  # chance that two characters of ordinary text agree
SPREAD = 0.3  # of that chance, squared, between texts
STEPS = 300  # tenths of a decade of p

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = (
    ("^[0-9a-f]+$", DIGITS + "abcdef"),
    ("^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("^[A-Z2-7]+$", UPPER + "234567"),
    ("^[a-z2-7]+$", LOWER + "234567"),
    ("^[a-z0-9]+$", LOWER + DIGITS),
    ("^[A-Z0-9]+$", UPPER + DIGITS),
    ("^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    ("^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
)

SPAN = "struct<start: int, kind: int, end: int>"
BLOCK = 64  # matches whose places are summed at once


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """``doc_id, base_spans, random_spans``: arrays of ``(start, kind, end)`` in this order, ``kind`` an index of ``KINDS``."""
    texts = identified(docs, id_col, text_col).selectExpr("doc_id", "coalesce(text, '') AS text")
    known = texts.selectExpr(
        "doc_id",
        "text",
        _spans(ASSIGN, 0, f"length(value) >= {LEAST_VALUE}", 2) + " AS assigned",
        # Shorter matches are dropped anyway, and no longer one can begin inside a dropped one.
        _spans(f"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}", 1, "true") + " AS access_keys",
        _spans(f"[0-9a-f]{{{LEAST_HEX},}}", 2, "true") + " AS hex_runs",
        _candidates() + " AS runs",
    )
    scanned = written_table(
        known.selectExpr("doc_id", "sort_array(concat(assigned, access_keys, hex_runs)) AS base_spans", "runs").selectExpr(
            "doc_id",
            "base_spans",
            _left_over() + " AS runs",
        )
    )
    accepted = _accepted_steps(scanned, rate)
    cases = " ".join(f"WHEN r.band = {band} THEN r.step >= {step}" for band, step in accepted.items())
    chosen = f"filter(runs, r -> CASE {cases} ELSE false END)" if accepted else "filter(runs, r -> false)"
    return scanned.selectExpr(
        "doc_id", "base_spans", f"transform({chosen}, r -> struct(r.start AS start, {KINDS.index('random')} AS kind, r.end AS end)) AS random_spans"
    )


def rendered(spans: str) -> str:
    """SQL: spans as ``kind:start:end``, comma-joined, by start and then kind."""
    kinds = f"array({sql_list(KINDS)})"
    return f"array_join(transform(sort_array({spans}), s -> concat({kinds}[s.kind], ':', s.start, ':', s.end)), ',')"


def _spans(pattern: str, kind: int, keep: str, group: int = 0, with_value: bool = False) -> str:
    """SQL: the spans of a pattern's matches, on demand with their text. The texts between the matches give their places."""
    more, more_type = (", piece.value AS value", ", value: string") if with_value else ("", "")
    return let(
        f"regexp_extract_all(text, {_literal(pattern)}, 0)",
        "found",
        f"CASE WHEN size(found) = 0 THEN CAST(array() AS array<{SPAN[:-1]}{more_type}>>) ELSE "
        + let(
            f"zip_with(split(text, {_literal(pattern)}, -1), zip_with(found, regexp_extract_all(text, {_literal(pattern)}, {group}), "
            "(whole, value) -> struct(whole, value)), (gap, match) -> struct(length(gap) AS gap, length(match.whole) AS whole, "
            "match.value AS value))",
            "pieces",
            let(
                _running_sums("transform(pieces, piece -> piece.gap + coalesce(piece.whole, 0))"),
                "ends",
                # After the last match comes one more gap, which has no value and is cut off.
                f"""filter(transform(slice(pieces, 1, size(found)), (piece, i) -> CASE WHEN {keep.replace("value", "piece.value")} THEN
                    struct(ends[i] - piece.whole AS start, {kind} AS kind, ends[i] AS end{more}) END), s -> s IS NOT NULL)""",
            ),
        )
        + " END",
    )


def _left_over() -> str:
    """SQL: the runs that pass the battery and overlap no known form.

    A run overlaps as many known forms as begin before its end, less those that end up to its start; both counts are running
    sums over sorted places, as runs follow each other without overlap.
    """
    # At equal places the order of the second field decides: a form that begins at a run's end is not counted, one that ends at
    # its start is.
    begun = _counts(
        "transform(base_spans, b -> struct(b.start AS at, 1 AS later, 1 AS known))", "transform(runs, r -> struct(r.end AS at, 0 AS later, 0 AS known))"
    )
    ended = _counts(
        "transform(base_spans, b -> struct(b.end AS at, 0 AS later, 1 AS known))", "transform(runs, r -> struct(r.start AS at, 1 AS later, 0 AS known))"
    )
    overlapping = let(begun, "begun", let(ended, "ended", "filter(runs, (r, i) -> r.alike AND begun[i] = ended[i])"))
    return f"CASE WHEN size(runs) = 0 OR size(base_spans) = 0 THEN filter(runs, r -> r.alike) ELSE {overlapping} END"


def _counts(forms: str, runs: str) -> str:
    """SQL: for each run, in order, the number of known forms up to its place."""
    sums = _running_sums("transform(places, place -> place.known)")
    counts = "filter(transform(places, (place, i) -> CASE WHEN place.known = 0 THEN sums[i] END), n -> n IS NOT NULL)"
    return let(f"array_sort(concat({forms}, {runs}))", "places", let(sums, "sums", counts))


def _running_sums(lengths: str) -> str:
    """SQL: the sums of an array's items up to each place.

    Blocks of ``BLOCK`` items: sums within a block are taken by slices, those of the blocks before are added. An aggregation
    that appends to an array would copy it at every step.
    """
    return let(
        lengths,
        "items",
        let(
            f"transform(sequence(0, (size(items) - 1) div {BLOCK}), b -> aggregate(slice(items, b * {BLOCK} + 1, {BLOCK}), 0, (sum, n) -> sum + n))",
            "blocks",
            f"""flatten(transform(blocks, (total, b) -> {let(
                "aggregate(slice(blocks, 1, b), 0, (sum, n) -> sum + n)",
                "before",
                f"transform(slice(items, b * {BLOCK} + 1, {BLOCK}), (n, i) -> before + "
                f"aggregate(slice(items, b * {BLOCK} + 1, i + 1), 0, (sum, m) -> sum + m))",
            )}))""",
        ),
    )


def _candidates() -> str:
    """SQL: runs of encoding characters with the outcome of the battery."""
    spans = _spans(RUN, KINDS.index("random"), "true", with_value=True)
    run = "rtrim('=', r.value)"
    encoding = "CASE " + " ".join(f"WHEN v RLIKE '{pattern}' THEN '{alphabet}'" for pattern, alphabet in ENCODINGS) + " END"
    judged = let(run, "v", let(encoding, "a", let(_measures(), "m", _outcome())))
    return f"filter(transform({spans}, r -> {judged}), r -> r IS NOT NULL)"


def _measures() -> str:
    """Of the run ``v`` over the alphabet ``a``: length, alphabet size, and the statistics of the three tests."""
    squares = "aggregate(transform(split(a, ''), c -> length(v) - length(replace(v, c, ''))), 0D, (sum, n) -> sum + n * n)"
    half = "transform(split(v, ''), c -> int(2 * (instr(a, c) - 1) >= length(a)))"
    runs = let(half, "h", "size(filter(h, (x, i) -> i = 0 OR x <> h[i - 1]))")
    upper = f"aggregate({half}, 0, (sum, x) -> sum + x)"
    centred = "transform(split(v, ''), c -> (instr(a, c) - 1 - (length(a) - 1) / 2D) / sqrt((length(a) * length(a) - 1) / 12D))"
    products = let(centred, "x", "aggregate(transform(slice(x, 2, size(x)), (y, i) -> y * x[i]), 0D, (sum, y) -> sum + y)")
    return (
        f"CASE WHEN a IS NOT NULL AND length(v) >= {SHORTEST} THEN struct(double(length(v)) AS l, double(length(a)) AS k, "
        f"{squares} AS squares, double({runs}) AS runs, double({upper}) AS upper, {products} AS products) END"
    )


def _outcome() -> str:
    """The span with ``alike`` (the battery passed), ``step`` (tenths of decades of p) and the band of length."""
    chi = "(m.k / m.l * m.squares - m.l)"
    uniform = f"greatest(0D, ({chi} - (m.k - 1)) / sqrt(2 * (m.k - 1)))"
    mean = "(2 * m.upper * (m.l - m.upper) / m.l + 1)"
    halves = f"coalesce(try_divide(m.runs - {mean}, sqrt(({mean} - 1) * ({mean} - 2) / (m.l - 1))), 99D)"
    serial = "(m.products / sqrt(m.l - 1))"
    repeat = f"greatest({LETTER_REPEAT}D, 1.6D / m.k)"
    ordinary = f"(m.k + m.k * (m.l - 1) * {repeat} - m.l)"
    spread = f"(m.k / m.l * {repeat} * sqrt(4 * m.l * m.l * m.l * {SPREAD}D + 2 * m.l * m.l))"
    # -ln of a normal tail, by the logistic approximation.
    tail = let(f"({chi} - {ordinary}) / {spread}", "z", "ln(1 + exp(least(700D, -1.5976D * z - 0.07056D * z * z * z)))")
    bands = " ".join(f"WHEN m.l >= {least} THEN {least}" for least in reversed(BANDS))
    return (
        f"CASE WHEN m IS NOT NULL THEN struct(r.start AS start, r.end AS end, "
        f"pow({uniform}, 2) + pow({halves}, 2) + pow({serial}, 2) <= {CRITICAL} AS alike, "
        f"int(least({STEPS}, floor(10 * ({tail}) / ln(10D)))) AS step, CASE {bands} ELSE {BANDS[0]} END AS band) END"
    )


def _accepted_steps(scanned: DataFrame, rate: float) -> dict[int, int]:
    """Per band the least step that is accepted: the largest p with ``p <= rate * (runs at or below p) / runs``."""
    counted = scanned.selectExpr("inline(runs)").groupBy("band", "step").agg(F.count(F.lit(1)).alias("n"))
    ranked = counted.selectExpr(
        "band",
        "step",
        "sum(n) OVER (PARTITION BY band ORDER BY step DESC) AS reached",
        "sum(n) OVER (PARTITION BY band) AS all_runs",
    )
    passing = ranked.where(F.expr(f"pow(10D, -step / 10D) <= {float(rate)!r}D * reached / all_runs"))
    return {row.band: row.step for row in passing.groupBy("band").agg(F.min("step").alias("step")).collect()}  # a row per band


def _literal(pattern: str) -> str:
    return 'r"' + pattern.replace('"', r"\x22") + '"'
