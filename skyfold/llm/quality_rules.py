"""Quality rules as a short-circuit cascade.

A rule rejects a document by a condition over statistics of its text. On a sample the operator times every rule and
counts what it rejects, then asks the rules in the order of rejections per second. The cascade is one CASE: a rule
after the first that rejects is not evaluated, so dear rules see only what cheap ones let through. The order decides
cost alone: a document is kept if no rule rejects it, in any order.

DataFrame and SQL functions only. A statistic is an expression over the text; a statistic that is already a column
(``measured``) is read instead of computed again.

Defined cases: a null text has no words and fails the rule on word count; a text without words likewise; an empty
table or sample leaves the rules in the given order.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import WORD_CLASS, identified, let
from skyfold.session import written_table

_TEXT = "coalesce(text, '')"
_WORDS = f"regexp_extract_all({_TEXT}, r'{WORD_CLASS}+', 0)"


def _symbols(text: str, characters: str) -> str:
    return f"regexp_count({text}, r'[{characters}]')"


# Starting places of the three-word windows met more than once, from sorted (hash, place) pairs; each further place
# covers as many new words as it is away from the one before, three at most.
_REPEATED = let(
    "sort_array(transform(windows, (h, i) -> struct(h, i)))",
    "s",
    let(
        "sort_array(transform(filter(s, (x, k) -> x.h <=> get(s, k - 1).h OR x.h <=> get(s, k + 1).h), x -> x.i))",
        "places",
        "aggregate(places, struct(-3 AS last, 0 AS n), (a, i) -> struct(i AS last, a.n + least(3, i - a.last) AS n), a -> a.n)",
    ),
)
_WINDOWS = (
    "CASE WHEN size(words) >= 3 THEN transform(sequence(0, size(words) - 3), "
    "i -> xxhash64(words[i], words[i + 1], words[i + 2])) ELSE array() END"
)

#: SQL over ``text``. Windows of words are compared by a 64-bit hash within one text.
STATISTICS: dict[str, str] = {
    "n_words": f"regexp_count({_TEXT}, r'{WORD_CLASS}+')",
    "word_chars": f"length(regexp_replace({_TEXT}, r'[\\x20\\x09-\\x0D]+', ''))",
    "n_symbols": _symbols(_TEXT, "#*$%&|<>"),
    "n_lines": f"size(filter(split({_TEXT}, '\\n'), line -> line RLIKE r'{WORD_CLASS}'))",
    "n_dup_lines": let(
        f"filter(split({_TEXT}, '\\n'), line -> line RLIKE r'{WORD_CLASS}')",
        "lines",
        "size(lines) - size(array_distinct(lines))",
    ),
    "n_repeat_words": let(
        _WORDS,
        "words",
        let(_WINDOWS, "windows", f"CASE WHEN size(array_distinct(windows)) = size(windows) THEN 0 ELSE {_REPEATED} END"),
    ),
    "n_letters": f"regexp_count({_TEXT}, r'\\p{{L}}')",
    "n_capitals": f"regexp_count({_TEXT}, r'\\p{{Lu}}')",
    "n_letter_words": f"regexp_count({_TEXT}, r'[^\\p{{L}}\\x20\\x09-\\x0D]*\\p{{L}}{WORD_CLASS}*')",
    "n_bullet_lines": f"regexp_count({_TEXT}, r'(?m)^[\\x20\\t]*[-*\\x{{2022}}][\\x20\\t]')",
    "n_ellipsis_lines": f"regexp_count({_TEXT}, r'(?m)(\\.\\.\\.|\\x{{2026}})[\\x20\\t\\r]*$')",
}

BASE_STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Rule(NamedTuple):
    """``rejects`` is SQL with statistics in braces."""

    name: str
    rejects: str


BASE_RULES = (
    Rule("few_words", "{n_words} < 50"),
    Rule("repeated_words", "100 * {n_repeat_words} > 50 * {n_words}"),
)
RULES = (
    *BASE_RULES,
    Rule("word_length", "NOT ({word_chars} BETWEEN 2.5 * {n_words} AND 12 * {n_words})"),
    Rule("symbols", "10 * {n_symbols} > {n_words}"),
    Rule("repeated_lines", "2 * {n_dup_lines} > {n_lines}"),
    Rule("capitals", "2 * {n_capitals} > {n_letters}"),
    Rule("few_letter_words", "10 * {n_letter_words} < 8 * {n_words}"),
    Rule("bullets", "10 * {n_bullet_lines} > 9 * {n_lines}"),
    Rule("ellipses", "10 * {n_ellipsis_lines} > 3 * {n_lines}"),
)


class RuleEstimate(NamedTuple):
    name: str
    seconds: float
    rejected: int


def measured(docs: DataFrame, statistics: Sequence[str] = BASE_STATISTICS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` and the statistics as bigint columns. Narrow."""
    texts = identified(docs, id_col, text_col)
    return texts.selectExpr("*", *[f"bigint({STATISTICS[name]}) AS {name}" for name in statistics])


def sample(docs: DataFrame, fraction: float, seed: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written sample on which rules are timed."""
    return written_table(identified(docs, id_col, text_col).sample(fraction=fraction, seed=seed))


def estimate(sampled: DataFrame, rules: Sequence[Rule] = RULES) -> list[RuleEstimate]:
    """Cost and selectivity of each rule on ``doc_id, text`` rows; the time of an empty rule is taken off."""

    def timed(condition: str) -> tuple[float, int]:
        best, rejected = float("inf"), 0
        for _ in range(2):  # the first run compiles
            start = time.perf_counter()
            rejected = sampled.agg(F.expr(f"count_if({condition})")).first()[0]
            best = min(best, time.perf_counter() - start)
        return best, rejected

    idle, _ = timed("length(text) < 0")
    estimates = []
    for rule in rules:
        seconds, rejected = timed(_bound(rule, {}))
        estimates.append(RuleEstimate(rule.name, max(seconds - idle, 1e-4), rejected))
    return estimates


def ordered(rules: Sequence[Rule], estimates: Sequence[RuleEstimate]) -> list[Rule]:
    """Most rejections per second first; equal ones as given."""
    rate = {e.name: e.rejected / e.seconds for e in estimates}
    return sorted(rules, key=lambda rule: -rate[rule.name])


def cascade(texts: DataFrame, rules: Sequence[Rule], measured_columns: Sequence[str] = ()) -> DataFrame:
    """Add ``rejected_by``, the first rule that rejects, and ``kept``; ``texts`` has the column ``text``."""
    columns = {name: name for name in measured_columns}
    cases = " ".join(f"WHEN {_bound(rule, columns)} THEN '{rule.name}'" for rule in rules)
    verdict = f"CASE {cases} END" if rules else "CAST(NULL AS STRING)"
    return texts.withColumn("rejected_by", F.expr(verdict)).withColumn("kept", F.expr("rejected_by IS NULL"))


def _bound(rule: Rule, columns: Mapping[str, str]) -> str:
    return rule.rejects.format(**{name: columns.get(name, f"({sql})") for name, sql in STATISTICS.items()})
