"""Coercion of JSON values to the declared kinds, as SQL expressions over a column given by its SQL name.

Fields of these kinds are parsed as VARIANT, which tells a quoted text from a number or a boolean: the text "5.0" is no integer
and "true" no number, while the JSON numbers and booleans are; the text "false" is true as any text that is not empty.
"""

from __future__ import annotations

# Spark's own cast also takes hexadecimal floats and a d/f suffix, which the catalogue format does not have.
DECIMAL_TEXT = r"r'(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|nan|inf(inity)?)\s*$'"
INTEGER_TEXT = r"r'^\s*[+-]?\d+\s*$'"
INFINITY = "double('infinity')"


def text_to_float(text: str) -> str:
    """For columns of text, where JSON booleans look like quoted ones and count as numbers."""
    return (
        f"CASE WHEN {text} RLIKE {DECIMAL_TEXT} THEN try_cast({text} AS DOUBLE) "
        f"WHEN {text} = 'true' THEN 1D WHEN {text} = 'false' THEN 0D END"
    )


def _is_text(value: str) -> str:
    return f"schema_of_variant({value}) = 'STRING'"


def _text(value: str) -> str:
    return f"try_variant_get({value}, '$', 'string')"


def _number(value: str) -> str:
    """Of a number or boolean; null for lists and objects."""
    return f"try_variant_get({value}, '$', 'double')"


def to_float(value: str) -> str:
    text = _text(value)
    return (
        f"CASE WHEN {_is_text(value)} THEN CASE WHEN {text} RLIKE {DECIMAL_TEXT} THEN try_cast({text} AS DOUBLE) END "
        f"ELSE {_number(value)} END"
    )


def to_int(value: str) -> str:
    """Integers of up to 38 digits; numbers lose their fraction. Null beyond 38 digits."""
    text, number = _text(value), _number(value)
    return (
        f"CASE schema_of_variant({value}) "
        f"WHEN 'STRING' THEN CASE WHEN {text} RLIKE {INTEGER_TEXT} THEN try_cast(trim({text}) AS DECIMAL(38, 0)) END "
        f"WHEN 'BIGINT' THEN try_cast({text} AS DECIMAL(38, 0)) "
        f"WHEN 'DOUBLE' THEN try_cast({number} - {number} % 1 AS DECIMAL(38, 0)) "
        f"WHEN 'BOOLEAN' THEN try_cast({number} AS DECIMAL(38, 0)) "
        # What is left are decimals, lists and objects.
        f"ELSE CASE WHEN {number} IS NOT NULL THEN try_cast(substring_index({text}, '.', 1) AS DECIMAL(38, 0)) END END"
    )


def _is_int(value: str) -> str:
    """Whether there is an integer, of any size. Unquoted numbers beyond the range of a double are infinite and none."""
    return (
        f"CASE WHEN {_is_text(value)} THEN {_text(value)} RLIKE {INTEGER_TEXT} "
        f"ELSE coalesce({is_finite(_number(value))}, false) END"
    )


def to_bool(value: str) -> str:
    """Truth: of numbers being non-zero, of texts, lists and objects being non-empty."""
    text = _text(value)
    return (
        f"CASE WHEN {_is_text(value)} THEN length({text}) > 0 "
        f"ELSE coalesce({_number(value)} <> 0, {text} NOT IN ('[]', '{{}}')) END"
    )


def to_time(value: str) -> str:
    """A number, or the mean of the first two entries of a list."""
    ends = [f"try_variant_get({value}, '$[{i}]', 'variant')" for i in (0, 1)]
    return (
        f"CASE WHEN startswith(schema_of_variant({value}), 'ARRAY') THEN ({to_float(ends[0])} + {to_float(ends[1])}) / 2 "
        f"ELSE {to_float(value)} END"
    )


COERCIONS = {"int": to_int, "float": to_float, "float_nan": to_float, "time": to_time, "bool": to_bool}


def json_type(kind: str) -> str:
    """The type as which a field of this kind is parsed."""
    return "VARIANT" if kind in COERCIONS else "STRING"


def coerce(value: str, kind: str) -> str:
    """Typed value; error fields default to NaN, other missing values stay null."""
    typed = COERCIONS[kind](value) if kind in COERCIONS else value
    return f"coalesce({typed}, double('nan'))" if kind == "float_nan" else typed


def is_missing(value: str, kind: str) -> str:
    """True for an absent field and for JSON null."""
    return f"({value} IS NULL OR is_variant_null({value}))" if kind in COERCIONS else f"{value} IS NULL"


def uncoercible(value: str, kind: str) -> str | None:
    """True where a value is present but is none of its kind; None for kinds that take anything."""
    if kind == "int":
        return f"(NOT {is_missing(value, kind)} AND NOT {_is_int(value)})"
    if kind in ("float", "float_nan"):
        no_number = f"CASE WHEN {_is_text(value)} THEN {_text(value)} NOT RLIKE {DECIMAL_TEXT} ELSE {_number(value)} IS NULL END"
        return f"(NOT {is_missing(value, kind)} AND {no_number})"
    if kind == "time":
        return f"(NOT {is_missing(value, kind)} AND {to_time(value)} IS NULL)"
    return None


def uncoercible_text(text: str) -> str:
    """True where ``text`` is present but is no number."""
    return f"({text} NOT RLIKE {DECIMAL_TEXT} AND {text} NOT IN ('true', 'false'))"


def is_finite(number: str) -> str:
    """Not true for null, NaN and the infinities."""
    return f"abs({number}) < {INFINITY}"


def finite_or_null(number: str) -> str:
    return f"CASE WHEN {is_finite(number)} THEN {number} END"
