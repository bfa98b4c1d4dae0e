"""From file text to catalogue objects: envelope, coercion checks and rejects.

Deviations forced by Spark's JSON reader: a required text that is JSON null counts as missing; the value of a float quantity is
read as text, so "true" and "false" are numbers there. Of repeated keys the last one counts. Integers of any size are accepted
(unquoted ones up to the range of a double).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from skyfold import schemas
from skyfold.functions.coerce import is_missing, uncoercible, uncoercible_text
from skyfold.functions.sqltext import identifier, literals

REJECTED_SCHEMA = "schema"
REJECTED_INVALID = "invalid"

LONG_LISTS = ("sources", "photometry", "spectra")

# A map from JSON holds repeated keys; the entry whose distance from the end is its key's first from there stays.
LAST_KEYS = """CASE WHEN size(array_distinct(map_keys(all_fields))) = size(all_fields) THEN all_fields
    ELSE map_from_entries(filter(map_entries(all_fields), (entry, i) ->
        array_position(reverse(map_keys(all_fields)), entry.key) = size(all_fields) - i)) END"""


def structure_objects(texts: DataFrame) -> DataFrame:
    """Structure ``(file_stem, value)`` rows, one JSON document each.

    Adds ``name``, ``schema`` and ``has_photometry`` from the object below the key equal to the file stem, and the
    text of its lists: ``sources``, ``photometry``, ``spectra`` and a map of the ``quantities``, so that unnesting one
    reads no other. A malformed document keeps its row with a ``reason`` and a ``detail`` and has no lists. Narrow: no
    shuffle.
    """
    kept = [identifier(column) for column in texts.columns if column != "value"]
    unwrapped = texts.selectExpr(
        *kept,
        # Spark's reader stops at the end of the root object; as the only item of a list it must be all there is.
        """from_json(concat('[', value, ']'), 'ARRAY<MAP<STRING, STRING>>', map('allowSingleQuotes', 'false')) AS roots""",
    ).selectExpr(*kept, "CASE WHEN size(roots) = 1 THEN roots[0] END AS envelope").selectExpr(
        *kept,
        "envelope IS NOT NULL AS is_object",
        "try_element_at(filter(map_entries(envelope), entry -> entry.key = file_stem), -1).value AS payload",
    )
    parsed = unwrapped.selectExpr("*", "from_json(payload, 'MAP<STRING, STRING>') AS all_fields").selectExpr(
        "*", f"{LAST_KEYS} AS fields"
    )
    checked = parsed.selectExpr("*", f"{_first_problem()} AS detail")
    # Emitting the outcome through a generator keeps later filters on it from being pushed down, where the
    # parsed document would be spelled out, and parsed, once per reference.
    return checked.selectExpr(
        *kept,
        f"""inline(array(named_struct(
            'name', {_field("name")},
            'schema', {_field("schema")},
            'has_photometry', {_field("photometry")} IS NOT NULL,
            {", ".join(f"'{name}', CASE WHEN detail IS NULL THEN {_field(name)} END" for name in LONG_LISTS)},
            'quantities', CASE WHEN detail IS NULL THEN
                map_filter(fields, (name, text) -> name IN ({literals(schemas.QUANTITIES)})) END,
            'reason', CASE WHEN is_object AND payload IS NULL THEN '{REJECTED_SCHEMA}'
                           WHEN NOT is_object OR detail IS NOT NULL THEN '{REJECTED_INVALID}' END,
            'detail', CASE WHEN NOT is_object THEN 'not a JSON object'
                           WHEN payload IS NULL THEN 'no entry named like the file' ELSE detail END)))""",
    )


def candidates(objects: DataFrame) -> DataFrame:
    """The well-formed objects."""
    return objects.where("reason IS NULL").drop("reason", "detail")


def rejects(objects: DataFrame) -> DataFrame:
    """The skipped files: ``schema`` (no entry for the file) or ``invalid`` (malformed content)."""
    return objects.where("reason IS NOT NULL").drop("name", "schema", "has_photometry", "quantities", *LONG_LISTS)


def _field(name: str) -> str:
    return f"try_element_at(fields, '{name}')"


def _first_problem() -> str:
    """Description of the first violated rule, null for a well-formed object."""
    problems = ["CASE WHEN fields IS NULL THEN 'not an object' END"]
    problems += [
        f"CASE WHEN {_field(name)} IS NULL THEN '{name}: missing' END"
        for name in (*schemas.REQUIRED_TEXTS, "sources")
    ]
    # A list that is present must be a list; only photometry may be null.
    never_null = literals(name for name in schemas.LISTS if name != "photometry")
    problems.append(_first_key(f"text IS NULL AND name IN ({never_null})", "null"))
    for name, declared, required in (
        ("sources", schemas.SOURCE_FIELDS, "alias"),
        ("photometry", schemas.PHOTOMETRY_FIELDS, "source"),
        ("spectra", schemas.SPECTRA_FIELDS, "source"),
    ):
        malformed = _malformed_list(_field(name), declared, _malformed_item(declared, required))
        problems.append(f"CASE WHEN {_field(name)} IS NOT NULL AND {malformed} THEN '{name}: malformed' END")
    malformed = _malformed_list("text", schemas.DATUM_FIELDS, _malformed_datum())
    quantity = f"name IN ({literals(schemas.QUANTITIES)})"
    problems.append(_first_key(f"text IS NOT NULL AND {quantity} AND {malformed}", "malformed"))
    return f"coalesce({', '.join(problems)})"


def _first_key(condition: str, problem: str) -> str:
    return f"concat(get(map_keys(map_filter(fields, (name, text) -> {condition})), 0), ': {problem}')"


def _malformed_list(text: str, declared: dict[str, str], malformed_item: str) -> str:
    """True for text that is no list of objects or has a malformed item; the text is parsed once."""
    items = f"from_json({text}, '{schemas.parsed_list(declared)}')"
    return f"coalesce(exists({items}, item -> coalesce({malformed_item}, false)), true)"


def _malformed_item(declared: dict[str, str], required: str) -> str:
    checks = [uncoercible(f"item.{identifier(name)}", kind) for name, kind in declared.items()]
    return " OR ".join([is_missing(f"item.{required}", declared[required]), *[check for check in checks if check is not None]])


def _malformed_datum() -> str:
    correlation = f"from_json(item.correlation, '{schemas.parsed_struct(schemas.CORRELATION_FIELDS)}')"
    return (
        f"{_malformed_item(schemas.DATUM_FIELDS, 'source')} "
        f"OR (name IN ({literals(schemas.FLOAT_QUANTITIES)}) AND {uncoercible_text('item.value')}) "
        f"OR (item.correlation IS NOT NULL AND (NOT startswith(item.correlation, '{{') "
        f"OR {correlation}.quantity IS NULL OR {correlation}.value IS NULL))"
    )
