"""Unnest the lists of catalogue objects into long tables.

Every function reads and parses only its own list, is narrow (no shuffle) and keeps the identifying
columns ``by`` of the candidates. Positions are those of the input lists.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

from skyfold import schemas
from skyfold.functions.coerce import INTEGER_TEXT, coerce, text_to_float, to_float
from skyfold.functions.sqltext import identifier, literals

OBJECT = ("file_stem", "name")

# What light curves need of a photometric observation.
LIGHT_CURVE_FIELDS = ("time", "e_time", "magnitude", "flux", "e_flux", "zeropoint", "band", "upperlimit")


def sources(candidates: DataFrame, by: Sequence[str] = OBJECT) -> DataFrame:
    """One row per source. ``alias`` has at most 38 digits and is null beyond; ``alias_digits`` holds integers of any size."""
    parsed = f"from_json(sources, '{schemas.parsed_list(schemas.SOURCE_FIELDS)}')"
    texts = "from_json(sources, 'ARRAY<STRUCT<alias: STRING>>')"
    digits = f"CASE WHEN text.alias RLIKE {INTEGER_TEXT} THEN regexp_replace(trim(text.alias), '^[+]', '') ELSE string(alias) END"
    return (
        candidates.selectExpr(*by, f"{parsed} AS item", f"{texts} AS text")
        .selectExpr(*by, "posexplode(arrays_zip(item, text)) AS (pos, zipped)")
        .selectExpr(*by, "pos", "zipped.item", "zipped.text")
        .selectExpr(*by, "pos", "text", *_typed(schemas.SOURCE_FIELDS, {"name": "source_name"}))
        .selectExpr("* EXCEPT (text)", f"{digits} AS alias_digits")
    )


def quantities(candidates: DataFrame, by: Sequence[str] = OBJECT) -> DataFrame:
    """One row per datum of the quantity lists; float-valued quantities also fill ``value_num``."""
    items = (
        candidates.selectExpr(*by, "explode(quantities) AS (quantity, text)")
        .selectExpr(
            *by,
            "quantity",
            f"posexplode(from_json(text, '{schemas.parsed_list(schemas.DATUM_FIELDS)}')) AS (pos, item)",
        )
    )
    plain = {name: kind for name, kind in schemas.DATUM_FIELDS.items() if name not in ("value", "correlation")}
    floats = literals(schemas.FLOAT_QUANTITIES)
    return items.selectExpr(
        *by,
        "quantity",
        "pos",
        "item.value AS value_str",
        f"CASE WHEN quantity IN ({floats}) THEN {text_to_float('item.value')} END AS value_num",
        *_typed(plain),
        f"from_json(item.correlation, '{schemas.parsed_struct(schemas.CORRELATION_FIELDS)}') AS correlation",
    ).selectExpr(
        *by,
        "quantity",
        "pos",
        "value_str",
        "value_num",
        *plain,
        # The value of a correlation stays text, with a numeric reading beside it.
        f"""CASE WHEN correlation IS NOT NULL THEN named_struct(
            'quantity', correlation.quantity,
            'value', correlation.value,
            'value_num', {text_to_float("correlation.value")},
            'kind', correlation.kind,
            'derived', {coerce("correlation.derived", "bool")}) END AS correlation""",
    )


def observations(
    candidates: DataFrame,
    fields: Iterable[str] = tuple(schemas.PHOTOMETRY_FIELDS),
    by: Sequence[str] = OBJECT,
) -> DataFrame:
    """One row per photometric observation; only the given ``fields`` are parsed."""
    declared = {name: schemas.PHOTOMETRY_FIELDS[name] for name in fields}
    items = _items(candidates, by, "photometry", declared)
    typed = _typed(declared, {"band": "band_raw"}, {"upperlimit": "false"})
    return items.selectExpr(*by, "pos", *typed)


def spectra(candidates: DataFrame, by: Sequence[str] = OBJECT) -> DataFrame:
    """One row per spectrum with its data matrix as nested arrays of text."""
    items = _items(candidates, by, "spectra", schemas.SPECTRA_FIELDS)
    plain = {name: kind for name, kind in schemas.SPECTRA_FIELDS.items() if kind != "json"}
    suggestion = f"from_json(item.exclude, '{schemas.parsed_struct(schemas.SUGGESTION_FIELDS)}')"
    return items.selectExpr(
        *by,
        "pos",
        *_typed(plain),
        "from_json(item.data, 'ARRAY<ARRAY<STRING>>') AS data",
        f"""CASE WHEN item.exclude IS NOT NULL THEN named_struct(
            'above', {to_float(f"{suggestion}.above")},
            'below', {to_float(f"{suggestion}.below")},
            'range', from_json({suggestion}.range, 'ARRAY<STRING>')) END AS exclude""",
    )


def spectrum_points(spectra: DataFrame, by: Sequence[str] = OBJECT) -> DataFrame:
    """The data matrices in numeric long form, one row per matrix row."""
    columns = [
        f"{text_to_float(f'get(cells, {i})')} AS {name}" for i, name in enumerate(("wavelength", "flux", "e_flux"))
    ]
    return spectra.selectExpr(*by, "pos", "posexplode(data) AS (point_pos, cells)").selectExpr(
        *by, "pos", "point_pos", *columns
    )


def _items(candidates: DataFrame, by: Sequence[str], name: str, fields: Iterable[str]) -> DataFrame:
    parsed = f"from_json({name}, '{schemas.parsed_list(fields)}')"
    return candidates.selectExpr(*by, f"posexplode({parsed}) AS (pos, item)")


def _typed(
    fields: dict[str, str], renamed: dict[str, str] | None = None, defaults: dict[str, str] | None = None
) -> list[str]:
    def value(name: str, kind: str) -> str:
        typed = coerce(f"item.{identifier(name)}", kind)
        return f"coalesce({typed}, {defaults[name]})" if name in (defaults or {}) else typed

    return [
        f"{value(name, kind)} AS {identifier((renamed or {}).get(name, name))}" for name, kind in fields.items()
    ]
