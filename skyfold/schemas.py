"""Declared fields of a catalogue object.

Catalogues write numbers both as JSON numbers and as texts. Fields of a typed kind are parsed from JSON as VARIANT and coerced
afterwards according to the kind given here; all others are parsed as STRING.
"""

from __future__ import annotations

from skyfold.functions.coerce import json_type

# Field names and kinds of the catalogue format.
SOURCE_FIELDS = {
    "alias": "int",
    "name": "str",
    "url": "str",
    "bibcode": "str",
    "doi": "str",
    "arxivid": "str",
    "secondary": "bool",
    "acknowledgement": "str",
}

DATUM_FIELDS = {
    "source": "str",
    "e_value": "float",
    "e_lower_value": "float",
    "e_upper_value": "float",
    "lowerlimit": "bool",
    "upperlimit": "bool",
    "u_value": "str",
    "u_e_value": "str",
    "correlation": "json",
    "kind": "str",
    "derived": "bool",
    "description": "str",
    "probability": "float",
    "model": "str",
    "realization": "int",
    "value": "str",
}

CORRELATION_FIELDS = {
    "quantity": "str",
    "value": "str",
    "kind": "str",
    "derived": "bool",
}

OBSERVATION_FIELDS = {
    "source": "str",
    "time": "time",
    "e_time": "float_nan",
    "e_lower_time": "float_nan",
    "e_upper_time": "float_nan",
    "u_time": "str",
    "survey": "str",
    "instrument": "str",
    "telescope": "str",
    "observatory": "str",
    "observer": "str",
    "reducer": "str",
    "airmass": "float",
    "host": "bool",
    "includeshost": "bool",
    "model": "str",
    "realization": "int",
}

PHOTOMETRY_FIELDS = OBSERVATION_FIELDS | {
    "countrate": "float",
    "e_countrate": "float_nan",
    "e_lower_countrate": "float_nan",
    "e_upper_countrate": "float_nan",
    "magnitude": "float",
    "flux": "float",
    "e_flux": "float_nan",
    "e_magnitude": "float_nan",
    "e_lower_magnitude": "float_nan",
    "e_upper_magnitude": "float_nan",
    "zeropoint": "float",
    "band": "str",
    "bandset": "str",
    "system": "str",
    "upperlimit": "bool",
    "upperlimitsigma": "float",
    "kcorrected": "bool",
    "scorrected": "bool",
    "mcorrected": "bool",
}

SPECTRA_FIELDS = OBSERVATION_FIELDS | {
    "data": "json",
    "u_wavelengths": "str",
    "u_fluxes": "str",
    "u_errors": "str",
    "snr": "float",
    "filename": "str",
    "deredshifted": "bool",
    "dereddened": "bool",
    "vacuumwavelengths": "bool",
    "exclude": "json",
}

SUGGESTION_FIELDS = {"above": "float", "below": "float", "range": "json"}

STRING_QUANTITIES = (
    "alias",
    "distinctfrom",
    "error",
    "ra",
    "dec",
    "discoverdate",
    "maxdate",
    "maxband",
    "maxvisualband",
    "maxvisualdate",
    "claimedtype",
    "discoverer",
    "host",
    "hostra",
    "hostdec",
)

FLOAT_QUANTITIES = (
    "maxabsmag",
    "maxappmag",
    "maxvisualabsmag",
    "maxvisualappmag",
    "redshift",
    "lumdist",
    "comovingdist",
    "velocity",
    "ebv",
    "hostoffsetang",
    "hostoffsetdist",
)

QUANTITIES = STRING_QUANTITIES + FLOAT_QUANTITIES
REQUIRED_TEXTS = ("schema", "name")
LISTS = ("sources", *QUANTITIES, "photometry", "spectra")


def parsed_struct(fields: dict[str, str]) -> str:
    """DDL of the struct as which JSON objects with these fields, of the given kinds, are parsed."""
    return "STRUCT<" + ", ".join(f"`{name}`: {json_type(kind)}" for name, kind in fields.items()) + ">"


def parsed_list(fields: dict[str, str]) -> str:
    return f"ARRAY<{parsed_struct(fields)}>"
