"""Flux, magnitude and band-name expressions in SQL."""

from __future__ import annotations

from skyfold.dims import BANDS
from skyfold.functions.sqltext import literals


def zeropoint_or_default(zeropoint: str) -> str:
    return f"coalesce({zeropoint}, 1D)"


def flux_from_magnitude(magnitude: str, zeropoint: str) -> str:
    return f"{zeropoint} * pow(10D, {magnitude} * -0.4D)"


def magnitude_from_flux(flux: str, zeropoint: str) -> str:
    """Null where the flux has no logarithm."""
    return f"log10(try_divide({flux}, {zeropoint})) * -2.5D"


def normalise_band(band: str) -> str:
    return f"replace({band}, '\\'', '_pr')"


def is_supported_band(band: str) -> str:
    return f"{band} IN ({literals(BANDS)})"
