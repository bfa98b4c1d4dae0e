"""Time-bin expressions on a numeric (MJD) axis, in SQL."""

from __future__ import annotations


def bin_id(time: str, width: float) -> str:
    """Index of the bin ``[k * width, (k + 1) * width)`` holding ``time``.

    Going through the remainder keeps the index exact for widths such as 0.1, where ``floor(time / width)``
    is off by one for some values. Null where the time is not finite. Times whose index exceeds BIGINT (no date, and
    further apart than any bin) fall into the outermost bins.
    """
    width = f"{float(width)!r}D"
    truncated = f"try_cast(rint(({time} - {time} % {width}) / {width}) AS BIGINT)"
    outermost = (
        f"CASE WHEN {time} > 0 AND {time} < double('infinity') THEN {2**63 - 1} "
        f"WHEN {time} < 0 AND {time} > -double('infinity') THEN {1 - 2**63} END"
    )
    return f"coalesce({truncated} - CASE WHEN {time} % {width} < 0 THEN 1 ELSE 0 END, {outermost})"


def bin_centre(index: str, width: float) -> str:
    return f"double({index}) * {float(width)!r}D + {float(width) / 2!r}D"
