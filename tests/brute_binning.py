"""Plain restatement of the binning rules for one band, for comparison on small inputs."""

from __future__ import annotations

import math

import numpy as np


def binned(points, width):
    """``points`` are ``(pos, time, flux, e_flux or None, upperlimit)``; returns ``{bin_id: (flux, error, limit)}``."""
    bins = {}
    for point in sorted(points):
        bins.setdefault(int(point[1] // width), []).append(point)
    return {index: _summary(members) for index, members in bins.items()}


def _summary(members):
    limits = [p for p in members if p[4]]
    detections = [p for p in members if not p[4]]
    sample = [p for p in detections if p[3] is not None and math.isfinite(p[3])]
    if not detections:
        best = min(limits, key=lambda p: (p[2], p[0]))
        return best[2], _null_if_nan(best[3]), True
    if not sample:
        return float(np.mean([p[2] for p in detections])), None, False
    if len(sample) == 1:
        return sample[0][2], sample[0][3], False
    flux = np.array([p[2] for p in sample], dtype=np.longdouble)
    error = np.array([p[3] for p in sample], dtype=np.longdouble)
    if np.any(error == 0):
        return None, None, False
    weight = 1 / error**2
    mean = np.sum(weight * flux) / np.sum(weight)
    sigma = np.sqrt(np.sum(weight * (flux - mean) ** 2) / np.sum(weight) / (len(flux) - 1))
    typical = 1 / np.sqrt(np.sum(weight))
    return float(mean), float((sigma + typical) / 2 if typical > sigma else sigma), False


def _null_if_nan(x):
    return None if x is None or not math.isfinite(x) else x
