"""Tail probabilities without SciPy."""

from __future__ import annotations

import math


def chi2_sf(x: float, dof: int) -> float:
    """Upper tail of the chi-squared distribution, by the recurrence from 1 or 2 degrees of freedom."""
    if x <= 0 or dof < 1:
        return 1.0
    half = x / 2
    if dof % 2:
        total, k = math.erfc(math.sqrt(half)), 1
    else:
        total, k = math.exp(-half), 2
    while k < dof:
        total += math.exp(k / 2 * math.log(half) - half - math.lgamma(k / 2 + 1))
        k += 2
    return min(1.0, total)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))
