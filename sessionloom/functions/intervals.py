"""Confidence intervals for proportions as closed-form column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionloom.config import Z_95

SIDES = {"lower": -1.0, "upper": 1.0}


def _side(side: str) -> float:
    if side not in SIDES:
        raise ValueError(f"side must be 'lower' or 'upper'; got {side!r}")
    return SIDES[side]


def rate(k: Column, n: Column) -> Column:
    """k / n, NULL where n is NULL or 0."""
    return F.try_divide(k, n)


def wilson(k: Column, n: Column, side: str = "lower", z: float = Z_95) -> Column:
    """One bound of the Wilson score interval for k successes in n trials; NULL where n is 0."""
    sign = _side(side)
    trials = F.nullif(n.cast("double"), F.lit(0.0))
    share = k / trials
    spread = F.sqrt(share * (1 - share) / trials + z * z / (4 * trials * trials))
    return (share + z * z / (2 * trials) + sign * z * spread) / (1 + z * z / trials)


def newcombe(
    k1: Column, n1: Column, k2: Column, n2: Column, side: str = "lower", z: float = Z_95
) -> Column:
    """One bound of Newcombe's hybrid score interval for k1/n1 - k2/n2.

    The distance to the bound combines the first group's Wilson bound on the same side with the
    second group's on the opposite side.
    """
    sign = _side(side)
    other = "upper" if side == "lower" else "lower"
    p1, p2 = rate(k1, n1), rate(k2, n2)
    own = p1 - wilson(k1, n1, side, z)
    against = wilson(k2, n2, other, z) - p2
    return p1 - p2 + sign * F.sqrt(own * own + against * against)
