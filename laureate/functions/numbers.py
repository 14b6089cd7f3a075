"""Rounded aggregates and score gaps.

Literals are Python floats, so Spark computes in double throughout; SQL decimal
literals would round twice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Places kept of each value that a mean adds up.
MEAN_SCALE = 6


def mean(value: Column, places: int = 2) -> Column:
    """The mean, rounded half away from zero, as a double.

    Values are added up as decimals of ``MEAN_SCALE`` places, and the sum is divided
    and rounded in whole numbers. So the mean, halfway ones too, does not depend on
    the order or the partitions in which the values arrive, as a sum of doubles does.
    """
    unit, kept = 10**MEAN_SCALE, 10**places
    whole = "decimal(38,0)"
    total = (F.sum(value.cast(f"decimal(24,{MEAN_SCALE})")) * F.lit(unit)).cast(whole)
    count = F.nullif(F.count(value), F.lit(0)).cast(whole)
    twice = (F.abs(total) * F.lit(2 * kept)).cast(whole) + (count * F.lit(unit)).cast(whole)
    rounded = F.call_function(
        "div", twice.cast(whole), (count * F.lit(2 * unit)).cast(whole)
    )
    return F.signum(total) * rounded.cast("double") / F.lit(float(kept))


def pct_at_least(
    score: Column, threshold: float, places: int = 2, denominator: str = "all"
) -> Column:
    """Percentage of rows scoring at least ``threshold``.

    An unscored row counts as below the threshold; with ``denominator="scored"``
    it does not count at all.
    """
    hit = F.when(score >= threshold, 1.0)
    if denominator == "all":
        hit = hit.otherwise(0.0)
    elif denominator == "scored":
        hit = hit.when(score.isNotNull(), 0.0)
    else:
        raise ValueError(f"denominator must be 'all' or 'scored', not {denominator!r}")
    return F.round(F.avg(hit) * 100, places)


def score_gap(critic: Column, user: Column, missing: str = "null") -> Column:
    """User score minus critic score, unrounded.

    ``missing="zero"`` takes an absent user score as 0, ``"null"`` gives NULL.
    """
    if missing == "zero":
        return F.coalesce(user, F.lit(0)) - critic
    if missing == "null":
        return user - critic
    raise ValueError(f"missing must be 'zero' or 'null', not {missing!r}")
