"""Changes, smoothing and ranks along a period column.

These windows run over grouped results (a row per period, or per group and
period); without ``within`` all rows go to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def period_delta(
    value: str,
    period: str = "release_year",
    within: Sequence[str] = (),
    places: int | None = None,
    adjacent_only: bool = False,
) -> Column:
    """Change against the previous row that is still there.

    Gates may have removed periods in between; ``adjacent_only`` gives NULL there.
    """
    window = Window.partitionBy(*within).orderBy(period)
    change = F.col(value) - F.lag(value).over(window)
    if places is not None:
        change = F.round(change, places)
    if adjacent_only:
        change = F.when(F.col(period) - F.lag(period).over(window) == 1, change)
    return change


def centred_mean(
    value: str,
    period: str = "release_year",
    within: Sequence[str] = (),
    reach: int = 1,
    places: int = 2,
) -> Column:
    """Mean of the row and its neighbours; rows at the ends have fewer."""
    window = Window.partitionBy(*within).orderBy(period).rowsBetween(-reach, reach)
    return F.round(F.avg(value).over(window), places)


def place(value: str, within: Sequence[str] = ()) -> Column:
    """Rank by descending value; equal values share a rank and none is skipped."""
    window = Window.partitionBy(*within).orderBy(F.desc(value))
    return F.dense_rank().over(window).cast("bigint")
