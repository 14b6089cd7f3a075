"""Look up the interval that a whole number lies in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laureate.operators.dedup import keep_first
from laureate.operators.lookup import left_lookup


def covered_points(intervals: DataFrame, low: str, high: str, first: str) -> DataFrame:
    """One row per whole number in any interval, with the interval least in ``first``.

    ``low`` and ``high`` belong to the interval; one whose ends are the wrong way round or
    missing covers nothing.
    """
    points = intervals.filter(F.col(low) <= F.col(high)).withColumn(
        "_point", F.explode(F.sequence(low, high))
    )
    return keep_first(points, [F.col("_point")], [F.col(first), F.col(low), F.col(high)])


def interval_lookup(
    df: DataFrame, intervals: DataFrame, point: str, low: str, high: str, first: str,
    columns: dict[str, str], spread_by: str,
) -> DataFrame:
    """Add ``columns`` (new name to interval column) of the interval around ``point``.

    A range join becomes a join on equal numbers: intervals of years cover few. Where
    they cover many, rows of common numbers are dealt by ``spread_by``. Numbers in no
    interval, and NULL, get NULL.
    """
    found = covered_points(intervals, low, high, first).select(
        "_point", *[F.col(c).alias(name) for name, c in columns.items()]
    )
    keyed = df.withColumn("_point", F.col(point))
    return left_lookup(keyed, found, ["_point"], spread_by).drop("_point")
