"""Min-max scaling and weighted composites."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laureate import fixed


def _scaled(value: Column, low: Column, high: Column, places: int) -> Column:
    span = F.nullif(high - low, F.lit(0.0))
    return F.round(F.try_divide(value - low, span) * 100, places)


def minmax_scale(
    df: DataFrame,
    columns: Mapping[str, Column],
    within: Sequence[str] = (),
    places: int = 2,
) -> DataFrame:
    """Add each expression scaled to 0-100; NULL where it has no spread.

    For grouped results such as one row per year: without ``within`` the window
    is a single partition. Use ``minmax_scale_rows`` on data of any size.
    """
    window = Window.partitionBy(*within)
    return df.withColumns(
        {
            name: _scaled(
                value.cast("double"),
                F.min(value.cast("double")).over(window),
                F.max(value.cast("double")).over(window),
                places,
            )
            for name, value in columns.items()
        }
    )


def minmax_scale_rows(
    df: DataFrame, columns: Mapping[str, Column], places: int = 2
) -> DataFrame:
    """As ``minmax_scale``, over any number of rows.

    The bounds come from one aggregate, read back as a scalar subquery, so the
    rows themselves are neither shuffled nor gathered.
    """
    bounds = df.agg(
        F.struct(
            *[
                bound(value.cast("double")).alias(f"{side}_{name}")
                for name, value in columns.items()
                for side, bound in (("low", F.min), ("high", F.max))
            ]
        ).alias("bounds")
    ).scalar()
    return df.withColumns(
        {
            name: _scaled(
                value.cast("double"),
                bounds.getField(f"low_{name}"),
                bounds.getField(f"high_{name}"),
                places,
            )
            for name, value in columns.items()
        }
    )


def composite(
    weights: Mapping[str, float] = fixed.PILLAR_WEIGHTS, on_null: str = "propagate"
) -> Column:
    """Weighted sum of the (already rounded) pillars.

    A NULL pillar makes the sum NULL, counts as 0 with ``on_null="zero"``, or is
    left out and the other weights raised to fill with ``"renormalise"``.
    """
    def weighted(fill: bool) -> Column:
        terms = [
            (F.coalesce(F.col(p), F.lit(0.0)) if fill else F.col(p)) * w
            for p, w in weights.items()
        ]
        return reduce(lambda a, b: a + b, terms)

    if on_null == "propagate":
        return F.round(weighted(False), 2)
    if on_null == "zero":
        return F.round(weighted(True), 2)
    if on_null == "renormalise":
        used = reduce(
            lambda a, b: a + b,
            [F.when(F.col(p).isNotNull(), w).otherwise(0.0) for p, w in weights.items()],
        )
        return F.round(F.try_divide(weighted(True) * sum(weights.values()), used), 2)
    raise ValueError(f"unknown on_null {on_null!r}")


def quality_index(share: Column, count: Column) -> Column:
    """Share of high scores plus volume up to a cap, on a 0-100 scale."""
    volume = F.least(count, F.lit(fixed.QUALITY_VOLUME_CAP)) / float(fixed.QUALITY_VOLUME_CAP)
    return F.round(
        share * fixed.QUALITY_SHARE_WEIGHT + volume * 100 * fixed.QUALITY_VOLUME_WEIGHT, 2
    )
