"""Yearly composite index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laureate.fixed import DEFAULT_GATES, INDEX_ERAS, Gates
from laureate.functions.labels import coverage_tier, era_label
from laureate.operators.metrics import min_size, with_era, year_profile
from laureate.operators.order import numbered
from laureate.operators.scale import composite, minmax_scale
from laureate.operators.trend import centred_mean, period_delta, place
from laureate.schemas import INDEX_COLUMNS


def pillars(years: DataFrame) -> DataFrame:
    """The five scaled pillars; counts are log-scaled, missing playtime is 0."""
    return minmax_scale(
        years,
        {
            "p1_quality_rate": F.col("pct_above_80"),
            "p2_avg_score": F.col("avg_critic_score"),
            "p3_genre_diversity": F.col("distinct_genres"),
            "p4_volume": F.ln(F.col("scored_games") + 1),
            "p5_longevity": F.coalesce("avg_playtime_hrs", F.lit(0.0)),
        },
    )


def gated_years(
    titles: DataFrame, gates: Gates = DEFAULT_GATES, denominator: str = "all"
) -> DataFrame:
    """The profile of every year with enough scored titles."""
    return min_size(
        year_profile(titles, gates, denominator), "scored_games", gates.min_scored_per_year
    )


def index_report(
    titles: DataFrame,
    gates: Gates = DEFAULT_GATES,
    on_null: str = "propagate",
    denominator: str = "all",
    adjacent_only: bool = False,
    eras: DataFrame | None = None,
) -> DataFrame:
    """One row per year with enough scored titles.

    Titles are reduced to one row per year first, so every window below sees at
    most as many rows as there are covered years. ``eras`` (columns as in
    ``schemas.ERA_TABLE``) takes the place of the fixed eras.
    """
    scored = pillars(gated_years(titles, gates, denominator)).withColumn(
        "golden_era_index", composite(on_null=on_null)
    )
    if eras is not None:
        scored = with_era(scored, eras, spread_by="release_year")
    return scored.withColumns(
        {
            "yoy_score_delta": period_delta(
                "avg_critic_score", places=2, adjacent_only=adjacent_only
            ),
            "yoy_volume_delta": period_delta("scored_games", adjacent_only=adjacent_only),
            "nostalgia_delta": F.round(F.col("avg_user_score") - F.col("avg_critic_score"), 2),
            "golden_era_index_3yr_avg": centred_mean("golden_era_index"),
            "era_index_rank": place("golden_era_index"),
            "era_label": (
                F.col("era_label") if eras is not None else era_label("release_year", INDEX_ERAS)
            ),
            "coverage_tier": coverage_tier("release_year"),
        }
    ).select(*INDEX_COLUMNS)


def ordered(report: DataFrame) -> DataFrame:
    return report.orderBy("release_year")


def placed(report: DataFrame) -> DataFrame:
    """With each year's place in the display order."""
    return numbered(report, [F.col("release_year")])
