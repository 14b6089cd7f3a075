"""Age, critic-user gap, longevity and reach of every title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laureate.functions import labels
from laureate.functions.numbers import score_gap
from laureate.operators.order import numbered
from laureate.plans.base import DEFAULT_OPTIONS, Inputs, Options, games
from laureate.schemas import ITEM_COLUMNS


def with_labels(rows: DataFrame) -> DataFrame:
    years, hours = labels.age("release_year"), "avg_playtime_hrs"
    gap = score_gap(F.col("critic_score"), F.col("user_score"))
    return rows.withColumns(
        {
            "nostalgia_delta": F.round(gap, 2),
            "nostalgia_label": labels.delta_label("critic_score", "user_score"),
            "game_age_years": F.expr(years),
            "age_bucket": labels.age_bucket(years),
            "age_bucket_sort": labels.age_bucket_order(years),
            "longevity_tier": labels.longevity_tier(hours),
            "longevity_tier_sort": labels.longevity_order(hours),
            "ownership_tier": labels.ownership_tier("owners_midpoint"),
        }
    )


def items_report(inputs: Inputs, options: Options = DEFAULT_OPTIONS) -> DataFrame:
    """One row per qualifying title."""
    return with_labels(games(inputs, options)).select(*ITEM_COLUMNS)


def display_order() -> list[Column]:
    """The key lets Spark split runs of equal scores."""
    return [
        F.desc("critic_score"), F.coalesce("user_score", F.lit(0.0)).desc(), F.col("game_key")
    ]


def ordered(report: DataFrame) -> DataFrame:
    return report.orderBy(*display_order())


def placed(report: DataFrame) -> DataFrame:
    """With each row's place in the display order, which no later step can lose."""
    return numbered(report, display_order())
