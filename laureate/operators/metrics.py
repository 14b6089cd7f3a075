"""Grouped figures: per year, per era and per category and year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laureate.fixed import DEFAULT_GATES, NO_ERA, Gates
from laureate.functions.labels import era_label, era_order
from laureate.functions.numbers import mean, pct_at_least, score_gap
from laureate.operators.intervals import interval_lookup
from laureate.operators.lookup import left_lookup


def min_size(df: DataFrame, size: str, at_least: int) -> DataFrame:
    """Drop groups that are too small; later windows do not see them."""
    return df.filter(F.col(size) >= at_least)


def group_sizes(df: DataFrame, within: Sequence[str], name: str) -> DataFrame:
    """The size of every group; rows with a NULL in a group column form groups as well."""
    return df.groupBy(*within).agg(F.count("*").alias(name))


def with_group_size(
    df: DataFrame, within: Sequence[str], name: str, spread_by: str, null_safe: bool = False
) -> DataFrame:
    """Add the size of each row's group.

    As by a join, the size is NULL where a group column is NULL. ``null_safe`` takes
    NULLs as equal instead, as GROUP BY and windows do.
    """
    if not null_safe:
        sizes = group_sizes(df, within, name).withColumn("_rows", F.col(name))
        return left_lookup(df, sizes, within, spread_by, weight="_rows")
    # A key that is never NULL: the column as JSON, without a value where it is NULL.
    safe = {f"_key_{c}": F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in within}
    sizes = group_sizes(df.withColumns(safe), list(safe), name).withColumn("_rows", F.col(name))
    found = left_lookup(df.withColumns(safe), sizes, list(safe), spread_by, weight="_rows")
    return found.drop(*safe)


def year_profile(
    titles: DataFrame, gates: Gates = DEFAULT_GATES, denominator: str = "all"
) -> DataFrame:
    """Volume, scores, diversity and engagement of every covered year."""
    score = F.col("critic_score")
    return (
        titles.filter(F.col("release_year").between(gates.first_year, gates.last_year))
        .groupBy("release_year")
        .agg(
            F.count("*").alias("total_games"),
            F.count(score).alias("scored_games"),
            mean(score).alias("avg_critic_score"),
            pct_at_least(score, 90, 2, denominator).alias("pct_above_90"),
            pct_at_least(score, 80, 2, denominator).alias("pct_above_80"),
            pct_at_least(score, 70, 2, denominator).alias("pct_above_70"),
            F.max(score).alias("peak_score"),
            F.count_distinct("primary_genre").alias("distinct_genres"),
            mean(F.col("avg_playtime_hrs")).alias("avg_playtime_hrs"),
            F.count("avg_playtime_hrs").alias("games_with_playtime"),
            mean(F.col("user_score")).alias("avg_user_score"),
            F.count("user_score").alias("games_with_user_score"),
            mean(F.col("review_ratio_pct")).alias("avg_review_ratio"),
            mean(F.col("owners_midpoint"), 0).alias("avg_owners_midpoint"),
        )
    )


def distinct_genres(titles: DataFrame) -> DataFrame:
    return titles.groupBy("release_year").agg(
        F.count_distinct("primary_genre").alias("distinct_genres")
    )


def era_stats(games: DataFrame) -> DataFrame:
    """Figures of each era over its categorised games."""
    return (
        games.filter(F.col("genre").isNotNull())
        .groupBy("era_label", "era_sort_order")
        .agg(
            F.count("*").alias("era_qualified_games"),
            mean(F.col("critic_score"), 1).alias("era_avg_score"),
            F.max("critic_score").alias("era_peak_score"),
            F.count_distinct("genre").alias("era_distinct_genres"),
            F.min("release_year").alias("era_start_year"),
            F.max("release_year").alias("era_end_year"),
            F.count_if("is_vr").alias("era_vr_games"),
        )
    )


def genre_year(
    games: DataFrame, genre: str = "genre", gates: Gates = DEFAULT_GATES,
    eras: DataFrame | None = None,
) -> DataFrame:
    """Figures of each category and year with enough games."""
    score, user = F.col("critic_score"), F.col("user_score")
    grouped = (
        games.filter(F.col(genre).isNotNull())
        .groupBy(genre, "release_year")
        .agg(
            F.count("*").alias("game_count"),
            mean(score).alias("avg_critic_score"),
            mean(user).alias("avg_user_score"),
            F.max(score).alias("peak_score"),
            pct_at_least(score, 90, 1).alias("pct_above_90"),
            pct_at_least(score, 80, 1).alias("pct_above_80"),
            mean(F.col("avg_playtime_hrs")).alias("avg_playtime_hrs"),
            mean(F.col("owners_midpoint"), 0).alias("avg_owners_midpoint"),
            mean(score_gap(score, user, "zero")).alias("avg_nostalgia_delta"),
        )
    )
    kept = min_size(grouped, "game_count", gates.min_per_genre_year)
    return with_era(kept, eras, spread_by=genre).drop("era_sort_order")


def genre_era(games: DataFrame, gates: Gates = DEFAULT_GATES) -> DataFrame:
    """Category by era: game count, mean score and share of high scores."""
    score = F.col("critic_score")
    grouped = (
        games.filter(F.col("genre").isNotNull())
        .groupBy("genre", "era_label", "era_sort_order")
        .agg(
            F.count("*").alias("game_count"),
            mean(score).alias("avg_critic_score"),
            pct_at_least(score, 80, 1).alias("pct_above_80"),
        )
    )
    return min_size(grouped, "game_count", gates.min_per_genre_era)


def with_era(
    df: DataFrame, eras: DataFrame | None = None, spread_by: str = "game_key"
) -> DataFrame:
    """Add the era's label and place, from the fixed eras or from a table of them.

    The table has the columns of ``schemas.ERA_TABLE``. Of overlapping eras the first in
    order holds; a year in none is in the unknown era, whose place is one past the last.
    """
    if eras is not None:
        found = interval_lookup(
            df, eras, "release_year", "first_year", "last_year", "era_sort_order",
            {"era_label": "era_label", "era_sort_order": "era_sort_order"}, spread_by,
        )
        past = eras.agg((F.max("era_sort_order") + 1).alias("past")).scalar()
        return found.withColumns(
            {
                "era_label": F.coalesce("era_label", F.lit(NO_ERA)),
                "era_sort_order": F.coalesce("era_sort_order", past, F.lit(1)),
            }
        )
    return df.withColumns(
        {"era_label": era_label("release_year"), "era_sort_order": era_order("release_year")}
    )
