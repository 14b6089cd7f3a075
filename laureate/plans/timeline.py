"""Genre by year: quality, peaks and best titles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laureate.operators.metrics import genre_year
from laureate.operators.order import numbered
from laureate.operators.rank import top_k, top_k_label, with_peak
from laureate.operators.reuse import written_once
from laureate.operators.scale import quality_index
from laureate.operators.trend import period_delta
from laureate.plans.base import DEFAULT_OPTIONS, Inputs, Options, games
from laureate.schemas import TIMELINE_COLUMNS

PEAK_VALUES = {
    "peak_year": "release_year",
    "peak_index": "genre_quality_index",
    "peak_avg_score": "avg_critic_score",
}


def by_merit() -> list[Column]:
    """Critic score, then user score with missing as 0; name and key settle ties."""
    return [
        F.desc("critic_score"),
        F.coalesce("user_score", F.lit(0.0)).desc(),
        F.col("game_name"),
        F.col("game_key"),
    ]


def scored_name() -> Column:
    return F.concat("game_name", F.lit(" ("), F.col("critic_score").cast("string"), F.lit(")"))


def indexed(years: DataFrame) -> DataFrame:
    return years.withColumn(
        "genre_quality_index", quality_index(F.col("pct_above_80"), F.col("game_count"))
    )


def top_titles(rows: DataFrame, genre: str = "genre", k: int = 3) -> DataFrame:
    within = [genre, "release_year"]
    best = top_k(rows.filter(F.col(genre).isNotNull()), within, by_merit(), k)
    return top_k_label(best, within, scored_name(), f"top{k}_games")


def timeline_report(
    inputs: Inputs,
    options: Options = DEFAULT_OPTIONS,
    excluded_genres: Sequence[str] = (),
    adjacent_only: bool = False,
) -> DataFrame:
    """One row per genre and year with enough titles."""
    rows = games(inputs, options, drop_unknown=True).filter(F.col("genre").isNotNull())
    if excluded_genres:
        rows = rows.filter(~F.col("genre").isin(*excluded_genres))
    rows = written_once(
        rows.select(
            "game_key", "game_name", "genre", "release_year", "critic_score", "user_score",
            "avg_playtime_hrs", "owners_midpoint",
        ),
        "timeline-games",
    )
    years = indexed(genre_year(rows, gates=options.gates, eras=inputs.eras)).withColumns(
        {
            "yoy_score_delta": period_delta(
                "avg_critic_score", within=["genre"], places=2, adjacent_only=adjacent_only
            ),
            "yoy_volume_delta": period_delta(
                "game_count", within=["genre"], adjacent_only=adjacent_only
            ),
        }
    )
    peaked = with_peak(years, "genre", "genre_quality_index", "release_year", PEAK_VALUES)
    return (
        peaked.withColumn("is_peak_year", F.col("release_year") == F.col("peak_year"))
        .join(top_titles(rows), ["genre", "release_year"], "left")
        .select(*TIMELINE_COLUMNS)
    )


def ordered(report: DataFrame) -> DataFrame:
    return report.orderBy("genre", "release_year")


def placed(report: DataFrame) -> DataFrame:
    """With each row's place in the display order."""
    return numbered(report, [F.col("genre"), F.col("release_year")])
