"""Champions per era, per genre and era, and among flagged titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laureate.fixed import DEFAULT_GATES, Gates
from laureate.functions.numbers import score_gap
from laureate.operators.keys import is_unique
from laureate.operators.metrics import era_stats
from laureate.operators.order import numbered
from laureate.operators.rank import Contest, dense_ranks, dense_ranks_by_key, is_first
from laureate.operators.reuse import written_once
from laureate.plans.base import DEFAULT_OPTIONS, Inputs, Options, games
from laureate.schemas import CHAMPION_COLUMNS


def with_rank_keys(df: DataFrame) -> DataFrame:
    """Sort keys with missing values as 0."""
    return df.withColumns(
        {
            "_user": F.coalesce("user_score", F.lit(0.0)),
            "_reviews": F.coalesce("reviews_total", F.lit(0)),
        }
    )


BY_SCORE = ("critic_score", "_user", "_reviews")


def era_contest() -> Contest:
    return Contest("era_rank", ("era_label",), BY_SCORE)


def genre_contest(gates: Gates = DEFAULT_GATES, genre: str = "genre") -> Contest:
    return Contest(
        "genre_era_rank",
        ("era_label", genre),
        BY_SCORE,
        takes_part=(F.col("critic_score") >= gates.champion_score) & F.col(genre).isNotNull(),
        min_size=gates.min_per_genre_era,
        size="genre_era_count",
    )


def flagged_contest(gates: Gates = DEFAULT_GATES) -> Contest:
    return Contest(
        "vr_era_rank",
        ("era_label",),
        ("critic_score", "_user"),
        takes_part=(F.col("critic_score") >= gates.champion_score) & F.col("is_vr"),
    )


def champions_report(
    inputs: Inputs, options: Options = DEFAULT_OPTIONS, keys: str = "audit"
) -> DataFrame:
    """One row per qualifying title, with its ranks and its era's figures.

    Titles without a genre are ranked in their era, but its figures leave them out.
    The definition joins ranks back by ``game_key``. ``keys="audit"`` checks whether titles
    share one and only then makes that join, by which each of them meets the ranks of all;
    ``"unique"`` and ``"repeated"`` say so without the check.
    """
    if keys not in ("audit", "unique", "repeated"):
        raise ValueError(f"keys must be 'audit', 'unique' or 'repeated', not {keys!r}")
    contests = (era_contest(), genre_contest(options.gates), flagged_contest(options.gates))
    base = with_rank_keys(written_once(games(inputs, options), "champion-games"))
    if keys == "unique" or keys == "audit" and is_unique(base, ["game_key"]):
        ranked = dense_ranks(base, contests, spread_by="game_key")
    else:
        ranked = dense_ranks_by_key(base, contests, "game_key", spread_by="game_name")
    eras = era_stats(base).drop("era_sort_order")
    # One row per era label, of which there are ten; a table of eras may have any number.
    return (
        ranked.join(F.broadcast(eras) if inputs.eras is None else eras, "era_label", "left")
        .withColumns(
            {
                "nostalgia_delta": F.round(
                    score_gap(F.col("critic_score"), F.col("user_score"), "zero"), 2
                ),
                "is_era_champion": is_first("era_rank"),
                "is_genre_era_champion": is_first("genre_era_rank"),
                "is_vr_era_champion": is_first("vr_era_rank"),
            }
        )
        .select(*CHAMPION_COLUMNS)
    )


def display_order() -> list[Column]:
    """The key lets Spark split runs of equal scores."""
    return [
        F.col("era_sort_order"),
        F.desc("critic_score"),
        F.coalesce("user_score", F.lit(0.0)).desc(),
        F.col("game_key"),
    ]


def ordered(report: DataFrame) -> DataFrame:
    return report.orderBy(*display_order())


def placed(report: DataFrame) -> DataFrame:
    """With each row's place in the display order, which no later step can lose."""
    return numbered(report, display_order())
