"""Aggregates a dashboard draws from the reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laureate.fixed import DEFAULT_GATES, ERAS, PRIMARY_SOURCE, UNKNOWN, Gates
from laureate.functions.numbers import mean
from laureate.operators.metrics import genre_era
from laureate.operators.reuse import written_once
from laureate.operators.scale import quality_index
from laureate.operators.trend import place
from laureate.plans.items import ordered

CHAMPION_FILTERS = {
    "era": lambda: F.col("is_era_champion"),
    "genre": lambda: F.col("is_genre_era_champion"),
    "vr": lambda: F.col("is_vr_era_champion"),
    "era_top5": lambda: F.col("era_rank") <= 5,
    "vr_titles": lambda: F.col("is_vr"),
}


def champions(report: DataFrame, *kinds: str, genre: str | None = None) -> DataFrame:
    """Rows of the champions report of any of the kinds, and of one genre if it is given."""
    if kinds:
        report = report.filter(reduce(lambda a, b: a | b, [CHAMPION_FILTERS[k]() for k in kinds]))
    return report if genre is None else report.filter(F.col("genre") == genre)


def mean_gap(items: DataFrame, by: str) -> DataFrame:
    """Mean critic-user gap per group, over titles that have a user score."""
    return items.groupBy(by).agg(
        mean(F.col("nostalgia_delta")).alias("avg_nostalgia_delta"),
        F.count("nostalgia_delta").alias("compared_games"),
    )


def legends(items: DataFrame, gates: Gates = DEFAULT_GATES) -> DataFrame:
    return ordered(items.filter(F.col("critic_score") >= gates.champion_score))


def era_ranking(index: DataFrame) -> DataFrame:
    """Eras by their mean yearly index."""
    eras = index.groupBy("era_label").agg(
        mean(F.col("golden_era_index")).alias("avg_index"), F.count("*").alias("years")
    )
    return eras.withColumn("era_place", place("avg_index"))


def genres_in_every_era(games: DataFrame, gates: Gates = DEFAULT_GATES) -> DataFrame:
    """Genres with enough games in each era that has any such genre."""
    present = written_once(genre_era(games, gates), "genre-eras")
    eras = present.agg(F.count_distinct("era_label").alias("eras")).scalar()
    return (
        present.groupBy("genre")
        .agg(
            F.count("*").alias("eras_present"),
            F.sum("game_count").alias("game_count"),
        )
        .filter(F.col("eras_present") == eras)
    )


def largest_gap(items: DataFrame, k: int = 1) -> DataFrame:
    return items.orderBy(
        F.abs("nostalgia_delta").desc_nulls_last(), "game_key"
    ).limit(k)


def spotlight(games: DataFrame, genre: str) -> DataFrame:
    """How many titles a genre has, and its best one."""
    best = F.min_by(
        F.struct("game_key", "game_name", "release_year", "critic_score"),
        F.struct(
            -F.col("critic_score"),
            -F.coalesce("user_score", F.lit(0.0)),
            -F.coalesce("reviews_total", F.lit(0)),
            F.col("game_key"),
        ),
    )
    return (
        games.filter(F.col("genre") == genre)
        .groupBy("genre")
        .agg(F.count("*").alias("game_count"), best.alias("_best"))
        .select("genre", "game_count", "_best.*")
    )


def survivorship(items: DataFrame, by: str) -> DataFrame:
    return items.groupBy(by).agg(
        F.count("*").alias("game_count"),
        mean(F.col("critic_score")).alias("avg_critic_score"),
        mean(F.col("owners_midpoint"), 0).alias("avg_owners_midpoint"),
    )


def quality_matrix(games: DataFrame, gates: Gates = DEFAULT_GATES) -> DataFrame:
    """Genre by era quality, one row per cell with enough games."""
    return genre_era(games, gates).withColumn(
        "quality_index", quality_index(F.col("pct_above_80"), F.col("game_count"))
    )


def quality_matrix_wide(
    games: DataFrame, gates: Gates = DEFAULT_GATES, labels: Sequence[str] = ()
) -> DataFrame:
    """The same with a column per era; the eras are given, so no extra pass finds them.

    Gates that admit years outside all eras add a column for those. ``labels`` names the
    columns where games have other eras.
    """
    given, labels = bool(labels), list(labels) or [label for _, _, label in ERAS]
    if not given and (gates.first_year < ERAS[0][0] or gates.last_year > ERAS[-1][1]):
        labels.append(UNKNOWN)
    return (
        quality_matrix(games, gates)
        .groupBy("genre")
        .pivot("era_label", labels)
        .agg(F.first("quality_index"))
    )


def _null_pct(column: str) -> Column:
    return F.round(F.avg(F.col(column).isNull().cast("double")) * 100, 2)


def coverage_by_era(games: DataFrame) -> DataFrame:
    """Source mix and gaps in the data per era, in percent."""
    primary = (F.col("source") == PRIMARY_SOURCE).cast("double")
    return games.groupBy("era_label").agg(
        F.count("*").alias("game_count"),
        F.round(F.avg(primary) * 100, 2).alias("primary_source_pct"),
        _null_pct("genre").alias("null_genre_pct"),
        _null_pct("user_score").alias("null_user_score_pct"),
        _null_pct("avg_playtime_hrs").alias("null_playtime_pct"),
        _null_pct("owners_midpoint").alias("null_owners_pct"),
    )


def null_profile(df: DataFrame) -> DataFrame:
    """One row per column: how much of it is NULL; counted in one pass."""
    names = df.columns
    counts = df.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"_null_{i}") for i, c in enumerate(names)],
    )
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column_name"), F.col(f"_null_{i}").alias("null_rows"))
                for i, c in enumerate(names)
            ]
        )
    )
    return counts.select("_rows", cells.alias("_c")).select(
        "_c.column_name",
        "_c.null_rows",
        F.round(F.try_divide(F.col("_c.null_rows") * 100.0, F.col("_rows")), 2).alias("null_pct"),
        (F.col("_c.null_rows") == F.col("_rows")).alias("all_null"),
    )
