"""One runnable query per operator, over order tables seen as a catalogue."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laureate import fixed
from laureate.functions import labels
from laureate.functions.text import name_key
from laureate.operators import dedup, enrich, keys, metrics, rank, scale, trend
from laureate.operators.reuse import work_folder, written_once
from laureate.plans import base, champions, index_report, items, timeline, views
from laureate.sources import merge, raw_csv, tables, trade

#: A key that two titles share.
SHARED_KEY = "o_orderkey div 2"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.gate(trade.titles(spark, sf_dir))


def _games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.games(trade.inputs(spark, sf_dir))


def _games_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For queries that read the games more than once."""
    return written_once(_games(spark, sf_dir), "games")


def _genre_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.indexed(metrics.genre_year(_games(spark, sf_dir)))


def _years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.year_profile(trade.titles(spark, sf_dir))


def _gated_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_report.gated_years(trade.titles(spark, sf_dir))


def _indexed_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_report.pillars(_gated_years(spark, sf_dir)).withColumn(
        "golden_era_index", scale.composite()
    )


# Aggregation


@query
def q_agg_year_profile(spark, sf_dir):
    return _years(spark, sf_dir)


@query
def q_agg_distinct(spark, sf_dir):
    return metrics.distinct_genres(trade.titles(spark, sf_dir))


@query
def q_agg_era_stats(spark, sf_dir):
    return metrics.era_stats(_games(spark, sf_dir))


@query
def q_agg_genre_year(spark, sf_dir):
    return metrics.genre_year(_gated(spark, sf_dir), genre="genres_raw")


@query
def q_agg_null_groups(spark, sf_dir):
    """Group sizes as windows count them, NULL groups included, and as a join keeps them."""
    within = ["era_label", "genre"]
    rows = _games_once(spark, sf_dir).filter(
        F.col("critic_score") >= fixed.DEFAULT_GATES.champion_score
    ).select("game_key", *within)
    counted = metrics.with_group_size(rows, within, "group_rows", "game_key", null_safe=True)
    return metrics.with_group_size(counted, within, "joined_rows", "game_key")


# Sources


@query
def q_ingest_csv(spark, sf_dir):
    """Raw lines written and read back: accepted records, and refused ones as they were."""
    path = f"{work_folder(spark)}/raw-{uuid4().hex}"
    trade.write_lines(trade.raw_lines(spark, sf_dir), path)
    found = raw_csv.ingest_csv(spark, path, trade.RAW)
    good = F.col(raw_csv.CORRUPT).isNull()
    return found.select(
        good.alias("accepted"),
        *[F.when(good, F.col(c)).alias(c) for c in trade.RAW.names],
        F.col(raw_csv.CORRUPT).alias("refused"),
    )


@query
def q_merge_sources(spark, sf_dir):
    return merge.merge_sources(*trade.sources(spark, sf_dir)).select(
        "game_key", "source", "name_raw", "release_year", "critic_score"
    )


def _table_name(label: str) -> str:
    return f"{label}_{uuid4().hex}"


@query
def q_replace_reload(spark, sf_dir):
    """A catalog table replaced twice, the second time from itself, and read by name."""
    name, folder = _table_name("titles"), work_folder(spark)
    rows = trade.titles(spark, sf_dir)
    tables.swap_table(rows.filter("source = 'metacritic'"), name, folder)
    tables.swap_table(rows.filter("source = 'steam'"), name, folder)
    kept = enrich.gate(tables.load_staging(spark, name))
    tables.swap_table(kept.union(rows.filter("source = 'metacritic'")), name, folder)
    return tables.load_staging(spark, name).select(
        "game_key", "source", "critic_score", "release_year", "price_usd"
    )


@query
def q_reload_inputs(spark, sf_dir):
    """Titles resolved from inputs that were stored as tables and loaded by name."""
    stored, folder = {}, work_folder(spark)
    for label, df in trade.inputs(spark, sf_dir)._asdict().items():
        if df is not None:
            stored[label] = _table_name(label)
            tables.swap_table(df, stored[label], folder)
    inputs = base.Inputs(
        tables.load_staging(spark, stored["titles"]),
        tables.load_seed(spark, stored["seed"]),
        tables.load_flag_seed(spark, stored["flags"]),
    )
    return base.enriched(inputs).select(
        "game_key", "developer", "publisher", "genre", "genres_raw", "is_vr"
    )


# Joins


@query
def q_key_audit(spark, sf_dir):
    return keys.repeated_keys(trade.titles(spark, sf_dir, key=SHARED_KEY), ["game_key"])


@query
def q_join_repeated_keys(spark, sf_dir):
    """Ranks joined back where titles share a key, which the report finds out itself."""
    inputs = trade.inputs(spark, sf_dir)._replace(
        titles=trade.titles(spark, sf_dir, key=SHARED_KEY)
    )
    return champions.champions_report(inputs).select(
        "game_key", "game_name", "release_year", "era_rank", "genre_era_rank",
        "genre_era_count", "vr_era_rank",
    )


@query
def q_join_tolerance(spark, sf_dir):
    joined = enrich.tolerant_join(
        _gated(spark, sf_dir), trade.seed(spark, sf_dir), keep="all"
    )
    return joined.select(
        "game_key", "name_raw", "release_year", "seed_year",
        "developer_clean", "genre_clean", "is_vr",
    )


@query
def q_join_flag(spark, sf_dir):
    flagged = enrich.membership_flag(
        _gated(spark, sf_dir), trade.flags(spark, sf_dir), "is_flagged"
    )
    return flagged.select("game_key", "is_flagged")


@query
def q_join_inner_group_gate(spark, sf_dir):
    gates = fixed.DEFAULT_GATES
    eligible = metrics.with_era(_gated(spark, sf_dir)).filter(
        F.col("critic_score") >= gates.champion_score
    )
    sized = metrics.with_group_size(
        eligible, ["era_label", "genres_raw"], "genre_era_count", spread_by="game_key"
    )
    return metrics.min_size(sized, "genre_era_count", gates.min_per_genre_era).select(
        "game_key", "era_label", "genres_raw", "genre_era_count"
    )


@query
def q_join_rank_back(spark, sf_dir):
    rows = champions.with_rank_keys(_games_once(spark, sf_dir))
    ranked = rank.dense_ranks(
        rows.filter(F.col("critic_score") >= 80), [champions.genre_contest()], "game_key"
    )
    return rows.select("game_key", "era_label", "genre").join(
        ranked.select("game_key", "genre_era_rank"), "game_key", "left"
    )


@query
def q_join_group_stats(spark, sf_dir):
    rows = _games_once(spark, sf_dir)
    stats = metrics.era_stats(rows).drop("era_sort_order")
    # One row per era label, of which there are ten.
    return rows.select("game_key", "era_label", "genre").join(
        F.broadcast(stats), "era_label", "left"
    )


@query
def q_peak_join(spark, sf_dir):
    rows = _games_once(spark, sf_dir)
    years = written_once(timeline.indexed(metrics.genre_year(rows)), "genre-years")
    peaks = rank.peak(
        years, "genre", "genre_quality_index", "release_year", timeline.PEAK_VALUES
    )
    return (
        years.select("genre", "release_year", "genre_quality_index")
        .join(peaks, "genre", "left")
        .join(timeline.top_titles(rows), ["genre", "release_year"], "left")
    )


@query
def q_distinct_peak(spark, sf_dir):
    peaked = rank.with_peak(
        _genre_years(spark, sf_dir),
        "genre", "genre_quality_index", "release_year", timeline.PEAK_VALUES,
    )
    return peaked.select("genre", *timeline.PEAK_VALUES).distinct()


# Windows


@query
def q_win_dedup(spark, sf_dir):
    return dedup.best_title(_gated(spark, sf_dir)).select(
        name_key(F.col("name_raw")).alias("name_key"),
        "release_year", "game_key", "source", "critic_score",
    )


@query
def q_win_topk(spark, sf_dir):
    rows = _games(spark, sf_dir).filter(F.col("genre").isNotNull())
    return rank.top_k(rows, ["genre", "release_year"], timeline.by_merit(), 3).select(
        "genre", "release_year", "place", "game_key", "game_name", "critic_score", "user_score"
    )


@query
def q_win_rank_global(spark, sf_dir):
    return _indexed_years(spark, sf_dir).select(
        "release_year", "golden_era_index", trend.place("golden_era_index").alias("era_index_rank")
    )


def _ranked(spark: SparkSession, sf_dir: str, contest: rank.Contest) -> DataFrame:
    rows = champions.with_rank_keys(_games_once(spark, sf_dir))
    ranked = rank.dense_ranks(rows, [contest], spread_by="game_key")
    return ranked.withColumn("is_champion", rank.is_first(contest.rank))


@query
def q_win_rank_era(spark, sf_dir):
    return _ranked(spark, sf_dir, champions.era_contest()).select(
        "game_key", "era_label", "critic_score", "user_score", "reviews_total",
        "era_rank", "is_champion",
    )


@query
def q_win_rank_group_gated(spark, sf_dir):
    return _ranked(spark, sf_dir, champions.genre_contest()).select(
        "game_key", "era_label", "genre", "critic_score",
        "genre_era_rank", "genre_era_count", "is_champion",
    )


@query
def q_win_rank_flagged(spark, sf_dir):
    return _ranked(spark, sf_dir, champions.flagged_contest()).select(
        "game_key", "era_label", "is_vr", "critic_score", "vr_era_rank", "is_champion"
    )


@query
def q_win_lag(spark, sf_dir):
    return _gated_years(spark, sf_dir).select(
        "release_year", "avg_critic_score", "scored_games",
        trend.period_delta("avg_critic_score", places=2).alias("yoy_score_delta"),
        trend.period_delta("scored_games").alias("yoy_volume_delta"),
    )


@query
def q_win_lag_partitioned(spark, sf_dir):
    return _genre_years(spark, sf_dir).select(
        "genre", "release_year",
        trend.period_delta("avg_critic_score", within=["genre"], places=2).alias(
            "yoy_score_delta"
        ),
        trend.period_delta("game_count", within=["genre"]).alias("yoy_volume_delta"),
    )


@query
def q_win_first_value(spark, sf_dir):
    return rank.peak(
        _genre_years(spark, sf_dir),
        "genre", "genre_quality_index", "release_year", timeline.PEAK_VALUES,
    )


@query
def q_win_minmax(spark, sf_dir):
    return index_report.pillars(_gated_years(spark, sf_dir)).select(
        "release_year", "p1_quality_rate", "p2_avg_score", "p3_genre_diversity", "p4_volume",
        "p5_longevity",
    )


@query
def q_scale_rows(spark, sf_dir):
    return scale.minmax_scale_rows(
        trade.titles(spark, sf_dir),
        {
            "scaled_score": F.col("critic_score"),
            "scaled_reviews": F.ln(F.col("reviews_total") + 1),
        },
    ).select("game_key", "scaled_score", "scaled_reviews")


@query
def q_win_centred_mean(spark, sf_dir):
    return _indexed_years(spark, sf_dir).select(
        "release_year",
        trend.centred_mean("golden_era_index").alias("golden_era_index_3yr_avg"),
    )


@query
def q_top3_string(spark, sf_dir):
    return timeline.top_titles(_games(spark, sf_dir))


# Row-wise labels and resolved fields


@query
def q_waterfall(spark, sf_dir):
    return base.enriched(trade.inputs(spark, sf_dir)).select(
        "game_key", "developer", "publisher", "genre", "genres_raw", "is_vr"
    )


@query
def q_map_values(spark, sf_dir):
    return (
        base.enriched(trade.inputs(spark, sf_dir))
        .withColumn("mapped_genre", labels.map_values("genre"))
        .select("game_key", "genre", "mapped_genre")
    )


@query
def q_era_label(spark, sf_dir):
    return metrics.with_era(trade.titles(spark, sf_dir)).select(
        "game_key", "release_year", "era_label", "era_sort_order",
        labels.coverage_tier("release_year").alias("coverage_tier"),
    )


@query
def q_composite_index(spark, sf_dir):
    return index_report.pillars(_gated_years(spark, sf_dir)).select(
        "release_year",
        scale.composite().alias("golden_era_index"),
        scale.composite(on_null="zero").alias("index_null_as_zero"),
        scale.composite(on_null="renormalise").alias("index_renormalised"),
    )


@query
def q_quality_index(spark, sf_dir):
    return _genre_years(spark, sf_dir).select(
        "genre", "release_year", "game_count", "pct_above_80", "genre_quality_index"
    )


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.with_labels(_gated(spark, sf_dir))


@query
def q_bucket_age(spark, sf_dir):
    return _labelled(spark, sf_dir).select(
        "game_key", "game_age_years", "age_bucket", "age_bucket_sort"
    )


@query
def q_bucket_delta(spark, sf_dir):
    return _labelled(spark, sf_dir).select(
        "game_key", "nostalgia_delta", "nostalgia_label"
    )


@query
def q_bucket_longevity(spark, sf_dir):
    return _labelled(spark, sf_dir).select(
        "game_key", "avg_playtime_hrs", "longevity_tier", "longevity_tier_sort"
    )


@query
def q_bucket_reach(spark, sf_dir):
    return _labelled(spark, sf_dir).select("game_key", "owners_midpoint", "ownership_tier")


# Reports


@query
def q_report_index(spark, sf_dir):
    return index_report.index_report(trade.titles(spark, sf_dir))


@query
def q_report_champions(spark, sf_dir):
    return champions.champions_report(trade.inputs(spark, sf_dir))


@query
def q_report_genre(spark, sf_dir):
    return timeline.timeline_report(trade.inputs(spark, sf_dir))


@query
def q_report_items(spark, sf_dir):
    return items.items_report(trade.inputs(spark, sf_dir))


@query
def q_order_index(spark, sf_dir):
    report = index_report.placed(index_report.index_report(trade.titles(spark, sf_dir)))
    return report.select("place", "release_year", "golden_era_index")


@query
def q_order_champions(spark, sf_dir):
    report = champions.champions_report(trade.inputs(spark, sf_dir))
    return champions.placed(report).select(
        "place", "game_key", "era_sort_order", "critic_score", "user_score"
    )


@query
def q_order_genre(spark, sf_dir):
    report = timeline.timeline_report(trade.inputs(spark, sf_dir))
    return timeline.placed(report).select("place", "genre", "release_year")


@query
def q_order_items(spark, sf_dir):
    return items.placed(_items(spark, sf_dir)).select(
        "place", "game_key", "critic_score", "user_score"
    )


def _with_eras(spark: SparkSession, sf_dir: str) -> base.Inputs:
    """Inputs with eras made from the data in place of the fixed ones."""
    eras = written_once(trade.eras(spark, sf_dir), "eras")
    return trade.inputs(spark, sf_dir)._replace(eras=eras)


@query
def q_report_champions_eras(spark, sf_dir):
    return champions.champions_report(_with_eras(spark, sf_dir))


@query
def q_report_index_eras(spark, sf_dir):
    inputs = _with_eras(spark, sf_dir)
    return index_report.index_report(inputs.titles, eras=inputs.eras).select(
        "release_year", "era_label", "total_games", "golden_era_index"
    )


# Views


@query
def q_view_champions_genre(spark, sf_dir):
    report = champions.champions_report(trade.inputs(spark, sf_dir))
    return views.champions(report, genre="RPG").select("game_key", "genre", "genre_era_rank")


@query
def q_view_champions_vr(spark, sf_dir):
    report = champions.champions_report(trade.inputs(spark, sf_dir))
    return views.champions(report, "vr_titles").select("game_key", "is_vr", "vr_era_rank")


@query
def q_view_champions(spark, sf_dir):
    report = champions.champions_report(trade.inputs(spark, sf_dir))
    return views.champions(report, "era", "genre", "vr", "era_top5").select(
        "game_key", "game_name", "era_label", "genre", "era_rank", "is_era_champion",
        "is_genre_era_champion", "is_vr_era_champion",
    )


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.items_report(trade.inputs(spark, sf_dir))


@query
def q_view_delta_by_era(spark, sf_dir):
    return views.mean_gap(_items(spark, sf_dir), "era_label")


@query
def q_view_delta_by_age(spark, sf_dir):
    return views.mean_gap(_items(spark, sf_dir), "age_bucket")


@query
def q_view_legends(spark, sf_dir):
    return views.legends(_items(spark, sf_dir)).select(
        "game_key", "game_name", "release_year", "developer", "genre", "critic_score",
        "user_score",
    )


@query
def q_view_era_rank(spark, sf_dir):
    return views.era_ranking(index_report.index_report(trade.titles(spark, sf_dir)))


@query
def q_view_all_eras(spark, sf_dir):
    return views.genres_in_every_era(_games(spark, sf_dir))


@query
def q_view_outlier(spark, sf_dir):
    return views.largest_gap(_items(spark, sf_dir)).select(
        "game_key", "game_name", "critic_score", "user_score", "nostalgia_delta"
    )


@query
def q_view_spotlight(spark, sf_dir):
    return views.spotlight(_games(spark, sf_dir), "RPG")


@query
def q_view_survivorship(spark, sf_dir):
    return views.survivorship(_items(spark, sf_dir), "era_label")


@query
def q_view_survivorship_age(spark, sf_dir):
    return views.survivorship(_items(spark, sf_dir), "age_bucket")


@query
def q_view_matrix(spark, sf_dir):
    return views.quality_matrix(_games(spark, sf_dir))


@query
def q_view_matrix_wide(spark, sf_dir):
    return views.quality_matrix_wide(_games(spark, sf_dir))


@query
def q_view_quality(spark, sf_dir):
    return views.coverage_by_era(_games(spark, sf_dir))


@query
def q_view_nulls(spark, sf_dir):
    return views.null_profile(_items(spark, sf_dir))
