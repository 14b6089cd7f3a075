"""Table shapes: the staging table, the two seeds and the four reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

STAGING = T.StructType(
    [
        T.StructField("game_key", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("name_raw", T.StringType(), False),
        T.StructField("release_year", T.IntegerType(), False),
        T.StructField("critic_score", T.IntegerType()),
        T.StructField("user_score", T.DoubleType()),
        T.StructField("avg_playtime_hrs", T.DoubleType()),
        T.StructField("median_playtime_mins", T.DoubleType()),
        T.StructField("owners_midpoint", T.LongType()),
        T.StructField("owners_range_low", T.LongType()),
        T.StructField("owners_range_high", T.LongType()),
        T.StructField("reviews_positive", T.LongType()),
        T.StructField("reviews_negative", T.LongType()),
        T.StructField("reviews_total", T.LongType()),
        T.StructField("review_ratio_pct", T.DoubleType()),
        T.StructField("recommendations", T.LongType()),
        T.StructField("peak_ccu", T.LongType()),
        T.StructField("price_usd", T.DecimalType(10, 2)),
        T.StructField("has_playtime_data", T.BooleanType()),
        T.StructField("score_match_tier", T.StringType()),
        T.StructField("developer", T.StringType()),
        T.StructField("publisher", T.StringType()),
        T.StructField("primary_genre", T.StringType()),
        T.StructField("genres_raw", T.StringType()),
    ]
)

SEED = T.StructType(
    [
        T.StructField("game_name", T.StringType(), False),
        T.StructField("release_year", T.IntegerType(), False),
        T.StructField("developer_clean", T.StringType()),
        T.StructField("genre_clean", T.StringType()),
        T.StructField("is_vr", T.BooleanType()),
    ]
)

ERA_TABLE = T.StructType(
    [
        T.StructField("first_year", T.IntegerType(), False),
        T.StructField("last_year", T.IntegerType(), False),
        T.StructField("era_label", T.StringType(), False),
        T.StructField("era_sort_order", T.IntegerType(), False),
    ]
)

FLAG_SEED = T.StructType([T.StructField("app_id", T.StringType(), False)])

# --- fixed values: report columns, in output order ---
INDEX_COLUMNS = (
    "release_year", "era_label", "coverage_tier",
    "total_games", "scored_games", "avg_critic_score", "avg_user_score",
    "pct_above_90", "pct_above_80", "pct_above_70", "peak_score",
    "distinct_genres", "avg_playtime_hrs", "avg_owners_midpoint",
    "avg_review_ratio",
    "p1_quality_rate", "p2_avg_score", "p3_genre_diversity", "p4_volume",
    "p5_longevity",
    "golden_era_index", "golden_era_index_3yr_avg", "era_index_rank",
    "yoy_score_delta", "yoy_volume_delta", "nostalgia_delta",
)
CHAMPION_COLUMNS = (
    "game_key", "source", "game_name", "release_year", "era_label",
    "era_sort_order", "genre", "genres_raw", "developer", "publisher", "is_vr",
    "critic_score", "user_score", "nostalgia_delta",
    "era_rank", "is_era_champion",
    "genre_era_rank", "genre_era_count", "is_genre_era_champion",
    "vr_era_rank", "is_vr_era_champion",
    "era_qualified_games", "era_avg_score", "era_peak_score",
    "era_distinct_genres", "era_start_year", "era_end_year", "era_vr_games",
    "avg_playtime_hrs", "owners_midpoint", "reviews_total", "review_ratio_pct",
    "peak_ccu", "has_playtime_data", "score_match_tier",
)
TIMELINE_COLUMNS = (
    "genre", "release_year", "era_label",
    "game_count", "avg_critic_score", "avg_user_score", "peak_score",
    "pct_above_90", "pct_above_80", "avg_playtime_hrs", "avg_owners_midpoint",
    "avg_nostalgia_delta",
    "genre_quality_index", "yoy_score_delta", "yoy_volume_delta",
    "peak_year", "peak_index", "peak_avg_score", "is_peak_year",
    "top3_games",
)
ITEM_COLUMNS = (
    "game_key", "source", "game_name", "release_year", "era_label", "genre",
    "developer", "publisher", "is_vr",
    "critic_score", "user_score",
    "nostalgia_delta", "nostalgia_label",
    "game_age_years", "age_bucket", "age_bucket_sort",
    "avg_playtime_hrs", "median_playtime_mins", "peak_ccu", "longevity_tier",
    "longevity_tier_sort", "has_playtime_data",
    "owners_midpoint", "owners_range_low", "owners_range_high",
    "ownership_tier",
    "reviews_positive", "reviews_negative", "reviews_total",
    "review_ratio_pct", "recommendations",
    "price_usd",
    "score_match_tier",
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns with its types; absent ones become typed NULLs.

    A value that does not fit its column fails the job instead of turning into NULL or
    being cut: casts are ANSI casts, and a fractional number has to stay the same.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    return df.selectExpr(
        *[f"{_fitted(f, have.get(f.name))} AS {f.name}" for f in schema.fields]
    )


def _fitted(field: T.StructField, have: T.DataType | None) -> str:
    kind, name = field.dataType.simpleString(), field.name
    if have is None:
        return f"CAST(NULL AS {kind})"
    cast = f"CAST({name} AS {kind})"
    narrows = isinstance(have, T.FractionalType) and not isinstance(
        field.dataType, (T.DoubleType, T.StringType)
    )
    if not narrows or have == field.dataType:
        return cast
    message = f"concat('{name} does not fit {kind}: ', CAST({name} AS STRING))"
    return (
        f"CASE WHEN {name} IS NULL THEN NULL "
        f"WHEN CAST({cast} AS {have.simpleString()}) = {name} THEN {cast} "
        f"ELSE CAST(raise_error({message}) AS {kind}) END"
    )
