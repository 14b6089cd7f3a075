"""Gates, seed joins and the fields resolved from several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laureate.fixed import DEFAULT_GATES, UNKNOWN, Gates
from laureate.functions.text import first_token, match_name, waterfall
from laureate.operators.dedup import keep_first
from laureate.operators.lookup import left_lookup

SEED_FIELDS = ("developer_clean", "genre_clean", "is_vr")


def gate(titles: DataFrame, gates: Gates = DEFAULT_GATES) -> DataFrame:
    """Scored titles good enough and recent enough to be reported."""
    return titles.filter(
        (F.col("critic_score") >= gates.min_score)
        & F.col("release_year").between(gates.first_year, gates.last_year)
    )


def seed_by_year(
    seed: DataFrame, tolerance: int = 1, keep: str = "nearest", any_whitespace: bool = False
) -> DataFrame:
    """Seed rows keyed by matching name and every title year they apply to.

    A year tolerance is a range join; repeating each seed row for the few years
    it covers turns it into a join on equal keys. ``keep="nearest"`` leaves the
    closest seed row per name and title year (the earlier one of two equally
    close), ``"all"`` leaves every one, also those that repeat a name and year.
    """
    if keep not in ("nearest", "all"):
        raise ValueError(f"keep must be 'nearest' or 'all', not {keep!r}")
    tie = [F.col(c) for c in SEED_FIELDS]
    curated = seed.select(
        match_name(F.col("game_name"), any_whitespace).alias("_match_name"),
        F.col("release_year").alias("seed_year"),
        *SEED_FIELDS,
    )
    if keep == "nearest":
        curated = keep_first(curated, [F.col("_match_name"), F.col("seed_year")], tie)
    years = curated.withColumn(
        "_match_year",
        F.explode(
            F.sequence(F.col("seed_year") - tolerance, F.col("seed_year") + tolerance)
        ),
    )
    if keep == "all":
        return years
    return keep_first(
        years,
        [F.col("_match_name"), F.col("_match_year")],
        [F.abs(F.col("_match_year") - F.col("seed_year")), F.col("seed_year")],
    )


def tolerant_join(
    titles: DataFrame,
    seed: DataFrame,
    tolerance: int = 1,
    keep: str = "nearest",
    any_whitespace: bool = False,
) -> DataFrame:
    """Left join on the matching name within ``tolerance`` years.

    For titles that are not deduplicated yet: a name may hold any share of them.
    """
    keyed = titles.withColumn(
        "_match_name", match_name(F.col("name_raw"), any_whitespace)
    ).withColumn("_match_year", F.col("release_year"))
    return left_lookup(
        keyed,
        seed_by_year(seed, tolerance, keep, any_whitespace).filter(
            F.col("_match_name").isNotNull()
        ),
        keys=["_match_name", "_match_year"],
        spread_by="game_key",
    ).drop("_match_name", "_match_year")


def join_nearest_seed(
    titles: DataFrame, seed: DataFrame, tolerance: int = 1, any_whitespace: bool = False
) -> DataFrame:
    """As ``tolerant_join`` for deduplicated titles.

    There a name has at most one row per year and spelling, and the seed side one
    row per name and year, so a plain equi-join has no hot key. Spark broadcasts
    the seed when its measured size allows and shuffles both sides otherwise.
    """
    lookup = seed_by_year(seed, tolerance, "nearest", any_whitespace)
    return titles.join(
        lookup,
        (match_name(F.col("name_raw"), any_whitespace) == F.col("_match_name"))
        & (F.col("release_year") == F.col("_match_year")),
        "left",
    ).drop("_match_name", "_match_year")


def membership_flag(
    titles: DataFrame, flags: DataFrame, name: str, key: str = "game_key"
) -> DataFrame:
    """TRUE where the title's key is among the flag keys, each of which occurs once."""
    return titles.join(
        flags.select(F.col("app_id")),
        F.col(key).cast("string") == F.col("app_id"),
        "left",
    ).select(*titles.columns, F.col("app_id").isNotNull().alias(name))


def resolve(joined: DataFrame, any_whitespace: bool = False) -> DataFrame:
    """Pick developer, publisher, genre and flag from seed, staging and defaults."""
    def first_filled(*candidates: Column) -> Column:
        return waterfall(*candidates, any_whitespace=any_whitespace)

    return joined.withColumnRenamed("name_raw", "game_name").withColumns(
        {
            "developer": first_filled(F.col("developer_clean"), F.col("developer")),
            "publisher": first_filled(F.col("publisher")),
            "genre": first_filled(
                F.col("genre_clean"),
                F.col("primary_genre"),
                first_token(F.col("genres_raw")),
            ),
            "genres_raw": F.coalesce("genres_raw", "genre_clean", F.lit(UNKNOWN)),
            "is_vr": F.col("_flagged") | F.coalesce("is_vr", F.lit(False)),
        }
    )
