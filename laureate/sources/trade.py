"""Order tables presented as a scored catalogue.

An order stands for a title, its customer's name for the title's name and its
price for the critic score. This lets every report run on order data of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laureate.plans.base import Inputs
from laureate.schemas import ERA_TABLE, SEED, STAGING, conform
from laureate.sources.tables import distinct_flags


# Declared, so that no job has to read file footers while a query is built.
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
        "c_mktsegment string"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": "l_orderkey bigint, l_quantity double",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


def titles(spark: SparkSession, sf_dir: str, key: str = "o_orderkey") -> DataFrame:
    """Every order as a title, with all labels, gaps and spellings that reports tell apart.

    ``key`` is the expression that ``game_key`` is made from.
    """
    places = _table(spark, sf_dir, "nation").join(
        _table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    joined = (
        _table(spark, sf_dir, "orders")
        .join(
            _table(spark, sf_dir, "customer"),
            F.col("o_custkey") == F.col("c_custkey"),
        )
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    derived = joined.withColumn(
        "year", F.expr("1991 + 5 * (year(o_orderdate) - 1995) + o_custkey % 5")
    ).selectExpr(
        f"{key} AS game_key",
        "CASE WHEN o_orderstatus = 'F' THEN 'steam' ELSE 'metacritic' END AS source",
        """CASE o_orderkey % 4 WHEN 0 THEN c_name WHEN 1 THEN upper(c_name)
            WHEN 2 THEN replace(c_name, '#', '-') ELSE concat('  ', c_name, ' ') END AS name_raw""",
        # Hardly any title is left in the last covered year.
        "CASE WHEN year = 2024 AND o_orderkey % 150 > 0 THEN 2023 ELSE year END AS release_year",
        """CASE WHEN o_orderkey % 23 > 0 THEN least(50 + floor(o_totalprice / 10000), 95) END
            AS critic_score""",
        """CASE WHEN c_acctbal < 0 THEN NULL WHEN c_custkey % 3 = 0 THEN floor(c_acctbal / 1000) * 10
            ELSE least(c_acctbal / 100, 90) END AS user_score""",
        "CASE WHEN release_year >= 2003 THEN o_custkey % 130 END AS avg_playtime_hrs",
        "CASE WHEN release_year >= 2003 THEN o_custkey % 130 * 45 END AS median_playtime_mins",
        """CASE o_orderkey % 6 WHEN 1 THEN floor(o_totalprice * 100) WHEN 2 THEN floor(o_totalprice * 10)
            WHEN 3 THEN floor(o_totalprice) WHEN 4 THEN floor(o_totalprice / 10)
            WHEN 5 THEN floor(o_totalprice / 100) END AS owners_midpoint""",
        "floor(owners_midpoint / 2) AS owners_range_low",
        "owners_midpoint * 2 AS owners_range_high",
        "CASE WHEN o_orderkey % 29 > 0 THEN o_custkey % 4 * 2500 END AS reviews_total",
        "o_orderkey % 101 AS review_ratio_pct",
        "floor(reviews_total * review_ratio_pct / 100) AS reviews_positive",
        "reviews_total - reviews_positive AS reviews_negative",
        "CASE WHEN o_orderkey % 2 = 0 THEN reviews_total * 2 END AS recommendations",
        "CASE WHEN release_year >= 2003 THEN o_orderkey % 5000 END AS peak_ccu",
        "floor(o_totalprice / 100) / 100 AS price_usd",
        "release_year >= 2003 AS has_playtime_data",
        "CASE o_orderkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'fuzzy' END AS score_match_tier",
        """CASE o_orderkey % 9 WHEN 0 THEN 'Action RPG' WHEN 1 THEN 'FPS' WHEN 2 THEN 'Casual'
            WHEN 3 THEN ' ' WHEN 4 THEN 'Strategy' WHEN 5 THEN 'Massively Multiplayer'
            WHEN 6 THEN 'First-Person Shooter' WHEN 7 THEN 'RPG' END AS primary_genre""",
        """CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN concat(',', n_name)
            ELSE concat(c_mktsegment, ',', n_name) END AS genres_raw""",
        "CASE WHEN c_custkey % 7 = 0 THEN '' ELSE n_name END AS developer",
        """CASE c_custkey % 11 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE r_name END
            AS publisher""",
    )
    return conform(derived, STAGING)


def seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated rows near one of a customer's years; some customers have two or three."""
    places = _table(spark, sf_dir, "nation").join(
        _table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    curated = (
        _table(spark, sf_dir, "customer")
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .selectExpr(
            "c_custkey",
            "concat('  ', upper(c_name), ' ') AS game_name",
            """1990 + 5 * (floor(c_custkey / 5) % 7) + c_custkey % 5 + c_custkey % 3
                AS release_year""",
            "c_mktsegment AS developer_clean",
            """CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 5 < 4 THEN r_name END
                AS genre_clean""",
            "CASE WHEN c_custkey % 13 > 0 THEN c_custkey % 10 = 0 END AS is_vr",
        )
    )
    later = curated.filter("c_custkey % 4 = 0").selectExpr(
        "c_custkey", "game_name", "release_year + 1", "'Studio'", "'RPG'", "true"
    )
    again = curated.filter("c_custkey % 8 = 0").selectExpr(
        "c_custkey", "game_name", "release_year", "NULL", "'Puzzle'", "false"
    )
    return conform(curated.union(later).union(again), SEED)


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_flags(
        _table(spark, sf_dir, "lineitem")
        .filter("l_quantity >= 49")
        .selectExpr("l_orderkey AS app_id")
    )


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    return Inputs(titles(spark, sf_dir), seed(spark, sf_dir), flags(spark, sf_dir))


def eras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eras of two years, newest first, with a year between them; the fullest year is one too."""
    years = titles(spark, sf_dir).groupBy("release_year").agg(F.count("*").alias("n"))
    pairs = years.selectExpr("release_year - release_year % 3 AS first_year").distinct().selectExpr(
        "first_year", "first_year + 1 AS last_year",
        "concat('Years from ', first_year) AS era_label", "2100 - first_year AS era_sort_order",
    )
    fullest = years.agg(F.max_by("release_year", F.struct("n", "release_year")).alias("year"))
    best = fullest.selectExpr("year", "year", "'Fullest year'", "0")
    return conform(pairs.union(best), ERA_TABLE)


#: Fields of a raw record, in file order.
RAW = T.StructType(
    [STAGING[c] for c in ("game_key", "source", "name_raw", "release_year", "critic_score",
                          "user_score", "publisher")]
)


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title as a line of CSV under a header; some are short, long or misfit.

    The only column is named like the header, so that written files begin with it.
    """
    rows = titles(spark, sf_dir).withColumn("n", F.col("game_key").cast("bigint"))
    fields = [
        "game_key",
        "source",
        # As CSV wants them: a name with a comma, and one with quotes.
        "CASE n % 5 WHEN 0 THEN concat('\"', name_raw, ', Jr.\"') "
        "WHEN 1 THEN concat('\"The \"\"', name_raw, '\"\"\"') ELSE name_raw END",
        "CAST(release_year AS STRING)",
        "CASE WHEN n % 17 = 0 THEN 'n/a' ELSE coalesce(CAST(critic_score AS STRING), '') END",
        "coalesce(CAST(user_score AS STRING), '')",
        "CASE WHEN n % 13 = 0 THEN 'Ltd,extra' ELSE coalesce(publisher, '') END",
    ]
    whole = F.concat_ws(",", *[F.expr(f) for f in fields])
    short = F.concat_ws(",", "game_key", "source", F.trim("name_raw"))
    line = F.when(F.expr("n % 11 = 0"), short).otherwise(whole)
    return rows.select(line.alias(",".join(RAW.names)))


def write_lines(lines: DataFrame, path: str) -> None:
    """Write a column of lines as they are, each file headed by the column's name."""
    lines.write.option("header", True).option("sep", "\x01").option("quote", "").option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)


def sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Titles of the two sources apart; names of some are in other scripts."""
    named = titles(spark, sf_dir).withColumn(
        "name_raw",
        F.expr("""CASE WHEN reviews_total % 1000 = 0
            THEN replace(lower(name_raw), 'customer', 'Покупатель') ELSE name_raw END"""),
    )
    return tuple(named.filter(F.col("source") == s) for s in ("steam", "metacritic"))
