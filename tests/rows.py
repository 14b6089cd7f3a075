"""Small tables in the staging and seed shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from laureate.plans.base import Inputs
from laureate.schemas import FLAG_SEED, SEED, STAGING

DEFAULTS = {"source": "steam", "release_year": 2000, "critic_score": 80}


def titles(spark: SparkSession, *rows: dict) -> DataFrame:
    """Titles from partial rows; keys are numbered and names made unique if absent."""
    full = []
    for i, row in enumerate(rows, 1):
        row = {**DEFAULTS, "game_key": str(i), "name_raw": f"Game {i}", **row}
        full.append(tuple(row.get(f.name) for f in STAGING.fields))
    return spark.createDataFrame(full, STAGING)


def seed(spark: SparkSession, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), SEED)


def flags(spark: SparkSession, *keys: str) -> DataFrame:
    return spark.createDataFrame([(k,) for k in keys], FLAG_SEED)


def inputs(spark, *rows: dict, seeds=(), flagged=()) -> Inputs:
    return Inputs(titles(spark, *rows), seed(spark, *seeds), flags(spark, *flagged))


def by(df: DataFrame, key: str, *columns: str) -> dict:
    """{key: value} or {key: tuple of values}."""
    picked = df.select(key, *columns).collect()
    if len(columns) == 1:
        return {r[0]: r[1] for r in picked}
    return {r[0]: tuple(r[1:]) for r in picked}
