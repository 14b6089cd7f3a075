"""Checks that a key is one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, NULL included, with ``n_rows``.

    One aggregate, combined inside each task, so a key held by any share of the rows
    moves one row per task.
    """
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") > 1)


def is_unique(df: DataFrame, keys: Sequence[str]) -> bool:
    return repeated_keys(df, keys).isEmpty()
