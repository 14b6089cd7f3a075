"""Two scored sources into one staging table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laureate.fixed import DEFAULT_GATES, PRIMARY_SOURCE, Gates
from laureate.operators.dedup import best_title
from laureate.schemas import STAGING, conform


def merge_sources(
    primary: DataFrame,
    secondary: DataFrame,
    gates: Gates = DEFAULT_GATES,
    secondary_name: str = "metacritic",
    unicode_names: bool = True,
    any_whitespace: bool = False,
) -> DataFrame:
    """One row per title and year, the primary source's where both have it.

    Only scored titles within the covered years stay. Titles in other scripts are told
    apart; ``unicode_names=False`` compares ASCII letters and digits only, as the
    reports do by default, so such titles of one year share a row.
    """
    both = conform(
        primary.withColumn("source", F.lit(PRIMARY_SOURCE)), STAGING
    ).unionByName(conform(secondary.withColumn("source", F.lit(secondary_name)), STAGING))
    scored = both.filter(
        F.col("critic_score").between(0, 100)
        & F.col("release_year").between(gates.first_year, gates.last_year)
    )
    return best_title(
        scored, unicode_letters=unicode_names, any_whitespace=any_whitespace
    )
