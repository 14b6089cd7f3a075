"""Keep the best row of each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laureate.fixed import PRIMARY_SOURCE
from laureate.functions.text import name_key


def keep_first(
    df: DataFrame,
    keys: Sequence[Column],
    order: Sequence[Column],
    k: int = 1,
    place: str | None = None,
) -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1 in ``place`` if named.

    Spark trims every group to ``k`` rows inside each task before the shuffle
    (WindowGroupLimit), so one very large group moves only ``k`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    number = place or "_place"
    first = df.withColumn(number, F.row_number().over(window)).filter(F.col(number) <= k)
    return first if place else first.drop(number)


def best_title(
    titles: DataFrame,
    primary: str = PRIMARY_SOURCE,
    unicode_letters: bool = False,
    any_whitespace: bool = False,
) -> DataFrame:
    """One row per near-identical name and year.

    The primary source wins, then the higher critic score; rows still equal are
    told apart by key and name, so the result does not depend on row order.
    """
    return keep_first(
        titles,
        keys=[
            name_key(F.col("name_raw"), unicode_letters, any_whitespace),
            F.col("release_year"),
        ],
        order=[
            F.when(F.col("source") == primary, 0).otherwise(1),
            F.col("critic_score").desc(),
            F.col("game_key"),
            F.col("name_raw"),
        ],
    )
