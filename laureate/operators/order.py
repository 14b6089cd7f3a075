"""Row places in a global order, without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laureate.operators.reuse import written

#: monotonically_increasing_id holds the partition above this bit and the row below.
_ROW_BITS = 33


def in_order(df: DataFrame, order: Sequence[Column], parts: int | None = None) -> DataFrame:
    """``df`` sorted over all its partitions, written, with its partition and row there.

    ``order`` should end in a key, so that equal rows can be dealt to several
    partitions. ``_part`` numbers the partitions in order, ``_row`` the rows of each
    from 0.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # Range bounds are sampled anew by each job, so the dealing is written down.
    stored = written(dealt.withColumn("_id", F.monotonically_increasing_id()), "in-order")
    return stored.withColumns(
        {
            "_part": F.shiftright("_id", _ROW_BITS),
            "_row": F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1),
        }
    ).drop("_id")


def numbered(
    df: DataFrame, order: Sequence[Column], name: str = "place", first: int = 1,
    parts: int | None = None,
) -> DataFrame:
    """Add each row's place in the order, gapless from ``first``.

    Rows are dealt to range partitions and counted there. A place is that in the
    partition plus the rows of the partitions before it: one number a partition,
    whatever the number of rows. The order is as in ``in_order``.
    """
    stored = in_order(df, order, parts)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    # As many rows as partitions.
    return (
        stored.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_before") + F.col("_row") + first)
        .drop("_part", "_row", "_before")
    )
