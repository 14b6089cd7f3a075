"""Left joins against a keyed lookup that survive hot keys on the left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laureate.operators.reuse import shared_folder, written_once

#: Lookup rows up to which they are broadcast.
BROADCAST_ROWS = 100_000

#: A slot holds about this part of a shuffle partition's fair share of the rows.
SLOTS_PER_PARTITION = 16


def left_lookup(
    left: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread_by: str,
    weight: str | None = None,
) -> DataFrame:
    """Add the lookup's columns to ``left``; as in SQL, a NULL key matches nothing.

    The lookup is written where the cluster has a shared folder, and counted. Up to
    ``BROADCAST_ROWS`` rows it is broadcast. Beyond, rows are dealt evenly:
    ``weight`` names the lookup column that tells how many left rows have the
    key (the lookup then has one row per key); without it the left side is
    counted first. A key with more rows than a slot should hold gets slots in
    proportion: its lookup rows are repeated for each, and its left rows choose one by
    a hash of ``spread_by``. Fewer than ``SLOTS_PER_PARTITION`` keys for each shuffle
    partition can be so heavy, whatever the data; they are told to the left side by
    broadcast. Rows with a NULL key choose among all hashes. All rows then pass one
    join on key and slot, in which no task gets much more than its share.
    """
    keys = list(keys)
    lookup = written_once(lookup, "lookup")
    values = [c for c in lookup.columns if c not in keys and c != weight]
    if shared_folder(left.sparkSession):
        if lookup.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            small = F.broadcast(lookup.select(*keys, *values))
            return left.join(small, keys, "left").select(*left.columns, *values)
    if weight is None:
        counts = written_once(
            left.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_rows")), "key-counts"
        )
    else:
        counts = lookup.select(*keys, F.col(weight).alias("_rows"))
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = parts * SLOTS_PER_PARTITION
    total = counts.agg(F.sum("_rows").alias("_total")).scalar()
    # The rows of a slot are at least the total over the slots.
    share = (F.col("_rows") * slots / total).cast("int")
    heavy = counts.select(*keys, (share + 1).alias("_slots")).filter(F.col("_slots") > 1)

    told = left.join(F.broadcast(heavy), keys, "left")
    spread = F.xxhash64(spread_by)
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    told = told.withColumn(
        "_slot",
        F.when(no_key, spread)
        .when(F.col("_slots").isNull(), F.lit(0).cast("long"))
        .otherwise(F.pmod(spread, F.col("_slots"))),
    )
    repeated = (
        lookup.join(F.broadcast(heavy), keys, "left")
        .withColumn(
            "_slot",
            F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_slots", F.lit(1)) - 1)),
        )
        .select(*keys, "_slot", F.struct(*values).alias("_found"))
    )
    joined = told.join(repeated, [*keys, "_slot"], "left")
    return joined.select(
        *[F.col(c) for c in left.columns],
        *[F.col(f"_found.{v}").alias(v) for v in values],
    )
