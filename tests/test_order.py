"""Global places against sorted lists."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from laureate.operators.order import numbered


def test_places_are_gapless_and_in_order(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([7, 7, 7, None, rng.randint(0, 50)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, v int")
    got = numbered(df, [F.desc_nulls_last("v"), F.col("k")], parts=7).collect()
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r.k, r.v) for r in sorted(got, key=lambda r: r.place)] == want
    assert sorted(r.place for r in got) == list(range(1, 3001))


def test_one_value_is_dealt_to_many_partitions(spark):
    from laureate.operators.order import in_order

    df = spark.range(20000).withColumn("v", F.lit(1))
    sizes = in_order(df, [F.col("v"), F.col("id")], parts=8).groupBy("_part").count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 2 * 20000 / 8


def test_no_rows(spark):
    assert numbered(spark.range(0), [F.col("id")]).count() == 0
