"""Seeded random catalogues: reports against DuckDB, ranks against plain windows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from laureate import oracle
from laureate.operators import lookup, rank, reuse
from laureate.plans import champions, index_report, items, timeline
from laureate.plans.base import Inputs
from laureate.schemas import FLAG_SEED, SEED, STAGING
from tests.compare import assert_same

GENRES = ["RPG", "Action RPG", "FPS", "Casual", "Puzzle", " ", "", None, "Unknown", "Strategy"]


def catalogue(seed: int, n: int = 900):
    """Titles with a hot name, a hot score tie, variants of names, gaps and odd years."""
    rng = random.Random(seed)
    names = ["Doom", "doom!", " DOOM ", "Half-Life", "half life", "原神", "崩坏", "", "Quake II"]
    titles = []
    for key in range(n):
        hot = rng.random() < 0.33
        name = "Doom" if hot and seed % 2 else rng.choice(names + [f"Title {key % 60}"] * 12)
        tie = hot and not seed % 2
        row = {
            "game_key": str(key),
            "source": rng.choice(["steam", "metacritic"]),
            "name_raw": f"Title {key}" if tie else name,
            "release_year": 2000 if tie else rng.randint(1990, 2026),
            "critic_score": 88 if tie else rng.choice([None, *range(60, 100)]),
            "user_score": None if tie else rng.choice([None, rng.randint(0, 200) / 2]),
            "avg_playtime_hrs": rng.choice([None, float(rng.randint(0, 130))]),
            "owners_midpoint": rng.choice([None, rng.randint(0, 2) * 10_000_000, 9_999]),
            "reviews_total": None if tie else rng.choice([None, 5, 25_000, 25_001, 31_000]),
            "review_ratio_pct": float(rng.randint(0, 100)),
            "developer": rng.choice([None, "", " ", "Dev"]),
            "publisher": rng.choice([None, "", "Pub"]),
            "primary_genre": rng.choice(GENRES),
            "genres_raw": rng.choice([None, "", ",RPG", "Racing,Sports", " Indie ,x"]),
        }
        titles.append(tuple(row.get(f.name) for f in STAGING.fields))
    seeds = {}
    for name in names + [f"Title {i}" for i in range(0, 60, 3)]:
        for _ in range(3):
            year = rng.randint(1995, 2010)
            seeds[(name.strip().lower(), year)] = (
                f" {name.upper()} ", year, rng.choice([None, " ", "Seed Dev"]),
                rng.choice([None, "", "Horror", "Casual"]), rng.choice([None, True, False]),
            )
    flags = [(str(k),) for k in rng.sample(range(n), n // 8)]
    return titles, list(seeds.values()), flags


@pytest.fixture(scope="module", params=[1, 2, 3])
def case(request, spark):
    import duckdb
    import pyarrow as pa

    titles, seeds, flags = catalogue(request.param)
    con = duckdb.connect()
    frames = {}
    for name, rows, schema in (
        ("staged", titles, STAGING), ("curated", seeds, SEED), ("flagged", flags, FLAG_SEED)
    ):
        frames[name] = spark.createDataFrame(rows, schema)
        con.register(name, frames[name].toArrow().cast(
            pa.schema([(f.name, t) for f, t in zip(schema, frames[name].toArrow().schema.types)])
        ))
    return Inputs(frames["staged"], frames["curated"], frames["flagged"]), con


def statement(query: str) -> str:
    """The query's statement over the random tables instead of the order tables."""
    sql = oracle.ORACLE[query]
    replaced = (
        (oracle.TITLES, "titles AS (SELECT * FROM staged)"),
        (oracle.SEED, "seed AS (SELECT * RENAME (release_year AS seed_year) FROM curated)"),
        (oracle.FLAGS, "flags AS (SELECT app_id FROM flagged)"),
    )
    for block, own in replaced:
        sql = sql.replace(block, own)
    assert "lineitem" not in sql and "customer" not in sql
    return sql


def test_index_report(case):
    inputs, con = case
    assert_same(index_report.index_report(inputs.titles), con, statement("q_report_index"))


def test_champions_report(case):
    inputs, con = case
    assert_same(champions.champions_report(inputs), con, statement("q_report_champions"))


def test_timeline_report(case):
    inputs, con = case
    assert_same(timeline.timeline_report(inputs), con, statement("q_report_genre"))


def test_items_report(case):
    inputs, con = case
    assert_same(items.items_report(inputs), con, statement("q_report_items"))


def test_reports_have_one_row_per_grain(case):
    inputs, _ = case
    for report, grain in (
        (index_report.index_report(inputs.titles), ["release_year"]),
        (champions.champions_report(inputs), ["game_key"]),
        (timeline.timeline_report(inputs), ["genre", "release_year"]),
        (items.items_report(inputs), ["game_key"]),
    ):
        assert report.groupBy(*grain).count().filter("count > 1").isEmpty()


def test_pillars_are_percentages(case):
    inputs, _ = case
    report = index_report.index_report(inputs.titles)
    pillars = [c for c in report.columns if c.startswith("p") and c[1].isdigit()]
    assert len(pillars) == 5
    for c in pillars:
        assert report.filter((F.col(c) < 0) | (F.col(c) > 100)).isEmpty()


def contest_rows(spark, n=4000):
    """A third of all rows tie completely; a tenth have no group."""
    r = F.pmod(F.xxhash64("id"), F.lit(1000))
    hot = F.col("id") % 3 == 0
    return spark.range(n).select(
        F.col("id").alias("k"),
        F.when(r % 10 != 0, (r % 4).cast("string")).alias("g"),
        F.when(hot, F.lit(7)).otherwise((r % 13).cast("int")).alias("a"),
        F.when(hot, F.lit(0.0)).otherwise((r % 50) / 2.0).alias("b"),
        F.when(hot, F.lit(0)).otherwise(r).cast("bigint").alias("c"),
        (r > 400).alias("eligible"),
    )


def contests():
    return [
        rank.Contest("r1", ("g",), ("a", "b", "c"), size="n1"),
        rank.Contest(
            "r2", ("g",), ("a",), takes_part=F.col("eligible"), min_size=550, size="n2"
        ),
    ]


def windowed(df):
    """The same ranks by a window over each whole group."""
    def over(order, eligible):
        part = Window.partitionBy("g", eligible)
        return part, part.orderBy(*[F.desc(c) for c in order])

    whole, ordered = over(("a", "b", "c"), F.lit(True))
    df = df.withColumns(
        {"r1": F.dense_rank().over(ordered).cast("bigint"), "n1": F.count("*").over(whole)}
    )
    whole, ordered = over(("a",), F.col("eligible"))
    size = F.count("*").over(whole)
    in_two = F.col("eligible") & (F.col("_size") >= 550)
    df = df.withColumn("_size", size).withColumns(
        {
            "r2": F.when(in_two, F.dense_rank().over(ordered).cast("bigint")),
            "n2": F.when(in_two, F.col("_size")),
        }
    )
    ranked = ("r1", "n1", "r2", "n2")
    return df.drop("_size").select(
        *[c for c in df.columns if c not in (*ranked, "_size")],
        *[F.when(F.col("g").isNotNull(), F.col(c)).alias(c) for c in ranked],
    )


@pytest.mark.parametrize("broadcasts", [True, False])
@pytest.mark.parametrize("shared_folder", [True, False])
def test_counted_ranks_equal_windows(spark, setting, monkeypatch, broadcasts, shared_folder):
    if not broadcasts:
        monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
        setting("spark.sql.autoBroadcastJoinThreshold", "-1")
        setting("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    if not shared_folder:
        for module in (reuse, lookup):
            monkeypatch.setattr(module, "shared_folder", lambda spark: None)
    df = contest_rows(spark)
    got, want = rank.dense_ranks(df, contests(), "k"), windowed(df)
    want = want.select(got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert not got.filter("r2 = 1").isEmpty()


def test_rank_by_one_column(spark):
    df = contest_rows(spark).select("k", "g", "a")
    got = rank.dense_ranks(df, [rank.Contest("r", ("g",), ("a",))], "k")
    window = Window.partitionBy("g").orderBy(F.desc("a"))
    want = df.withColumn(
        "r", F.when(F.col("g").isNotNull(), F.dense_rank().over(window)).cast("bigint")
    )
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("slots", [1, 16, 300])
@pytest.mark.parametrize("counted", [True, False])
def test_lookup_join_equals_plain_join(spark, setting, monkeypatch, slots, counted):
    monkeypatch.setattr(lookup, "SLOTS_PER_PARTITION", slots)
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    setting("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    left = contest_rows(spark).select("k", "g", "a")
    right = left.dropna().groupBy("g", "a").agg(
        F.sum("k").alias("total"), F.count("*").alias("w")
    ).filter("a != 3")
    if counted:
        got = lookup.left_lookup(left, right, ["g", "a"], "k", weight="w")
        right = right.drop("w")
    else:
        right = right.union(right.selectExpr("g", "a", "-total", "-w"))
        got = lookup.left_lookup(left, right, ["g", "a"], "k")
    want = left.join(right, ["g", "a"], "left").select(got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def skewed_rows(spark):
    """3,000 keys of the same size, one that holds a third of all rows, and no key at all."""
    i = F.col("id")
    key = F.when(i % 3 == 0, F.lit(-1)).when(i % 50 != 1, i % 3000)
    return spark.range(120_000).select(i.alias("k"), key.alias("g"))


def largest_and_median(df):
    """Rows of the fullest partition of a plan and of the median one."""
    # Reading the column keeps the join that makes it in the plan.
    read = [F.count("*"), F.max(df.columns[0])]
    sizes = sorted(r[1] for r in df.groupBy(F.spark_partition_id()).agg(*read).collect())
    return sizes[-1], sizes[len(sizes) // 2], len(sizes)


@pytest.fixture
def no_help(setting, monkeypatch):
    """Joins by shuffle only, without any help at run time."""
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    setting("spark.sql.adaptive.enabled", "false")
    setting("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("counted", [True, False])
def test_hot_rows_are_spread(spark, no_help, counted):
    df = skewed_rows(spark)
    sizes = df.dropna().groupBy("g").agg(F.sum("k").alias("n"), F.count("*").alias("w"))
    weight = "w" if counted else None
    joined = lookup.left_lookup(df, sizes if counted else sizes.drop("w"), ["g"], "k", weight)
    largest, median, parts = largest_and_median(joined.select("n"))
    assert parts == 8 and largest < 1.5 * median
    plain = df.join(sizes, "g", "left").select("n")
    largest, median, _ = largest_and_median(plain)
    assert largest > 3 * median


def test_ranks_of_continuous_scores_are_spread(spark, no_help):
    """One group, a heavy critic score, user scores that never tie: even partitions."""
    df = spark.range(60_000).select(
        F.col("id").alias("k"), F.lit("one").alias("g"),
        F.when(F.col("id") % 3 > 0, 80).otherwise(F.col("id") % 20).alias("a"),
        F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("double").alias("b"),
    )
    found = []

    def watched(places, group, order, real=rank._dense):
        found.append(largest_and_median(real(places, group, order).select("_place")))
        return real(places, group, order)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(rank, "_dense", watched)
        got = rank.dense_ranks(df, [rank.Contest("r", ("g",), ("a", "b"))], "k")
    # The join with one number for each partition and group, and the lookup of all rows.
    for largest, median, _ in (*found, largest_and_median(got.select("r"))):
        assert largest < 2 * median
    window = Window.orderBy(F.desc("a"), F.desc("b"))
    want = df.withColumn("r", F.dense_rank().over(window).cast("bigint"))
    assert got.select("k", "r").exceptAll(want.select("k", "r")).isEmpty()
    assert rank.in_order(df, [F.col("g"), F.desc("a"), F.desc("b")]).groupBy("_part").count().agg(
        F.max("count") < 2 * F.median("count")
    ).first()[0]
