"""Keys, eras as a table, NULL groups, exact means, table swaps; what the adapter covers."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from laureate import fixed, oracle
from laureate.functions.numbers import mean
from laureate.operators import intervals, keys, lookup, metrics, rank
from laureate.plans import champions, index_report, items, timeline
from laureate.queries import QUERIES
from laureate.schemas import ERA_TABLE
from laureate.sources import raw_csv, tables, trade
from tests import rows
from tests.compare import duck

SF_DIR = "/root/testdata/sf0.01"


# Means


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_halfway_means_do_not_depend_on_partitions(spark, parts):
    # Sums of these doubles differ with their order; the mean is exactly 0.125.
    values = [0.1, 0.2, 0.3, -0.1, 0.4, 0.15, -0.35, 0.3] * 500
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(parts)
    assert df.agg(mean(F.col("v"))).first()[0] == 0.13
    assert df.agg(mean(-F.col("v"))).first()[0] == -0.13


@pytest.mark.parametrize(
    "values,places,want",
    [([1, 2], 0, 2.0), ([-1, -2], 0, -2.0), ([1, 1, 2], 2, 1.33), ([2.675], 2, 2.68),
     ([], 2, None), ([None, 3], 1, 3.0), ([0, 0], 2, 0.0), ([10**12, 10**12 + 1], 0, 10.0**12 + 1)],
)
def test_mean(spark, values, places, want):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    assert df.agg(mean(F.col("v"), places)).first()[0] == want


# Keys


def test_repeated_keys(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,), (None,)], "k string")
    assert {tuple(r) for r in keys.repeated_keys(df, ["k"]).collect()} == {("a", 2), (None, 2)}
    assert not keys.is_unique(df, ["k"]) and keys.is_unique(df.distinct(), ["k"])


def test_report_joins_ranks_back_where_titles_share_a_key(spark):
    shared = [{"game_key": "1", "name_raw": n, "critic_score": s} for n, s in (("a", 90), ("b", 85))]
    inputs = rows.inputs(spark, *shared, {"game_key": "2", "name_raw": "c", "critic_score": 80})
    got = champions.champions_report(inputs).select("game_name", "era_rank").collect()
    # Both titles meet both ranks of their key.
    assert sorted(map(tuple, got)) == [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 3)]
    got = champions.champions_report(inputs, keys="unique").select("game_name", "era_rank").collect()
    assert sorted(map(tuple, got)) == [("a", 1), ("b", 2), ("c", 3)]
    with pytest.raises(ValueError):
        champions.champions_report(inputs, keys="maybe")


def test_both_forms_are_equal_on_unique_keys(spark):
    df = spark.range(500).selectExpr("id AS k", "id % 3 AS g", "id % 17 AS a", "string(id) AS n")
    contests = [rank.Contest("r", ("g",), ("a",), size="s")]
    one = rank.dense_ranks(df, contests, "k")
    other = rank.dense_ranks_by_key(df, contests, "k", "n")
    assert one.exceptAll(other.select(one.columns)).isEmpty() and other.count() == 500


# Eras


def eras(spark, *rows_):
    return spark.createDataFrame(list(rows_), ERA_TABLE)


@pytest.mark.parametrize("most", [100_000, 3])
def test_interval_lookup_equals_range_join(spark, monkeypatch, most):
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", most)
    table = eras(spark, (1990, 1995, "a", 2), (1994, 1999, "b", 1), (2003, 2003, "c", 3), (9, 8, "d", 4))
    df = spark.range(60).selectExpr("int(id) AS k", "int(1985 + id % 25) AS y").union(
        spark.createDataFrame([(99, None)], "k int, y int")
    )
    got = intervals.interval_lookup(
        df, table, "y", "first_year", "last_year", "era_sort_order", {"label": "era_label"}, "k"
    )
    spans = [(r.first_year, r.last_year, r.era_label) for r in table.orderBy("era_sort_order").collect()]

    def label(y):
        return next((x for lo, hi, x in spans if y is not None and lo <= y <= hi), None)

    assert got.count() == 61 and all(r.label == label(r.y) for r in got.collect())


def test_reports_take_their_eras_from_a_table(spark):
    table = eras(spark, (1999, 2000, "old", 1), (2001, 2010, "new", 2))
    inputs = rows.inputs(
        spark, {"release_year": 1999}, {"release_year": 2005}, {"release_year": 2020}
    )._replace(eras=table)
    report = champions.champions_report(inputs).select("release_year", "era_label", "era_sort_order")
    want = {(1999, "old", 1), (2005, "new", 2), (2020, "Unknown", 3)}
    assert set(map(tuple, report.collect())) == want
    got = items.items_report(inputs).select("release_year", "era_label")
    assert set(map(tuple, got.collect())) == {w[:2] for w in want}
    none = metrics.with_era(inputs.titles, eras(spark))
    assert {tuple(r) for r in none.select("era_label", "era_sort_order").collect()} == {("Unknown", 1)}


# NULL groups


def test_null_groups_are_counted_before_a_join_drops_them(spark):
    df = spark.createDataFrame(
        [(1, "x", None), (2, "x", None), (3, "x", "a"), (4, None, None), (5, "", "a")],
        "k int, g string, h string",
    )
    got = metrics.with_group_size(df, ["g", "h"], "n", "k", null_safe=True)
    assert dict(got.select("k", "n").collect()) == {1: 2, 2: 2, 3: 1, 4: 1, 5: 1}
    got = metrics.with_group_size(df, ["g", "h"], "n", "k")
    assert dict(got.select("k", "n").collect()) == {1: None, 2: None, 3: 1, 4: None, 5: 1}
    assert metrics.group_sizes(df, ["g", "h"], "n").count() == 4


# Order


@pytest.mark.parametrize("plan", [champions, items, index_report, timeline])
def test_places_follow_the_display_order(spark, plan):
    inputs = trade.inputs(spark, "/root/testdata/sf0.001")
    if plan is index_report:
        report = index_report.index_report(inputs.titles)
    else:
        name = {champions: "champions", items: "items", timeline: "timeline"}[plan]
        report = getattr(plan, f"{name}_report")(inputs)
    report = spark.createDataFrame(report.collect(), report.schema)
    want = [tuple(r) for r in plan.ordered(report).collect()]
    got = sorted(plan.placed(report).collect(), key=lambda r: r.place)
    assert [tuple(r)[:-1] for r in got] == want
    assert [r.place for r in got] == list(range(1, len(want) + 1))


# Tables


def test_a_table_is_swapped_in_one_step(spark, tmp_path):
    folder = str(tmp_path)
    tables.swap_table(spark.range(3), "swapped", folder)
    tables.swap_table(spark.table("swapped").filter("id > 0"), "swapped", folder)
    assert sorted(r.id for r in spark.table("swapped").collect()) == [1, 2]
    # The rows before are gone, and a failed write changes nothing.
    assert len(list(Path(folder).iterdir())) == 1
    with pytest.raises(ValueError):
        tables.swap_table(spark.range(3).withColumn("x", F.lit(1)), "swapped", folder)
    with pytest.raises(Exception):
        tables.swap_table(spark.range(3).selectExpr("id div 0 AS id"), "swapped", folder)
    assert spark.table("swapped").count() == 2
    spark.sql("DROP TABLE swapped")


def test_refused_records_are_kept_as_they_were(spark, tmp_path):
    path = str(tmp_path / "raw.csv")
    lines = ['1,steam,"a, ""b"" ",2000,x,, c ', "2,steam", '3,steam,"q ""z""",2001,90,1.5,p,more']
    Path(path).write_text("\n".join([",".join(trade.RAW.names), *lines]) + "\n")
    got = raw_csv.ingest_csv(spark, path, trade.RAW).select(raw_csv.CORRUPT).collect()
    assert [r[0] for r in got] == lines


# The adapter


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def values(con, sql, column):
    return {r[0] for r in con.execute(f"WITH {sql} SELECT DISTINCT {column}").fetchall()}


def test_every_label_occurs(con):
    eras_ = {label for _, _, label in fixed.ERAS}
    titles = f"{oracle.TITLES}, {oracle.ERAS}"
    assert values(con, titles, "coalesce(era_label, 'Unknown') FROM titles "
                  "LEFT JOIN eras ON release_year BETWEEN first_year AND last_year") == eras_ | {"Unknown"}
    assert values(con, oracle.CHAMPIONS, "era_label FROM champions") == eras_
    found = oracle.ITEMS
    for column, buckets, below, missing in (
        ("age_bucket", fixed.AGE_BUCKETS, fixed.AGE_BELOW, None),
        ("nostalgia_label", fixed.DELTA_BUCKETS, fixed.DELTA_BELOW, fixed.DELTA_MISSING),
        ("longevity_tier", fixed.LONGEVITY_BUCKETS, fixed.LONGEVITY_BELOW, fixed.LONGEVITY_MISSING),
        ("ownership_tier", fixed.OWNERSHIP_BUCKETS, fixed.OWNERSHIP_BELOW, fixed.OWNERSHIP_MISSING),
    ):
        want = {label for _, label in buckets} | {below} | ({missing} if missing else set())
        assert values(con, found, f"{column} FROM items") == want
    assert values(con, oracle.INDEX_REPORT, "coverage_tier FROM index_report") == {
        fixed.COVERAGE_BEFORE, fixed.COVERAGE_FROM,
    }


@pytest.mark.parametrize(
    "rows_,condition",
    [
        ("titles", "critic_score IS NULL"),
        ("titles", "release_year < 1993"),
        ("titles", "release_year > 2024"),
        ("titles", "name_raw = upper(name_raw)"),
        ("titles", "contains(name_raw, '-')"),
        ("enriched", "publisher = 'Unknown'"),
        ("enriched", "publisher <> 'Unknown'"),
        ("enriched", "developer = 'Studio'"),
        ("enriched", "genre = 'Unknown'"),
        ("enriched", "genres_raw = 'Unknown'"),
        ("enriched", "genre = 'Puzzle'"),
        ("games", "genre IS NULL"),
        ("games", "genre = 'MMO'"),
        ("years", "scored_games < 5"),
        ("years", "scored_games >= 5"),
    ],
)
def test_both_sides_of_every_choice_occur(con, rows_, condition):
    sql = {"titles": oracle.TITLES, "enriched": oracle.ENRICHED, "games": oracle.GAMES,
           "years": oracle.YEARS}[rows_]
    found, rest = con.execute(
        f"WITH {sql} SELECT count(*) FILTER ({condition}), count(*) FILTER (NOT ({condition})) FROM {rows_}"
    ).fetchone()
    assert found > 0 and rest > 0


def test_seeds_repeat_and_first_ranks_tie(con):
    assert con.execute(f"""WITH {oracle.GATED}, {oracle.SEED}
        SELECT max(n) FROM (SELECT count(*) AS n FROM gated JOIN seed
            ON lower(trim(name_raw)) = lower(trim(game_name)) AND abs(release_year - seed_year) <= 1
            GROUP BY game_key)""").fetchone()[0] == 3
    assert con.execute(f"""WITH {oracle.CHAMPIONS} SELECT max(n) FROM (
        SELECT count(*) AS n FROM champions WHERE era_rank = 1 GROUP BY era_label)""").fetchone()[0] > 1


def test_no_report_column_is_always_null(con):
    for sql, name in ((oracle.CHAMPIONS, "champions"), (oracle.ITEMS, "items")):
        cursor = con.execute(f"WITH {sql} SELECT * FROM {name}")
        held = list(zip(*cursor.fetchall()))
        empty = [d[0] for d, c in zip(cursor.description, held) if all(v is None for v in c)]
        assert not empty


def test_queries_cover_the_missing_items():
    assert {
        "q_agg_null_groups", "q_ingest_csv", "q_merge_sources", "q_replace_reload",
        "q_reload_inputs", "q_key_audit", "q_join_repeated_keys", "q_order_index",
        "q_order_champions", "q_order_genre", "q_order_items", "q_report_champions_eras",
        "q_report_index_eras", "q_view_champions_genre", "q_view_champions_vr",
    } <= set(QUERIES)
