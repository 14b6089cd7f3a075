"""CSV ingest, source merge, table reads and writes."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import types as T

from laureate.operators import reuse
from laureate.operators.reuse import written_once
from laureate.plans import champions, index_report, items, timeline, views
from laureate.schemas import (
    CHAMPION_COLUMNS,
    INDEX_COLUMNS,
    ITEM_COLUMNS,
    STAGING,
    TIMELINE_COLUMNS,
    conform,
)
from laureate.sources import tables
from laureate.sources.merge import merge_sources
from laureate.sources.raw_csv import ingest_csv
from tests import rows

RAW = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("hours", T.DoubleType()),
        T.StructField("owners", T.LongType()),
    ]
)


def csv(tmp_path, *lines):
    path = tmp_path / "raw.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_csv(spark, tmp_path):
    path = csv(tmp_path, "name,hours,owners", '"Doom, II",1.5,10', '"The ""Best""",,', "x,2,3")
    got = ingest_csv(spark, path, RAW).collect()
    assert [tuple(r) for r in got] == [
        ("Doom, II", 1.5, 10, None), ('The "Best"', None, None, None), ("x", 2.0, 3, None),
    ]


def test_csv_with_shifted_header_is_refused(spark, tmp_path):
    path = csv(tmp_path, "name,owners,hours", "Doom,10,1.5")
    with pytest.raises(Exception, match="header does not conform"):
        ingest_csv(spark, path, RAW).collect()


def test_csv_keeps_bad_rows_apart(spark, tmp_path):
    path = csv(tmp_path, "name,hours,owners", "ok,1,2", "short,1", "long,1,2,3", "bad,one,2")
    table = ingest_csv(spark, path, RAW)
    got = rows.by(table, "name", "_corrupt")
    assert got == {"ok": None, "short": "short,1", "long": "long,1,2,3", "bad": "bad,one,2"}
    assert table.filter("_corrupt IS NOT NULL").count() == 3
    assert rows.by(table, "name", "hours")["bad"] is None
    with pytest.raises(Exception, match="MALFORMED"):
        ingest_csv(spark, path, RAW, on_bad_row="fail").collect()
    path = csv(tmp_path, "name,hours,owners", "bad,one,2")
    with pytest.raises(PySparkException, match="CAST_INVALID_INPUT"):
        ingest_csv(spark, path, RAW, on_bad_row="fail").collect()
    with pytest.raises(ValueError):
        ingest_csv(spark, path, RAW, on_bad_row="drop")


def test_merge(spark):
    primary = rows.titles(
        spark, {"name_raw": "Doom", "critic_score": 70, "peak_ccu": 9},
        {"name_raw": "Unscored", "critic_score": None}, {"name_raw": "Odd", "critic_score": 101},
    ).drop("source")
    secondary = rows.titles(
        spark, {"name_raw": "DOOM!", "critic_score": 99, "game_key": "m1"},
        {"name_raw": "Old", "release_year": 1992, "game_key": "m2"},
        {"name_raw": "Quake", "release_year": 1996, "game_key": "m3"},
        {"name_raw": "Unscored", "critic_score": 60, "game_key": "m4"},
    ).select("game_key", "name_raw", "release_year", "critic_score")
    merged = merge_sources(primary, secondary)
    assert [f.dataType for f in merged.schema] == [f.dataType for f in STAGING]
    assert merged.columns == STAGING.names
    assert rows.by(merged, "name_raw", "source", "critic_score", "peak_ccu") == {
        "Doom": ("steam", 70, 9), "Quake": ("metacritic", 80, None),
        "Unscored": ("metacritic", 60, None),
    }


def test_merge_keeps_titles_in_other_scripts_apart(spark):
    primary = rows.titles(spark, {"name_raw": "三国志"}, {"name_raw": "水浒传"})
    none = primary.limit(0)
    assert merge_sources(primary, none).count() == 2
    assert merge_sources(primary, none, unicode_names=False).count() == 1


def test_conform_refuses_fractions_of_whole_numbers(spark):
    good = spark.createDataFrame([("k", 74.0), ("l", None)], "game_key string, critic_score double")
    assert rows.by(conform(good, STAGING), "game_key", "critic_score") == {"k": 74, "l": None}
    bad = spark.createDataFrame([("k", 74.9)], "game_key string, critic_score double")
    with pytest.raises(PySparkException):
        conform(bad, STAGING).collect()


def test_conform_refuses_values_that_do_not_fit(spark):
    df = spark.createDataFrame([("k", "many")], "game_key string, reviews_total string")
    with pytest.raises(PySparkException):
        conform(df, STAGING).collect()


def test_tables_round_trip(spark, tmp_path):
    path = f"{tmp_path}/staging"
    table = rows.titles(spark, {"name_raw": "Doom"}, {"name_raw": "Quake"})
    table.write.parquet(path)
    again = tables.load_staging(spark, path)
    assert again.exceptAll(table).isEmpty() and again.count() == 2
    rows.seed(spark, ("doom", 2000, None, None, True)).write.parquet(f"{tmp_path}/seed")
    assert tables.load_seed(spark, f"{tmp_path}/seed").count() == 1
    spark.createDataFrame([(1,), (1,), (2,), (None,)], "app_id bigint").write.parquet(
        f"{tmp_path}/flags"
    )
    flags = tables.load_flag_seed(spark, f"{tmp_path}/flags")
    assert sorted(r.app_id for r in flags.collect()) == ["1", "2"]


def test_replace_table(spark):
    first = rows.titles(spark, {}, {})
    second = rows.titles(spark, {"release_year": 1999}, {"release_year": 2001}, {})
    try:
        tables.replace_table(first, "replaced")
        tables.replace_table(second, "replaced", partition_by=("release_year",))
        back = tables.load_staging(spark, "replaced")
        assert back.exceptAll(second).isEmpty() and back.count() == 3
    finally:
        spark.sql("DROP TABLE IF EXISTS replaced")


def test_written_once(spark, monkeypatch, tmp_path):
    df = spark.range(10).selectExpr("id", "id * 2 AS twice")
    assert reuse.shared_folder(spark)
    monkeypatch.setattr(reuse, "shared_folder", lambda spark: f"{tmp_path}/")
    again = written_once(df, "numbers")
    assert again.exceptAll(df).isEmpty() and again.count() == 10
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["numbers"]
    monkeypatch.setattr(reuse, "shared_folder", lambda spark: None)
    assert written_once(df, "numbers") is df


def test_report_columns_and_order(spark):
    inputs = rows.inputs(
        spark,
        *[{"primary_genre": "RPG", "critic_score": s, "user_score": u}
          for s, u in ((80, 1.0), (90, None), (90, 5.0), (85, 2.0), (85, 3.0))],
        {"primary_genre": "RPG", "critic_score": 99, "release_year": 2010},
    )
    index = index_report.ordered(index_report.index_report(inputs.titles))
    assert index.columns == list(INDEX_COLUMNS)
    assert [r.release_year for r in index.collect()] == [2000]
    lines = timeline.ordered(timeline.timeline_report(inputs))
    assert lines.columns == list(TIMELINE_COLUMNS) and lines.count() == 1
    kings = champions.ordered(champions.champions_report(inputs))
    assert kings.columns == list(CHAMPION_COLUMNS)
    assert [r.game_key for r in kings.collect()] == ["3", "2", "5", "4", "1", "6"]
    games = items.ordered(items.items_report(inputs))
    assert games.columns == list(ITEM_COLUMNS)
    assert [r.game_key for r in games.collect()] == ["6", "3", "2", "5", "4", "1"]


def test_excluded_genre(spark):
    inputs = rows.inputs(
        spark, *[{"primary_genre": g} for g in ("Stealth", "RPG") for _ in range(3)]
    )
    report = timeline.timeline_report(inputs, excluded_genres=["Stealth"])
    assert [r.genre for r in report.collect()] == ["RPG"]


def test_champion_views(spark):
    inputs = rows.inputs(
        spark,
        *[{"primary_genre": "RPG", "critic_score": s} for s in (99, 95, 94, 93, 92, 91)],
        {"primary_genre": "Puzzle", "critic_score": 90},
        flagged=["7"],
    )
    report = champions.champions_report(inputs)

    def keys(*kinds, **more):
        return sorted(r.game_key for r in views.champions(report, *kinds, **more).collect())

    assert keys("era") == ["1"]
    assert keys("genre") == ["1"]
    assert keys("vr") == ["7"]
    assert keys("vr_titles") == ["7"]
    assert keys("era_top5") == ["1", "2", "3", "4", "5"]
    assert keys(genre="Puzzle") == ["7"]
    assert keys("era", "vr") == ["1", "7"]


def test_all_null_columns_are_found(spark):
    profile = views.null_profile(rows.titles(spark, {"user_score": 1.0}, {}))
    got = rows.by(profile, "column_name", "null_rows", "null_pct", "all_null")
    assert got["user_score"] == (1, 50.0, False)
    assert got["avg_playtime_hrs"] == (2, 100.0, True)
    assert got["name_raw"] == (0, 0.0, False)
