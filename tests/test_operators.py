"""Operators on hand-made rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from laureate.fixed import Gates
from laureate.operators import dedup, enrich, metrics, rank, scale, trend
from laureate.plans import base, champions, index_report, timeline
from tests import rows


def test_gate(spark):
    years = [{"release_year": y} for y in (1992, 1993, 2024, 2025)]
    scores = [{"critic_score": s} for s in (74, 75, None)]
    kept = enrich.gate(rows.titles(spark, *years, *scores))
    assert {r.game_key for r in kept.collect()} == {"2", "3", "6"}


def test_other_gates(spark):
    gates = Gates(first_year=1980, min_score=10, champion_score=20, min_per_genre_era=1)
    inputs = rows.inputs(
        spark, {"release_year": 1985, "critic_score": 15, "primary_genre": "RPG"},
        {"release_year": 1985, "critic_score": 25, "primary_genre": "RPG"},
        {"release_year": 1985, "critic_score": 9},
    )
    report = champions.champions_report(inputs, base.Options(gates=gates))
    assert rows.by(report, "game_key", "era_label", "era_rank", "genre_era_rank") == {
        "1": ("Unknown", 2, None), "2": ("Unknown", 1, 1),
    }


def test_seed_tolerance(spark):
    years = (1998, 1999, 2000, 2001, 2002)
    table = rows.titles(
        spark, *[{"name_raw": f" dOOM {y} ", "release_year": 2000} for y in years]
    )
    seed = rows.seed(spark, *[(f"Doom {y}", y, f"dev {y}", None, None) for y in years])
    joined = enrich.tolerant_join(table, seed)
    assert rows.by(joined, "name_raw", "seed_year") == {
        " dOOM 1998 ": None, " dOOM 1999 ": 1999, " dOOM 2000 ": 2000, " dOOM 2001 ": 2001,
        " dOOM 2002 ": None,
    }
    plain = enrich.join_nearest_seed(table, seed)
    assert plain.select(joined.columns).exceptAll(joined).isEmpty()


def test_seed_fan_out(spark):
    table = rows.titles(spark, {"name_raw": "Doom", "release_year": 2000})
    seed = rows.seed(
        spark, ("doom", 1999, "early", "A", None), ("DOOM ", 2000, "same", "B", None),
        ("doom", 2001, "late", "C", None),
    )
    every = enrich.tolerant_join(table, seed, keep="all")
    assert sorted(r.seed_year for r in every.collect()) == [1999, 2000, 2001]
    assert [r.seed_year for r in enrich.tolerant_join(table, seed).collect()] == [2000]
    without_exact = seed.filter("release_year != 2000")
    assert [r.seed_year for r in enrich.tolerant_join(table, without_exact).collect()] == [1999]


def test_seed_rows_repeated_for_a_year(spark):
    table = rows.titles(spark, {"name_raw": "Doom"})
    seed = rows.seed(spark, ("doom", 2000, "b", None, None), ("Doom", 2000, "a", None, None))
    assert enrich.tolerant_join(table, seed).count() == 1
    every = enrich.tolerant_join(table, seed, keep="all")
    assert sorted(r.developer_clean for r in every.collect()) == ["a", "b"]


def test_years_below_the_gate_are_left_out(spark):
    scored = [{"release_year": 2000, "critic_score": 80 + i, "game_key": str(i)} for i in range(5)]
    table = rows.titles(spark, *scored, {"release_year": 2001, "game_key": "x"})
    assert [r.release_year for r in index_report.gated_years(table).collect()] == [2000]


def test_flag(spark):
    inputs = rows.inputs(
        spark,
        *[{"name_raw": n} for n in ("listed", "true", "false", "null", "none")],
        seeds=[("true", 2000, None, None, True), ("false", 2000, None, None, False),
               ("null", 2000, None, None, None)],
        flagged=["1"],
    )
    assert rows.by(base.enriched(inputs), "game_name", "is_vr") == {
        "listed": True, "true": True, "false": False, "null": False, "none": False,
    }


def test_genre_waterfall(spark):
    inputs = rows.inputs(
        spark,
        {"name_raw": "seeded", "primary_genre": "P", "genres_raw": "R,S"},
        {"name_raw": "blank seed", "primary_genre": "P"},
        {"name_raw": "raw token", "primary_genre": " ", "genres_raw": "RPG,Action"},
        {"name_raw": "blank token", "genres_raw": ",RPG"},
        {"name_raw": "empty", "genres_raw": ""},
        {"name_raw": "nothing"},
        seeds=[("seeded", 2000, " Dev ", " G ", None), ("blank seed", 2000, "  ", "", None)],
    )
    got = rows.by(base.enriched(inputs), "game_name", "genre", "genres_raw", "developer")
    assert got == {
        "seeded": ("G", "R,S", "Dev"),
        "blank seed": ("P", "", "Unknown"),
        "raw token": ("RPG", "RPG,Action", "Unknown"),
        "blank token": ("Unknown", ",RPG", "Unknown"),
        "empty": ("Unknown", "", "Unknown"),
        "nothing": ("Unknown", "Unknown", "Unknown"),
    }


def test_dedup(spark):
    table = rows.titles(
        spark,
        {"name_raw": "BioShock", "source": "metacritic", "critic_score": 99},
        {"name_raw": "Bioshock!", "source": "steam", "critic_score": 80},
        {"name_raw": "bioshock", "source": "steam", "release_year": 2001},
        {"name_raw": "Tie", "game_key": "9"},
        {"name_raw": "Tie", "game_key": "10"},
        {"name_raw": "High", "critic_score": 80},
        {"name_raw": "High", "critic_score": 90, "game_key": "high"},
        {"name_raw": "原神", "game_key": "x"},
        {"name_raw": "崩坏", "game_key": "y"},
    )
    best = dedup.best_title(table)
    assert {r.game_key for r in best.collect()} == {"2", "3", "10", "high", "x"}
    assert dedup.best_title(best).exceptAll(best).isEmpty()
    wide = dedup.best_title(table, unicode_letters=True)
    assert {"x", "y"} <= {r.game_key for r in wide.collect()}


def test_blanks_of_any_kind(spark):
    inputs = rows.inputs(
        spark,
        {"name_raw": "Doom\t", "developer": "\u00a0", "primary_genre": "\tRPG"},
        {"name_raw": "doom"},
        seeds=[("\tDOOM", 2001, "Seed", None, True)],
    )
    columns = ("developer", "genre", "is_vr")
    assert rows.by(base.games(inputs), "game_key", *columns) == {
        "1": ("\u00a0", "\tRPG", False)
    }
    got = base.games(inputs, base.Options(any_whitespace=True))
    assert rows.by(got, "game_key", *columns) == {"1": ("Seed", "RPG", True)}


def test_unknown_winner_removes_the_title(spark):
    inputs = rows.inputs(
        spark,
        {"name_raw": "Doom", "source": "steam"},
        {"name_raw": "Doom", "source": "metacritic", "primary_genre": "Action"},
    )
    assert base.games(inputs, drop_unknown=True).isEmpty()
    assert base.games(inputs).count() == 1


def test_year_gate_comes_before_scaling(spark):
    def year(y, scores):
        return [{"release_year": y, "critic_score": s} for s in scores]

    table = rows.titles(
        spark, *year(2000, [10] * 4), *year(2001, [50] * 5), *year(2002, [60] * 5),
        *year(2004, [70] * 5),
    )
    years = metrics.min_size(metrics.year_profile(table), "scored_games", 5)
    scaled = scale.minmax_scale(years, {"p": F.col("avg_critic_score")})
    assert rows.by(scaled, "release_year", "p") == {2001: 0.0, 2002: 50.0, 2004: 100.0}
    changed = years.select(
        "release_year",
        trend.period_delta("avg_critic_score").alias("change"),
        trend.period_delta("avg_critic_score", adjacent_only=True).alias("adjacent"),
        trend.centred_mean("avg_critic_score").alias("smooth"),
    )
    assert rows.by(changed, "release_year", "change", "adjacent", "smooth") == {
        2001: (None, None, 55.0), 2002: (10.0, 10.0, 60.0), 2004: (10.0, None, 65.0),
    }


def test_flat_pillar(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 3.0)], "k int, flat double, v double")
    for scaled in (scale.minmax_scale, scale.minmax_scale_rows):
        got = scaled(df, {"a": F.col("flat"), "b": F.col("v")})
        assert rows.by(got, "k", "a", "b") == {1: (None, 0.0), 2: (None, 100.0)}


def test_both_scalings_agree(spark):
    df = spark.range(500).select("id", (F.xxhash64("id") % 1000).alias("v"))
    columns = {"x": F.col("v"), "y": F.ln(F.abs("v") + 1)}
    one, two = scale.minmax_scale(df, columns), scale.minmax_scale_rows(df, columns)
    assert one.exceptAll(two).isEmpty()


def test_scaling_within_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5), ("b", 9)], "g string, v int")
    got = scale.minmax_scale(df, {"s": F.col("v")}, within=["g"])
    assert rows.by(got, "v", "s") == {1: 0.0, 2: 100.0, 5: 0.0, 9: 100.0}


def test_composite_with_a_missing_pillar(spark):
    df = spark.createDataFrame([(100.0, 50.0, None)], "a double, b double, c double")
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    got = df.select(
        *[scale.composite(weights, how) for how in ("propagate", "zero", "renormalise")]
    ).first()
    assert got[:] == (None, 65.0, 81.25)
    with pytest.raises(ValueError):
        scale.composite(on_null="skip")


def test_quality_index_cap(spark):
    df = spark.createDataFrame([(3,), (20,), (25,)], "n int")
    got = df.select(scale.quality_index(F.lit(50.0), F.col("n"))).collect()
    assert [r[0] for r in got] == [36.0, 70.0, 70.0]


def contested(spark, *table):
    inputs = rows.inputs(spark, *table)
    return champions.with_rank_keys(base.games(inputs))


def test_era_rank_ties(spark):
    games = contested(
        spark,
        {"critic_score": 90, "user_score": 50.0, "reviews_total": 5},
        {"critic_score": 90, "user_score": 50.0, "reviews_total": 5},
        {"critic_score": 90, "user_score": 0.0},
        {"critic_score": 90, "user_score": None},
        {"critic_score": 90, "user_score": 50.0, "reviews_total": 40_000},
        {"critic_score": 99, "release_year": 2005},
    )
    ranked = rank.dense_ranks(games, [champions.era_contest()], "game_key")
    assert rows.by(ranked, "game_key", "era_rank") == {
        "5": 1, "1": 2, "2": 2, "3": 3, "4": 3, "6": 1,
    }


def test_genre_gate(spark):
    def genre(name, *scores):
        return [{"primary_genre": name, "critic_score": s} for s in scores]

    games = contested(
        spark, *genre("Two", 90, 85), *genre("Three", 90, 85, 80), *genre("Mixed", 90, 85, 79),
        *genre("Casual", 90, 90, 90), *genre("Below", 79, 78, 77),
    )
    ranked = rank.dense_ranks(games, [champions.genre_contest()], "game_key")
    got = ranked.groupBy("primary_genre").agg(
        F.sort_array(F.collect_list("genre_era_rank")), F.max("genre_era_count")
    )
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == {
        "Two": ([], None), "Three": ([1, 2, 3], 3), "Mixed": ([], None), "Casual": ([], None),
        "Below": ([], None),
    }


def test_flagged_contest(spark):
    inputs = rows.inputs(
        spark,
        {"critic_score": 80},
        {"critic_score": 79, "release_year": 2005},
        {"critic_score": 95},
        flagged=["1", "2"],
    )
    report = champions.champions_report(inputs)
    assert rows.by(report, "game_key", "vr_era_rank", "is_vr_era_champion") == {
        "1": (1, True), "2": (None, False), "3": (None, False),
    }


def test_null_genre_in_the_champions_report(spark):
    inputs = rows.inputs(
        spark,
        {"critic_score": 99},
        {"critic_score": 90, "primary_genre": "RPG"},
        {"critic_score": 80, "primary_genre": "RPG"},
    )
    report = champions.champions_report(inputs)
    got = rows.by(
        report, "game_key", "genre", "era_rank", "genre_era_rank", "era_qualified_games",
        "era_avg_score",
    )
    assert got == {
        "1": (None, 1, None, 2, 85.0), "2": ("RPG", 2, None, 2, 85.0),
        "3": ("RPG", 3, None, 2, 85.0),
    }


def test_peak_tie(spark):
    df = spark.createDataFrame(
        [("g", 2001, 70.0), ("g", 2000, 70.0), ("g", 1999, 60.0), ("h", 2002, 10.0)],
        "genre string, release_year int, q double",
    )
    values = {"peak_year": "release_year", "peak": "q"}
    expected = {"g": (2000, 70.0), "h": (2002, 10.0)}
    assert rows.by(rank.peak(df, "genre", "q", "release_year", values), "genre", *values) == expected
    spread = rank.with_peak(df, "genre", "q", "release_year", values)
    assert spread.count() == 4
    assert rows.by(spread.distinct(), "genre", *values) == expected


def test_top3_label(spark):
    def games(genre, *scores):
        return [{"primary_genre": genre, "critic_score": s, "name_raw": f"{genre}{s}"} for s in scores]

    inputs = rows.inputs(spark, *games("A", 96, 90), *games("B", 81, 84, 83, 82))
    got = rows.by(timeline.top_titles(base.games(inputs)), "genre", "top3_games")
    assert got == {"A": "A96 (96) · A90 (90)", "B": "B84 (84) · B83 (83) · B82 (82)"}


def test_group_size_leaves_null_groups_out(spark):
    df = spark.createDataFrame(
        [(1, "a"), (2, "a"), (3, "b"), (4, None)], "k int, g string"
    )
    sized = metrics.with_group_size(df, ["g"], "n", "k")
    assert rows.by(sized, "k", "n") == {1: 2, 2: 2, 3: 1, 4: None}
