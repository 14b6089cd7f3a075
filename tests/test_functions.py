"""Labels, keys and gaps at their boundaries."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from laureate import fixed
from laureate.functions import labels, numbers, text


def evaluate(spark, values, kind, expression, given="v"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(given)).collect()]


def evaluate_text(spark, values, expression):
    return evaluate(spark, values, "string", expression, F.col("v"))


def test_era_edges(spark):
    years = [y for lo, hi, _ in fixed.ERAS for y in (lo, hi)] + [1992, 2025]
    expected = [n for *_, n in fixed.ERAS for _ in range(2)] + ["Unknown"] * 2
    assert evaluate(spark, years, "int", labels.era_label) == expected
    order = [i for i in range(1, 10) for _ in range(2)] + [10, 10]
    assert evaluate(spark, years, "int", labels.era_order) == order


def test_index_report_words_two_eras_differently(spark):
    got = evaluate(
        spark, [1995, 1999, 2000], "int", lambda y: labels.era_label(y, fixed.INDEX_ERAS)
    )
    assert got == ["Birth of 3D (Doom Era)", "Golden Age Candidates", "Pre-Steam Peak"]


def test_coverage_edge(spark):
    assert evaluate(spark, [2002, 2003], "int", labels.coverage_tier) == [
        "Metacritic-only (pre-Steam)", "Steam + Metacritic",
    ]


def test_age_edges(spark):
    ages = [20, 19, 15, 14, 10, 9, 5, 4]
    assert evaluate(spark, ages, "int", labels.age_bucket_order) == [1, 2, 2, 3, 3, 4, 4, 5]
    assert evaluate(spark, [4, 20], "int", labels.age_bucket) == [
        "Under 5 years (New)", "20+ years (Legend tier)",
    ]
    assert evaluate(spark, [2004], "int", lambda y: F.expr(labels.age(y))) == [20]


def test_delta_edges(spark):
    gaps = [10.0, 9.99, 3.0, 2.99, -3.0, -3.01, -10.0, -10.01, None]
    got = evaluate(spark, gaps, "double", lambda v: labels.delta_label("0", v))
    assert got == [
        "Cult Classic (users love it)", "Slight user preference", "Slight user preference",
        "Critics and users agree", "Critics and users agree", "Slight critic preference",
        "Slight critic preference", "Critics loved it more", "No user score",
    ]


def test_longevity_edges(spark):
    hours = [None, 4.9, 5.0, 20.0, 50.0, 100.0]
    assert evaluate(spark, hours, "double", labels.longevity_order) == [0, 1, 2, 3, 4, 5]
    assert evaluate(spark, [None, 4.9, 100.0], "double", labels.longevity_tier) == [
        "Legacy (pre-Steam, no data)", "Low engagement (<5h)", "Timeless (100h+ avg)",
    ]


def test_ownership_edges(spark):
    owners = [None, 9_999, 10_000, 100_000, 1_000_000, 10_000_000]
    assert evaluate(spark, owners, "bigint", labels.ownership_tier) == [
        "Unknown", "Micro (<10K)", "Niche (10K-100K)", "Significant (100K-1M)",
        "Major (1-10M owners)", "Mega (10M+ owners)",
    ]


def test_genre_map(spark):
    names = [*fixed.GENRE_RENAMES, *fixed.GENRES_DROPPED, "Puzzle", None]
    expected = ["MMO", "RPG", "Action", "Action"] + [None] * 7 + ["Puzzle", None]
    assert evaluate(spark, names, "string", labels.map_values) == expected


def test_genre_map_with_quotes_and_without_lists(spark):
    names = ["it's", "a\\b"]
    got = evaluate(spark, names, "string", lambda v: labels.map_values(v, {"it's": "its"}, ["a\\b"]))
    assert got == ["its", None]
    assert evaluate(spark, names, "string", lambda v: labels.map_values(v, {}, [])) == names


def test_genre_map_can_keep_shooters_apart(spark):
    renames = {**fixed.GENRE_RENAMES, "First-Person Shooter": "FPS", "FPS": "FPS"}
    got = evaluate(
        spark, ["First-Person Shooter", "FPS"], "string", lambda v: labels.map_values(v, renames)
    )
    assert got == ["FPS", "FPS"]


def test_first_token(spark):
    got = evaluate_text(spark, [None, "", ",RPG", "RPG,Action", "RPG"], text.first_token)
    assert got == [None, "", "", "RPG", "RPG"]
    assert evaluate_text(spark, ["a.b|c"], lambda v: text.first_token(v, "|")) == ["a.b"]


def test_waterfall_skips_blanks(spark):
    got = evaluate_text(
        spark, ["", "  ", None, " x "], lambda v: text.waterfall(v, F.lit(" "))
    )
    assert got == ["Unknown", "Unknown", "Unknown", "x"]


def test_whitespace_options(spark):
    odd = "\t Doom  "
    assert evaluate_text(spark, [odd], text.trimmed) == ["\t Doom  "]
    assert evaluate_text(spark, [odd], lambda v: text.trimmed(v, True)) == ["Doom"]


def test_name_keys(spark):
    names = ["BioShock", " Bioshock! ", "原神", "崩坏", "!!!", "Pokémon"]
    assert evaluate_text(spark, names, text.name_key) == [
        "bioshock", "bioshock", "", "", "", "pokmon",
    ]
    assert evaluate_text(spark, names, lambda v: text.name_key(v, True)) == [
        "bioshock", "bioshock", "原神", "崩坏", "!!!", "pokémon",
    ]


def test_share_with_unscored_rows(spark):
    df = spark.createDataFrame([(90,), (None,)], "s int")
    s = F.col("s")
    assert df.agg(
        numbers.pct_at_least(s, 80), numbers.pct_at_least(s, 80, denominator="scored")
    ).first()[:] == (50.0, 100.0)


def test_gap_without_user_score(spark):
    df = spark.createDataFrame([(80, None)], "c int, u double")
    c, u = F.col("c"), F.col("u")
    row = df.select(numbers.score_gap(c, u, "zero"), numbers.score_gap(c, u)).first()
    assert row[:] == (-80.0, None)


@pytest.mark.parametrize(
    "call",
    [
        lambda: numbers.score_gap(F.lit(1), F.lit(1), "mean"),
        lambda: numbers.pct_at_least(F.lit(1), 1, denominator="some"),
    ],
)
def test_unknown_options_are_refused(spark, call):
    with pytest.raises(ValueError):
        call()
