"""Physical plans: what is pushed down, trimmed, broadcast and kept in the JVM."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from laureate.operators import dedup, enrich
from laureate.plans import base, items
from laureate.sources import tables, trade
from tests import rows
from tests.compare import plan

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("staged") / "titles")
    rows.titles(spark, {}, {"critic_score": 70}).write.parquet(path)
    return tables.load_staging(spark, path)


def test_gate_reaches_the_scan(staged):
    text = plan(enrich.gate(staged))
    assert "GreaterThanOrEqual(critic_score,75)" in text
    assert "GreaterThanOrEqual(release_year,1993)" in text
    assert "LessThanOrEqual(release_year,2024)" in text


def test_only_needed_columns_are_read(staged):
    text = plan(staged.groupBy("release_year").agg(F.max("critic_score")))
    assert "ReadSchema: struct<release_year:int,critic_score:int>" in text


def test_dedup_trims_before_the_shuffle(staged):
    text = plan(dedup.best_title(enrich.gate(staged)))
    assert text.count("WindowGroupLimit") >= 2
    assert text.count("hashpartitioning") == 1


def test_small_seeds_are_broadcast(spark, staged, tmp_path):
    rows.seed(spark, ("doom", 2000, None, None, True)).write.parquet(f"{tmp_path}/seed")
    rows.flags(spark, "1").write.parquet(f"{tmp_path}/flags")
    inputs = base.Inputs(
        staged,
        tables.load_seed(spark, f"{tmp_path}/seed"),
        tables.load_flag_seed(spark, f"{tmp_path}/flags"),
    )
    text = plan(items.items_report(inputs))
    assert "SortMergeJoin" not in text
    assert text.count("BroadcastHashJoin") >= 2


def test_large_seeds_are_shuffled(spark, setting):
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    text = plan(items.items_report(trade.inputs(spark, SF_DIR)))
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text
