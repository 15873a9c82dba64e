"""How often queries compute their bars, and how many files writers make."""

import glob

import pytest
from pyspark.sql import functions as F

from barloom import queries
from barloom.operators import comments
from barloom.plans.features import features
from barloom.queries import texts
from barloom.queries.derived import panel
from barloom.sources import sinks, store

DATA = "/root/testdata/sf0.001"


def scans_of_lines(df):
    return sum("lineitem" in f for f in df.inputFiles())


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bars_and_windows_share_an_exchange(spark):
    df = features(panel(spark, DATA))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name, most", [("s6_backfill_bars", 0), ("c9_scan_tracked_pullback", 1)])
def test_lines_are_read_once(spark, name, most):
    assert plan(queries.QUERIES[name](spark, DATA)).count("l_extendedprice") <= 4 * most


@pytest.mark.parametrize("name, module, writer", [("f1_write_picks", sinks, "write_picks"), ("f6_publish_latest", sinks, "write_latest"), ("f7_write_dashboard", sinks, "write_dashboard"), ("s11_read_picks_json", texts.readers, "read_results"), ("t10_replace_date_slice", store, "replace_date_slice")])
def test_found_rows_are_stored_before_they_are_used_twice(spark, monkeypatch, name, module, writer):
    real, seen = getattr(module, writer), []

    def spy(*args):
        rows = {"read_results": 2, "replace_date_slice": 1}.get(writer, 0)
        seen.append(scans_of_lines(args[rows]))
        return real(*args)

    monkeypatch.setattr(module, writer, spy)
    queries.QUERIES[name](spark, DATA).count()
    assert seen and not any(seen)


def test_picks_have_one_file_a_date_and_strategy(spark, tmp_path):
    picks = spark.range(0, 400, 1, 8).select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 10).cast("int")).alias("scan_date"), (F.col("id") % 2).cast("string").alias("strategy"), "id")
    sinks.write_picks(picks, str(tmp_path / "picks"))
    assert len(glob.glob(f"{tmp_path}/picks/*/*/*.json")) == 10
    assert spark.read.json(str(tmp_path / "picks")).count() == 400


@pytest.mark.parametrize("name", ["q4_rule_facts", "q4_rule_comment"])
def test_prices_are_formatted_once_chosen(spark, name):
    """Facts need no lambdas; the comment's one is the seed, made once a row."""
    assert plan(queries.QUERIES[name](spark, DATA)).count("aggregate(") == (name == "q4_rule_comment")
    assert "filter(" not in plan(queries.QUERIES[name](spark, DATA))


def test_mean_rows_are_filtered_without_lambdas(spark):
    assert "lambda" not in plan(queries.QUERIES["p15_ma_status_rows"](spark, DATA))


def test_whole_numbers_are_those_of_the_long_way(spark):
    values = [0.5, 1.5, 2.5, -0.5, -0.2, -2.5, 1234567.49999, 999999999.5, 1e15, 1e20, float("nan"), float("inf"), None, 0.0, -0.0]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    got = rows.select(comments.whole(F.col("x")).alias("a"), F.format_string("%.0f", F.bround("x", 0)).alias("b")).collect()
    assert all(r.a == r.b for r in got), [(r.a, r.b) for r in got]
