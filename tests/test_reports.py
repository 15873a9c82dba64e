"""Report rows where a rate's decimal digits are a tie that binary arithmetic breaks."""

import datetime

import duckdb
import pandas as pd

from barloom import queries

NAME = "q12_report_rows_candle"


def tied(folder):
    """A code whose candle at bar 90 is followed by closes of 0.575 % and 1.225 % up on 4000."""
    prices = [(4000,)] * 90 + [(4000, 4700, 4000, 4400), (4000,), (4023,), (4000,), (4049,)]
    rows = [(1, i * 10 + j, 1, p * 10.0) for i, day in enumerate(prices) for j, p in enumerate(day)]
    lines = pd.DataFrame(rows, columns=["l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"])
    lines["l_partkey"], lines["l_quantity"] = 1, 10.0
    lines["l_shipdate"] = [pd.Timestamp(datetime.datetime(2000, 1, 3)) + pd.Timedelta(days=int(k) // 10) for k in lines["l_orderkey"]]
    lines.to_parquet(f"{folder}/lineitem.parquet", coerce_timestamps="us")


def test_ties_of_rates_go_to_the_even_digit_in_both(spark, tmp_path):
    tied(tmp_path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got = queries.QUERIES[NAME](spark, str(tmp_path)).toPandas()
    want = con.sql(queries.ORACLES[NAME]).df()
    rates = lambda df: sorted(zip(df["part"], df["day"], df["rate"], strict=True))
    assert {"+0.58%", "+1.22%"} <= set(got["rate"])
    assert rates(got) == rates(want)
