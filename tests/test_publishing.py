"""Published snapshots, dashboards and histories on small rows, with nulls, ties and reruns."""

import json

from pyspark.sql import functions as F

from barloom import schemas
from barloom.sources import readers, sinks

ROWS = "scan_date date, strategy string, rank int, code string, name string, close bigint, rate double, pattern string, comment string, chart string"


def day(spark, *rows):
    return spark.createDataFrame([(d, *r) for d, *r in rows], ROWS.replace("scan_date date", "scan_date string")).withColumn("scan_date", F.col("scan_date").cast("date"))


def test_keys_of_techniques(spark):
    names = [("차트_Podosi_기법", "podosi"), ("owner_V2기법", "v2"), ("__", ""), (None, None)]
    got = spark.createDataFrame(names, "report string, want string").select("want", sinks.technique_key(F.col("report"), ("owner_", *sinks.REPORT_PARTS)).alias("got"))
    assert all(r.want == r.got for r in got.collect())


def test_dashboards_keep_their_order_and_other_dates(spark, tmp_path):
    path = str(tmp_path / "dash")
    sinks.write_dashboard(day(spark, ("2024-01-02", "V2_기법", 2, "b", "B", 5, 1.5, "p", "c", "x.png"), ("2024-01-02", "V2_기법", 1, "z", None, None, None, None, None, None), ("2024-01-03", None, 1, "q", "Q", 1, 0.0, "", "", "")), path)
    sinks.write_dashboard(day(spark, ("2024-01-03", "V2_기법", 1, "n", "N", 7, -2.25, "한", 'say "hi"\n', "")), path)
    sinks.write_dashboard(day(spark, ("2024-01-03", "V2_기법", 1, "m", "M", 8, -2.25, "한", 'say "hi"\n', "")), path)
    got = sorted(tuple(r) for r in readers.read_dashboard(spark, path).withColumn("scan_date", F.col("scan_date").cast("string")).collect())
    assert got == [
        ("", "2024-01-03", 0, "q", "Q", 1, 0.0, "", "", ""),
        ("v2", "2024-01-02", 0, "z", "", 0, 0.0, "", "", ""),
        ("v2", "2024-01-02", 1, "b", "B", 5, 1.5, "p", "c", "x.png"),
        ("v2", "2024-01-03", 0, "m", "M", 8, -2.25, "한", 'say "hi"\n', ""),
    ]


def test_snapshots_are_whole_and_replaced(spark, tmp_path):
    path = str(tmp_path / "snap")
    overview = spark.createDataFrame([("000001", "KOSPI", 5, "steel"), ('0"2', "KOSDAQ", None, None)], f"code string, {schemas.OVERVIEW}")
    latest = spark.createDataFrame([("000001", "one", 10, 1.25)], f"code string, {schemas.LATEST_PRICE}")
    sinks.write_snapshots(overview.limit(1), latest, path)
    sinks.write_snapshots(overview, latest, path)
    back = lambda name, schema: sorted(tuple(r) for r in readers.read_keyed(spark, f"{path}/{name}", schema).collect())
    assert back(sinks.OVERVIEW_FILE, schemas.OVERVIEW) == [('0"2', "KOSDAQ", None, None), ("000001", "KOSPI", 5, "steel")]
    assert back(sinks.LATEST_FILE, schemas.LATEST_PRICE) == [("000001", "one", 10, 1.25)]


def test_a_merged_history_is_one_object(spark):
    rows = [(f"2024-01-{d:02d}", s, p, f"c{p}") for d in range(1, 8) for s in ("a", "b", None) for p in range(4)] + [(None, "a", 0, "lost")]
    history = spark.createDataFrame(rows, "scan_date string, strategy string, pos int, code string").withColumn("scan_date", F.col("scan_date").cast("date"))
    (line,) = sinks.merged_history(history, most=3).collect()
    got = json.loads(line.value)
    assert list(got) == [f"202401{d:02d}" for d in (7, 6, 5, 4, 3)]
    assert all(day == {s: [{"code": "c0"}, {"code": "c1"}, {"code": "c2"}] for s in ("a", "b", "")} for day in got.values())
    assert sinks.merged_history(history.where("false")).collect()[0].value == "{}"
