"""Inputs that the given tables yield, in Spark and as SQL CTEs of the same rows.

Daily bars come from lineitem: a code is a supplier, every supplier is one, a day the ship date,
a price the whole price of a unit, so that sums are exact. Listings come from the last bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_of(spark: SparkSession, sf_dir: str, code: Column, lines: DataFrame | None = None, together: bool = False) -> DataFrame:
    """Bars of lines; together: lines meet by code, so that windows over the series need no second exchange."""
    rows = (table(spark, sf_dir, "lineitem") if lines is None else lines).select(
        F.lpad(code.cast("string"), 6, "0").alias("code"),
        F.col("l_shipdate").cast("date").alias("dt"),
        F.floor(F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")).cast("double").alias("p"),
        F.col("l_quantity").cast("double").alias("q"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("k"),
    )
    rows = rows.repartition("code") if together else rows
    return rows.groupBy("code", "dt").agg(F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.sum("q").alias("volume"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of a code for each supplier."""
    return bars_of(spark, sf_dir, F.col("l_suppkey"), together=True)


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of a code for each nation's suppliers: few series with a bar nearly every day."""
    nation = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    return bars_of(spark, sf_dir, F.col("nation"), table(spark, sf_dir, "lineitem").join(nation, "l_suppkey"))


def bars_sql(code: str, rows: str = "lineitem") -> str:
    key = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
    return f"""(SELECT code, dt, first(p ORDER BY {key}) AS open, max(p) AS high, min(p) AS low, last(p ORDER BY {key}) AS close, sum(q) AS volume
  FROM (SELECT lpad(CAST({code} AS VARCHAR), 6, '0') AS code, CAST(l_shipdate AS DATE) AS dt,
               floor(CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE)) AS p, CAST(l_quantity AS DOUBLE) AS q, {key} FROM {rows})
  GROUP BY code, dt)"""


PANEL = "bars AS " + bars_sql("l_suppkey")
WIDE = "wide AS " + bars_sql("l_suppkey")
DENSE = "dense AS " + bars_sql("s_nationkey", "lineitem JOIN supplier ON s_suppkey = l_suppkey")
OVER = "PARTITION BY code ORDER BY dt"


def frame(n: int, last: int = 0) -> str:
    end = "CURRENT ROW" if last == 0 else f"{-last} PRECEDING"
    return f"({OVER} ROWS BETWEEN {n - 1 - last} PRECEDING AND {end})"


def mean_sql(x: str, n: int, last: int = 0) -> str:
    return f"CASE WHEN count({x}) OVER {frame(n, last)} = {n} THEN avg({x}) OVER {frame(n, last)} END"


def lag_sql(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({OVER})"


def projected_sql(n: int, k: int = 0) -> str:
    f = f"({OVER} ROWS BETWEEN {n - 2 + k} PRECEDING AND {1 + k} PRECEDING)"
    c = "close" if k == 0 else lag_sql("close", k)
    return f"CASE WHEN count(close) OVER {f} = {n - 2} THEN (2 * {c} + sum(close) OVER {f}) / {n} END"


MEANS = (3, 5, 8, 10, 13, 15, 20, 60, 120, 224)
FEATS = f"""{PANEL},
f0 AS (SELECT *, row_number() OVER ({OVER}) AS bar_no, row_number() OVER ({OVER}) AS n_bars,
  {", ".join(f"{mean_sql('close', n)} AS ma{n}" for n in MEANS)},
  {mean_sql('volume', 5)} AS v5, {mean_sql('volume', 20)} AS v20,
  {lag_sql('close')} AS c1, {lag_sql('open')} AS o1, {lag_sql('volume')} AS vol1,
  (close - {lag_sql('close')}) / {lag_sql('close')} * 100 AS ret,
  max(high) OVER ({OVER} ROWS BETWEEN 499 PRECEDING AND CURRENT ROW) AS win_high
  FROM bars),
feats AS (SELECT *, {lag_sql('ret')} AS ret1, {lag_sql('v20')} AS v20_1, {lag_sql('ma5')} AS ma5_1, {lag_sql('ma20')} AS ma20_1 FROM f0)"""


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing snapshot: the last bar of each supplier's series, names that the exclusions meet."""
    b = panel(spark, sf_dir)
    series = Window.partitionBy("code").orderBy("dt")
    last = b.withColumn("change", (F.col("close") - F.lag("close").over(series)) / F.lag("close").over(series) * 100)
    last = last.withColumn("__rn", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("dt")))).where("__rn = 1")
    s = table(spark, sf_dir, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("code"), "s_suppkey", "s_name", "s_nationkey", F.col("s_acctbal").cast("double").alias("marcap"))
    name = F.when(F.col("s_suppkey") % 11 == 0, F.lit(None).cast("string")).when(F.col("s_suppkey") % 7 == 0, F.concat("s_name", F.lit(" ETF"))).when(F.col("s_suppkey") % 5 == 0, F.concat("s_name", F.lit("우"))).otherwise(F.col("s_name"))
    market = F.element_at(F.array(*map(F.lit, ("KOSPI", "KOSDAQ", "KOSDAQ GLOBAL", "KONEX"))), (F.col("s_nationkey") % 4 + 1).cast("int"))
    hole = lambda c, k: F.when(F.col("s_suppkey") % k == 0, F.lit(0.0)).otherwise(F.col(c)).alias(c)
    return last.join(s, "code").select("code", name.alias("name"), market.alias("market"), hole("open", 3), hole("high", 4), "low", hole("close", 13), "volume", (F.col("close") * F.col("volume")).alias("amount"), "marcap", "change")


LISTING = f"""{WIDE},
lastbar AS (SELECT * FROM (SELECT *, (close - {lag_sql('close')}) / {lag_sql('close')} * 100 AS change, row_number() OVER (PARTITION BY code ORDER BY dt DESC) AS rn FROM wide) WHERE rn = 1),
listing AS (SELECT b.code,
  CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 7 = 0 THEN s_name || ' ETF' WHEN s_suppkey % 5 = 0 THEN s_name || '우' ELSE s_name END AS name,
  CASE s_nationkey % 4 WHEN 0 THEN 'KOSPI' WHEN 1 THEN 'KOSDAQ' WHEN 2 THEN 'KOSDAQ GLOBAL' ELSE 'KONEX' END AS market,
  CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE open END AS open, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE high END AS high, low,
  CASE WHEN s_suppkey % 13 = 0 THEN 0 ELSE close END AS close, volume, close * volume AS amount, CAST(s_acctbal AS DOUBLE) AS marcap, change
  FROM lastbar b JOIN supplier ON lpad(CAST(s_suppkey AS VARCHAR), 6, '0') = b.code)"""


def themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A category and subthemes for the suppliers of all regions but one, from their nations."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    joined = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).where("n_regionkey <> 3")
    subs = F.when(F.col("s_nationkey") % 2 == 0, F.array(F.lit("alpha"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")), F.lit("gamma"))).otherwise(F.array().cast("array<string>"))
    return joined.select(supplier_code().alias("code"), F.col("n_name").alias("category"), subs.alias("subthemes"))


def supplier_code() -> Column:
    return F.lpad(F.col("s_suppkey").cast("string"), 6, "0")


CODE = "lpad(CAST(s_suppkey AS VARCHAR), 6, '0')"
THEMES = f"""themes AS (SELECT {CODE} AS code, n_name AS category,
  CASE WHEN s_nationkey % 2 = 0 THEN ['alpha', 'region ' || n_regionkey, 'gamma'] ELSE CAST([] AS VARCHAR[]) END AS subthemes
  FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 3)"""
