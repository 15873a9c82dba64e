"""Top-k, retention and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_by_abs_rate(df: DataFrame, n: int = 12, by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """O3: the n rows of the largest absolute rate per group, with their rank."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.abs("rate")), "code")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


#: Labels in the order of their weight in a report.
REPORT_LABELS = ("Pattern 1", "Pattern 2", "Pattern 3", "60일선", "120일선", "60일의")


def report_order(df: DataFrame, n: int = 12, by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Starred first, then by label, then by rising rate; groups of more than n by absolute rate, cut to n."""
    weight: Column = F.lit(99)
    for i, label in reversed(list(enumerate(REPORT_LABELS, 1))):
        weight = F.when(F.col("pattern").contains(label), i).otherwise(weight)
    group = Window.partitionBy(*by)
    plain = F.row_number().over(group.orderBy(F.when(F.col("pattern").contains("★"), 0).otherwise(1), weight, "rate", "code"))
    large = F.row_number().over(group.orderBy(F.desc(F.abs("rate")), "code"))
    ranked = df.withColumns({"__n": F.count("*").over(group), "__plain": plain, "__large": large})
    return ranked.withColumn("rank", F.when(F.col("__n") > n, F.col("__large")).otherwise(F.col("__plain"))).where(F.col("rank") <= n).drop("__n", "__plain", "__large")


def head_by_pos(df: DataFrame, n: int = 15, by: tuple[str, ...] = ("scan_date",)) -> DataFrame:
    """The first n rows of each file in its order."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("pos"))).where(F.col("rank") <= n)


def first_items(items: Column, n: int = 5) -> Column:
    """The first n entries of an array."""
    return F.slice(items, 1, n)


def keep_newest_dates(df: DataFrame, n: int = 5, date: str = "scan_date") -> DataFrame:
    """Rows of the n newest dates. Only the distinct dates are ranked."""
    days = df.select(date).distinct().orderBy(F.desc(date)).limit(n)
    return df.join(F.broadcast(days), date, "left_semi")


def carry_forward(history: DataFrame, today: DataFrame, date: str = "scan_date", day: str | None = None, strategies: list[str] | None = None) -> DataFrame:
    """today's rows, and for each of the strategies (None: all stored) without any, its rows of the newest stored date.

    The newest date is that of the whole history; carried rows get today's date if day is given.
    """
    newest = history.agg(F.max(date).alias("__newest"))  # one row
    old = history.crossJoin(F.broadcast(newest)).where(F.col(date) == F.col("__newest")).drop("__newest")
    if strategies is not None:
        old = old.where(F.col("strategy").isin(*strategies))
    old = old.join(today.select("strategy").distinct(), "strategy", "left_anti").select(*history.columns)
    return today.unionByName(old if day is None else old.withColumn(date, F.lit(day).cast("date")))


def replace_date_slice(history: DataFrame, today: DataFrame, date: str = "scan_date") -> DataFrame:
    """today's rows replace the stored ones of their dates."""
    return history.join(today.select(date).distinct(), date, "left_anti").unionByName(today)


def strategy_totals(picks: DataFrame) -> DataFrame:
    """A4: picks, with a chart, with a comment, per strategy."""
    some = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    return picks.groupBy("strategy").agg(F.count("*").alias("picks"), some("chart").alias("with_chart"), some("comment").alias("with_comment"))


def scan_summary(picks: DataFrame, by: list[str]) -> DataFrame:
    """Rows per label."""
    return picks.groupBy(*by).agg(F.count("*").alias("n"))


def repaired_count(df: DataFrame, old: str = "comment", new: str = "repaired") -> DataFrame:
    """Number of changed texts."""
    return df.agg(F.count_if(~F.col(old).eqNullSafe(F.col(new))).alias("repaired"))
