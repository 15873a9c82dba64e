"""Rows that a candle chart draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions.indicators import series
from ..plans.features import as_of, numbered


def chart_feed(bars: DataFrame, target: str | None, means: tuple[int, ...], last: int, min_bars: int, short_mean: int | None = None) -> DataFrame:
    f = numbered(bars if target is None else as_of(bars, target, None))
    f = f.withColumns({f"ma{n}": ind.sma(n) for n in means})
    whole = Window.partitionBy("code").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    f = f.withColumns({"__n": F.max("bar_no").over(whole), "__all": F.avg("close").over(series().rowsBetween(Window.unboundedPreceding, 0))})
    if short_mean:
        alone = (F.col("__n") < short_mean) & (F.col("bar_no") == F.col("__n"))
        f = f.withColumn(f"ma{short_mean}", F.when(alone, F.col("__all")).otherwise(F.col(f"ma{short_mean}")))
    f = f.where((F.col("__n") >= min_bars) & (F.col("bar_no") > F.col("__n") - last))
    x = F.col("bar_no") - F.greatest(F.col("__n") - last, F.lit(0)) - 1
    height = F.abs(F.col("close") - F.col("open"))
    label = F.when(x % 5 == 0, F.date_format("dt", "MM-dd")).otherwise("")
    rows = [F.round(f"ma{n}", 6).alias(f"ma{n}") for n in means]
    return f.select("code", "dt", x.cast("int").alias("x"), "open", "high", "low", "close", "volume", *rows, (F.col("close") >= F.col("open")).alias("up"), F.least("open", "close").alias("body_bottom"), F.when(height == 0, 1.0).otherwise(height).alias("body_height"), label.alias("label"))


def chart_feed_report(bars: DataFrame, target: str | None = None, last: int = 40) -> DataFrame:
    """The last 40 bars with six means; series of fewer bars have no chart."""
    return chart_feed(bars, target, (5, 10, 20, 60, 120, 224), last, last)


def chart_feed_candle(bars: DataFrame, target: str | None = None, last: int = 40) -> DataFrame:
    """With the short means; a short series' 224-bar mean is that of all bars, on its last bar."""
    return chart_feed(bars, target, (3, 5, 8, 20, 60, 120, 224), last, 5, 224)
