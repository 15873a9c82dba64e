"""The feature pass: all indicators of all bars from one exchange and one sort by code.

Panel mode keeps every date. Where the reference first cuts a slice of lookback_days up to the
target and rolls inside it, n_bars counts the bars of that slice, and a mean of n bars at offset -k
counts only if n_bars - k >= n. As-of mode cuts the slice itself and keeps the last bar per code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions import patterns as pat
from ..functions.indicators import series, back

MEANS = (3, 5, 8, 10, 13, 15, 20, 60, 120, 224)


def numbered(bars: DataFrame, lookback_days: int | None = None) -> DataFrame:
    """Bars with day (integer day number), bar_no in the series, n_bars in the slice, and the running columns of the indicators."""
    days = bars.withColumn("day", F.datediff("dt", F.lit("1970-01-01").cast("date")))
    return ind.with_running(days).withColumn("n_bars", ind.in_slice(lookback_days))


def features(bars: DataFrame, lookback_days: int | None = None, keep_running: bool = False) -> DataFrame:
    """Bars with bar_no, n_bars, means, volume means, returns, values of the bar before, the window high and pre_low.

    keep_running leaves the running columns in, for indicators that are added later.
    """
    cols: dict[str, Column] = {f"ma{n}": ind.sma(n) for n in MEANS}
    cols |= {"v5": ind.volume_sma(5), "v20": ind.volume_sma(20), "ret": ind.daily_return(), "c1": back("close"), "o1": back("open"), "vol1": back("volume"), "win_high": ind.window_high(lookback_days=lookback_days), "pre_low": pat.pre_breakout_low()}
    first = numbered(bars, lookback_days)
    helpers = [c for c in first.columns if c.startswith("__")]
    done = first.withColumns(cols)
    done = done if keep_running else done.drop(*helpers)
    return done.withColumns({"ret1": F.lag("ret").over(series()), "v20_1": F.lag("v20").over(series()), "ma5_1": F.lag("ma5").over(series()), "ma20_1": F.lag("ma20").over(series())})


def held(mean: str | Column, n: int, k: int = 0) -> Column:
    """A mean over n bars at offset -k, null if the slice doesn't hold all of them."""
    value = F.col(mean) if isinstance(mean, str) else mean
    return F.when(F.col("n_bars") - k >= n, value)


def breakouts(feats: DataFrame, spans: tuple[int, ...] = (60, 120, 224), k: int = 30, min_turnover: float = 2e9, surge: float = 2.5) -> DataFrame:
    """feats with b60, b120, b224: struct (bar_no, low60) of the latest breakout of the last k bars."""
    flagged = feats.withColumns({f"__x{n}": pat.breakout_bar(n, min_turnover, surge, known=True) for n in spans})
    low = F.col("pre_low").alias("low60")
    found = flagged.withColumns({f"b{n}": pat.latest_flag_within(F.col(f"__x{n}"), [low], k) for n in spans})
    return found.drop(*(f"__x{n}" for n in spans))


def as_of(bars: DataFrame, target: str, lookback_days: int | None = 400) -> DataFrame:
    """The slice of bars up to the target."""
    end = F.lit(target).cast("date")
    cut = bars.where(F.col("dt") <= end)
    return cut if lookback_days is None else cut.where(F.col("dt") >= F.date_sub(end, lookback_days))


def last_bar(df: DataFrame) -> DataFrame:
    """The last bar of each code; its window shares the series' partitioning."""
    last = F.max("day").over(series().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("__last", last).where("day = __last").drop("__last")
