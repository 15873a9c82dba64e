"""Indicators over one series per code (W1-W11): Columns over windows of the same order.

All windows are partitioned by code and ordered by the integer day number, so that a plan has one
exchange. A mean over n rows is null until n values exist.

Wide windows don't cost in proportion to their width. `with_running` gives each bar running sums and
counts, so a mean is a difference of two of them. The extreme of n rows is that of at most eight
lags of the extreme of STEP rows, or of STEP times as many, on the same order; a sort for block
suffixes costs more than that. Columns of with_running that a query doesn't use are pruned.

Sums keep whole parts and fractions apart: whole parts are exact to 2^53, fractions err by less than
1e-10 of a unit over 10^5 bars. Values that aren't finite count as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series() -> WindowSpec:
    """All bars of a code in the order of their days."""
    return Window.partitionBy("code").orderBy("day")


def rows(first: int, last: int) -> WindowSpec:
    return series().rowsBetween(first, last)


#: Rows of the frames from whose extremes those of longer windows are put together.
STEP = 8


def running_sum(name: str) -> Column:
    """Number and sum (whole parts, fractions) of the finite values so far."""
    x = F.when(F.abs(F.col(name)) < float("inf"), F.col(name).cast("double"))
    so_far = rows(Window.unboundedPreceding, 0)
    zero = lambda c: F.coalesce(F.sum(c).over(so_far), F.lit(0.0))
    return F.struct(F.count(x).over(so_far).alias("n"), zero(x - x % 1).alias("whole"), zero(x % 1).alias("part"))


def with_running(bars: DataFrame) -> DataFrame:
    """bars (code, day, prices) with bar_no and what means and extremes of any bar derive from."""
    few = rows(1 - STEP, 0)
    sums = {"__close": running_sum("close"), "__volume": running_sum("volume"), "bar_no": F.row_number().over(series())}
    first = bars.withColumns(sums | {f"__high{STEP}": F.max("high").over(few), f"__low{STEP}": F.min("low").over(few)})
    return first.withColumns({f"__high{STEP**2}": extreme("high", STEP**2), f"__low{STEP**2}": extreme("low", STEP**2)})


def extreme(name: str, n: int, last: int = 0) -> Column:
    """Highest high or lowest low of at most n rows that end at offset `last`."""
    step = max(s for s in (1, STEP, STEP**2) if s < max(n, 2))
    offsets = sorted({*range(0, n - step + 1, step), n - step})
    parts = [back(name if step == 1 else f"__{name}{step}", k - last) for k in offsets]
    pick = F.greatest if name == "high" else F.least
    return pick(*parts) if len(parts) > 1 else parts[0]


def window_sum(name: str, n: int, last: int = 0) -> tuple[Column, Column]:
    """Number and sum of the values of n rows that end at offset `last`."""
    now, before = back(f"__{name}", -last), back(f"__{name}", n - last)
    less = lambda part: now[part] - F.coalesce(before[part], F.lit(0))
    return less("n"), less("whole") + less("part")


def full_mean(name: str, n: int, last: int = 0) -> Column:
    """Mean of n rows that end at offset `last`; null unless all n values exist."""
    count, total = window_sum(name, n, last)
    return F.when(count == n, total / n)


def sma(n: int) -> Column:
    return full_mean("close", n)


def volume_sma(n: int) -> Column:
    return full_mean("volume", n)


def back(name: str, k: int = 1) -> Column:
    """The value k bars earlier."""
    return F.lag(name, k).over(series()) if k else F.col(name)


def percent(now: Column, before: Column) -> Column:
    return F.try_divide(now - before, before) * 100


def daily_return(k: int = 0) -> Column:
    """Change of the close in percent, of the bar k bars earlier."""
    return percent(back("close", k), back("close", k + 1))


def projected_sma(n: int, k: int = 0) -> Column:
    """Tomorrow's mean of n closes if the close repeats, as seen k bars earlier."""
    count, total = window_sum("close", n - 2, -1 - k)
    return F.when(count == n - 2, (2 * back("close", k) + total) / n)


def sma_trend(n: int, mode: str = "scanner") -> Column:
    """'up' or 'down'. scanner: projected against actual mean; commentator: against the bar before."""
    if mode == "scanner":
        now, then = projected_sma(n), sma(n)
    elif n <= 20:
        now, then = projected_sma(n), projected_sma(n, 1)
    else:
        now, then = sma(n), full_mean("close", n, -1)
    return F.when(F.coalesce(now > then, F.lit(False)), "up").otherwise("down")


def volume_ratio(n: int = 20) -> Column:
    """Volume in percent of its mean; 100 where that isn't positive."""
    mean = volume_sma(n)
    return F.when(mean > 0, F.col("volume") / mean * 100).otherwise(F.lit(100.0))


def volume_trend_up() -> Column:
    return F.coalesce(volume_sma(5) > volume_sma(20), F.lit(False))


def ma_disparity() -> Column:
    """Distance of the 3-bar from the 5-bar mean in percent; 0 where that isn't positive."""
    return F.when(sma(5) > 0, F.abs(sma(3) - sma(5)) / sma(5) * 100).otherwise(F.lit(0.0))


def window_high(n: int = 500, lookback_days: int | None = None) -> Column:
    """Highest high of the loaded window, of its last n bars if it has as many."""
    if lookback_days is None:
        return extreme("high", n)
    return F.max("high").over(series().rangeBetween(-lookback_days, 0))


def prior_extremes(n: int = 20) -> tuple[Column, Column]:
    """Lowest low and highest high of the n bars before."""
    return extreme("low", n, -1), extreme("high", n, -1)


def former_peak_recent() -> Column:
    """Highest high at offsets -21 to -2, once there are 25 bars."""
    return F.when(F.col("bar_no") >= 25, extreme("high", 20, -2))


def in_slice(lookback_days: int | None) -> Column:
    """Bars that a slice of so many calendar days up to this bar holds."""
    if lookback_days is None:
        return F.row_number().over(series())
    return F.count("*").over(series().rangeBetween(-lookback_days, 0))
