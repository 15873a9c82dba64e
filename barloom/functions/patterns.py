"""Flags and pattern searches over a series."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from . import indicators as ind
from .indicators import series, back, rows


def yes(condition: Column) -> Column:
    """A condition with null as false."""
    return F.coalesce(condition, F.lit(False))


def standard_candle(min_turnover: float = 500e8, body: float = 1.09, rise: float = 1.15, span: float = 1.15) -> Column:
    """A long white candle of large turnover; needs a bar before. Missing values pass, as negated gates do."""
    c, o, h, lo, before = F.col("close"), F.col("open"), F.col("high"), F.col("low"), back("close")
    return before.isNotNull() & ~yes(c * F.col("volume") < min_turnover) & ~yes(c < o * body) & ~yes(h < before * rise) & ~yes(h < lo * span)


def ma_alignment() -> tuple[Column, Column]:
    """Bullish: ma3 > ma5 > ma20; reverse: close below projected 5 < 10 < 20 < ma60 < ma120."""
    p5, p10, p20 = (ind.projected_sma(n) for n in (5, 10, 20))
    bullish = yes((ind.sma(3) > ind.sma(5)) & (ind.sma(5) > ind.sma(20)))
    reverse = yes((F.col("close") < p5) & (p5 < p10) & (p10 < p20) & (p20 < ind.sma(60)) & (ind.sma(60) < ind.sma(120)))
    return bullish, reverse


def ma_position_flags(floor: float = 0.995, stretch: float = 0.08) -> dict[str, Column]:
    """Whether the close holds the projected means, and whether it is stretched above the 10-bar one."""
    means = {n: ind.projected_sma(n) for n in (5, 10, 20)}
    flags = {f"above{n}": yes(F.col("close") >= m * floor) for n, m in means.items()}
    return flags | {"stretched": yes((F.col("close") - means[10]) / F.col("close") > stretch)}


def near(price: Column, line: Column, tol: float) -> Column:
    return price.between(line * (1 - tol), line * (1 + tol))


def near_ma(n: int, tol: float = 0.025) -> Column:
    """Close or low within a relative tolerance of the mean."""
    mean = ind.sma(n)
    return yes(near(F.col("close"), mean, tol) | near(F.col("low"), mean, tol))


def tail_touch_bar(tol: float = 0.025) -> Column:
    """An upper tail of half the body or more that ends near the bar's own 60- or 120-bar mean."""
    high, body = F.col("high"), F.abs(F.col("close") - F.col("open"))
    tail = high - F.greatest("open", "close")
    return yes((tail >= 0.5 * body) & (near(high, ind.sma(60), tol) | near(high, ind.sma(120), tol)))


def upper_tail_touch(touched: str = "tail_touch", k: int = 10) -> Column:
    """Whether the flag column held in the last k bars."""
    return yes(F.col("bar_no") - F.max(F.when(F.col(touched), F.col("bar_no"))).over(rows(Window.unboundedPreceding, 0)) < k)


def ma60_law_flag(tol: float = 0.025) -> Column:
    c, m = F.col("close"), ind.sma(60)
    return yes((ind.sma(120) > c) & (m < c) & near(c, m, tol))


def support_resistance_role(lines: dict[str, Column], close: Column, low: Column, peak: Column) -> tuple[Column, Column]:
    """The last line at or below the close (else the low) and the first above (else the peak, else the close x 1.1)."""
    array = F.array(*(F.struct(F.lit(k).alias("label"), v.alias("value")) for k, v in lines.items()))
    below = F.filter(array, lambda r: yes((r["value"] > 0) & (r["value"] <= close)))
    above = F.filter(array, lambda r: yes(r["value"] > close))
    support = F.coalesce(F.try_element_at(below, F.lit(-1))["value"], low)
    resistance = F.coalesce(F.try_element_at(above, F.lit(1))["value"], F.when(peak > close, peak), close * 1.1)
    return support, resistance


def former_peak_ref() -> Column:
    """Highest high 60 to 2 bars before, truncated; carried from a reference candle."""
    return ind.extreme("high", 59, -2).cast("long")


def pre_breakout_low() -> Column:
    return ind.extreme("low", 58, -3)


def breakout_bar(n: int, min_turnover: float = 2e9, surge: float = 2.5, known: bool = False) -> Column:
    """The close crosses its n-bar mean on a surge of volume; known: ma<n> and v20 are columns already."""
    mean, before, usual = (F.col(f"ma{n}"), back(f"ma{n}"), F.col("v20")) if known else (ind.sma(n), ind.full_mean("close", n, -1), ind.volume_sma(20))
    crossed = (F.col("close") > mean) & (back("close") <= before)
    return yes(crossed & (F.col("close") * F.col("volume") >= min_turnover) & (F.col("volume") >= surge * usual))


def latest_flag_within(flag: Column, payload: list[Column], k: int = 30) -> Column:
    """Struct (bar_no, payload...) of the latest bar of the last k whose flag column holds, else null."""
    latest = F.last(F.when(flag, F.struct(F.col("bar_no"), *payload)), ignorenulls=True).over(rows(Window.unboundedPreceding, 0))
    return F.when(F.col("bar_no") - latest["bar_no"] < k, latest)


def reference_candle(candle: str = "candle", max_age: int = 15, bars: Column | None = None) -> Column:
    """The standard candle (struct with bar_no and volume, or null) that a bar refers to.

    Its own, else the youngest of the last bars that is 3 bars old or has more volume than the bar. Those of age 1
    and 2 are looked up, the others are the last one carried along, so no frame is gathered. bars:
    number of bars of the slice, which must hold the candle and the bar before it.
    """
    bar_no = F.col("bar_no")

    def held(c: Column) -> Column:
        age = bar_no - c["bar_no"]
        return F.when((age <= max_age) if bars is None else (age <= max_age) & (age < bars - 1), c)

    young = [F.when(F.col("volume") < back(candle, k)["volume"], held(back(candle, k))) for k in (1, 2)]
    old = F.last(candle, ignorenulls=True).over(rows(Window.unboundedPreceding, -3))
    return F.coalesce(held(F.col(candle)), *young, held(old))


def gap_up_after(open_after: Column, close_ref: Column) -> Column:
    return yes(open_after > close_ref)


def weak_rebound(limit: float = 3.5) -> Column:
    """Yesterday's high less than so many percent above the close before."""
    return yes(ind.percent(back("high", 1), back("close", 2)) < limit)


def volume_drying(cum_now: Column, cum_ref: Column, age: Column, volume_ref: Column, share: float = 0.6) -> Column:
    """The mean volume of the bars after the reference candle is below a share of its volume."""
    return (age >= 1) & yes(F.try_divide(cum_now - cum_ref, age) < share * volume_ref)


def base_candle_recent(min_turnover: float = 1e9, rise: float = 4.0, surge: float = 2.0) -> Column:
    """Flag of a base candle: a rise, a surge and turnover. The base of a bar is the largest volume of the last 30."""
    return yes((ind.daily_return() >= rise) & (F.col("volume") >= surge * ind.volume_sma(20)) & (F.col("close") * F.col("volume") >= min_turnover))


def volume_state(days_ago: Column, base_volume: Column, rate: Column, ratio: Column) -> tuple[Column, Column]:
    """State of the volume against the base candle, and the drop in percent where it dries up."""
    fresh = yes(days_ago == 0) | yes((rate >= 4) & (ratio >= 180))
    dry = days_ago.isNotNull() & yes(F.col("volume") < base_volume)
    drop = F.when(~fresh & dry, (1 - F.try_divide(F.col("volume"), base_volume)) * 100)
    return F.when(fresh, "base_today").when(dry, "dry_pullback").otherwise("steady"), drop


def strong_bar(k: int) -> Column:
    """A white bar of 5 to 25 percent on 2.5 times the usual volume, k bars earlier."""
    return yes((F.lag("ret", k).over(series()) >= 5) & (F.lag("ret", k).over(series()) <= 25) & (back("close", k) > back("open", k)) & (back("volume", k) >= 2.5 * F.lag("v20", k).over(series()))) if k else yes((F.col("ret") >= 5) & (F.col("ret") <= 25) & (F.col("close") > F.col("open")) & (F.col("volume") >= 2.5 * F.col("v20")))


def sub_pattern() -> Column:
    """Class 1, 2 or 3 of a pick; needs columns ret, v20, ma10.

    2: a strong bar today with a long upper tail. 3: the nearest strong bar 2 to 4 bars ago, all
    bars between holding 98 % of their 10-bar mean and 99 % of its close, and today the latter. Else 1.
    """
    body = F.col("close") - F.col("open")
    two = strong_bar(0) & yes(F.col("high") - F.col("close") >= 0.75 * body)
    chain = F.when(two, 2)
    for k in (2, 3, 4):
        held = yes(F.col("close") >= 0.99 * back("close", k))
        for b in range(1, k):
            held &= yes((back("close", b) >= 0.98 * F.lag("ma10", b).over(series())) & (back("close", b) >= 0.99 * back("close", k)))
        chain = chain.when(strong_bar(k) & held, 3)
    return chain.otherwise(1)


def sub_pattern_completed() -> Column:
    """As sub_pattern, where yesterday also rests on the 5-bar mean above the low before, and today rises 4 %."""
    rest = yes((back("low") <= 1.025 * F.lag("ma5", 1).over(series())) & (back("close") >= 0.995 * F.lag("ma5", 1).over(series())) & (back("low") >= back("low", 2)))
    done = yes(F.col("close") >= 1.04 * F.col("open"))
    two = strong_bar(2) & yes(back("high", 2) - back("close", 2) >= 0.75 * (back("close", 2) - back("open", 2)))
    chain = F.when(rest & done & two, 2)
    for k in (3, 4, 5):
        held = yes(back("close") >= 0.99 * back("close", k))
        for b in range(2, k):
            held &= yes((back("close", b) >= 0.98 * F.lag("ma10", b).over(series())) & (back("close", b) >= 0.99 * back("close", k)))
        chain = chain.when(rest & done & strong_bar(k) & held, 3)
    return chain.otherwise(1)
