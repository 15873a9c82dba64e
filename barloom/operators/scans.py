"""The screening rules (C1-C10): filters and projections over the feature pass.

target=None scans every date (panel mode); a date scans the slice of lookback_days up to it and
keeps the last bar of each code. Thresholds are arguments with the reference's defaults.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions import patterns as pat
from ..functions.indicators import series, back
from ..functions.patterns import yes
from ..plans.features import as_of, breakouts, features, held, last_bar, numbered


def prepared(bars: DataFrame, universe: DataFrame | None, target: str | None, lookback_days: int | None) -> DataFrame:
    """Features of the universe's bars: the semi-join comes before the windows.

    A frame that has the features already passes through, so that scans can share one persisted pass.
    """
    if "win_high" in bars.columns:
        return bars
    if universe is not None:
        bars = bars.join(universe.select("code").distinct(), "code", "left_semi")
    if target is None:
        return features(bars, lookback_days)
    return features(as_of(bars, target, lookback_days))


def picks(feats: DataFrame, hit: Column, strategy: str, target: str | None, pattern: Column | str = "Pattern 1", fresh: bool = False) -> DataFrame:
    """The rows that hit, in the pick schema less the name; features with as_of have one row a code already."""
    rows = feats if target is None or "as_of" in feats.columns else last_bar(feats)
    if target is not None and fresh:
        rows = rows.where(F.col("dt") == F.lit(target).cast("date"))
    label = F.lit(pattern) if isinstance(pattern, str) else pattern
    day = F.col("dt") if target is None else F.lit(target).cast("date")
    return rows.where(yes(hit)).select(day.alias("scan_date"), F.lit(strategy).alias("strategy"), "code", F.col("close").cast("long").alias("close"), F.round("ret", 6).alias("rate"), F.lit("predictive").alias("match_type"), label.alias("pattern"))


def scan_volume_surge(bars, universe=None, target=None, lookback_days=400, min_bars=224, surge=1.2, require_fresh=False):
    """Volume of 1.2 times its 20-bar mean or more."""
    f = prepared(bars, universe, target, lookback_days)
    v20 = held("v20", 20)
    return picks(f, (F.col("n_bars") >= min_bars) & (v20 > 0) & (F.col("volume") >= surge * v20), "yey", target, fresh=require_fresh)


def scan_breakout_retest(bars, universe=None, target=None, lookback_days=400, min_bars=224, high_factor=2.0, breakout_turnover=2e9, breakout_surge=2.5, require_fresh=False):
    """Far below the window's high, short means rising, and back at a mean that a recent breakout crossed.

    A breakout of age a counts only if the slice held both means at its bar: n_bars - a >= n + 1.
    """
    f = prepared(bars, universe, target, lookback_days)
    if "b60" not in f.columns:
        f = breakouts(f, min_turnover=breakout_turnover, surge=breakout_surge)
    age = {n: F.col("bar_no") - F.col(f"b{n}.bar_no") for n in (60, 120, 224)}
    valid = {n: F.when(F.col("n_bars") - age[n] >= n + 1, F.col(f"b{n}")) for n in age}
    m = {n: held(f"ma{n}", n) for n in (5, 20, 60, 120, 224)}
    rising = yes(m[5] >= held("ma5_1", 5, 1)) | yes(m[20] >= held("ma20_1", 20, 1))
    gate = (F.col("n_bars") >= min_bars) & yes(F.col("win_high") >= high_factor * F.col("close")) & yes(m[5] > m[20]) & rising
    pattern = F.lit(None).cast("string")
    for label, over, long, short in reversed((("Pattern 1", 120, 120, 60), ("Pattern 2", 60, 60, 20), ("Pattern 3", 224, 224, 120))):
        fits = valid[over].isNotNull() & yes(m[long] > m[short]) & yes(F.col("low") >= valid[over]["low60"] * 0.975) & yes(F.col("close") >= 0.95 * m[short]) & yes(F.col("close") <= 1.05 * m[long])
        pattern = F.when(fits, label).otherwise(pattern)
    f = f.withColumn("pattern", F.when(gate, pattern))
    return picks(f, F.col("pattern").isNotNull(), "podosi", target, F.col("pattern"), require_fresh)


def scan_ma60_rule(bars, universe=None, target=None, lookback_days=400, min_bars=125, require_fresh=False):
    """At the 60-bar mean below the 120-bar mean."""
    f = prepared(bars, universe, target, lookback_days)
    m60, m120 = held("ma60", 60), held("ma120", 120)
    hit = (F.col("n_bars") >= min_bars) & (m120 > 0.99 * F.col("close")) & (F.col("low") <= 1.025 * m60) & (F.col("close") >= 0.985 * m60)
    return picks(f, hit, "ma60_rule", target, "60일의 법칙", require_fresh)


def scan_surge_then_rest(bars, universe=None, target=None, lookback_days=400, min_bars=140, low=4.0, high=22.0, surge=1.5, rest=0.75, require_fresh=False):
    """C4: a strong white bar yesterday, a dark bar on little volume today."""
    f = prepared(bars, universe, target, lookback_days)
    strong = F.col("ret1").between(low, high) & (F.col("c1") > F.col("o1")) & (F.col("vol1") >= surge * held("v20_1", 20, 1))
    hit = (F.col("n_bars") >= min_bars) & strong & (F.col("close") < F.col("open")) & (F.col("volume") <= rest * F.col("vol1"))
    return picks(f, hit, "podosi_yey", target, fresh=require_fresh)


def scan_strong_candle(bars, universe=None, target=None, lookback_days=400, min_bars=130, low=6.0, high=20.0, surge=3.0, min_turnover=3e9, require_fresh=False):
    """A white bar of 6 to 20 percent on three times its usual volume, above its 20-bar mean."""
    f = prepared(bars, universe, target, lookback_days)
    rise = (F.col("ret") >= low) & (F.col("ret") < high) & (F.col("close") > F.col("open"))
    hit = (F.col("n_bars") >= min_bars) & rise & (F.col("volume") >= surge * held("v20", 20)) & (F.col("close") * F.col("volume") >= min_turnover) & (F.col("close") >= held("ma20", 20))
    return picks(f, hit, "v2", target, fresh=require_fresh)


def candle_features(bars: DataFrame, thresholds: dict[int, float], lookback_days: int | None = 220, max_age: int = 15) -> DataFrame:
    """Bars with ref<T> per threshold, the reference candle (struct) as of every bar, and the supports.

    The supports come first, as their series needs a sort of its own and rows are narrow there.
    """
    base = supports(numbered(bars, lookback_days))
    base = base.withColumns({"peak": pat.former_peak_ref(), "cum": F.sum("volume").over(ind.rows(Window.unboundedPreceding, 0))})
    flagged = {f"__candle{label}": F.when(pat.standard_candle(turnover) & (F.col("n_bars") >= 2), F.struct("bar_no", "volume", "close", "peak", "cum", "dt")) for label, turnover in thresholds.items()}
    base = base.withColumns(flagged)
    base = base.withColumns({f"ref{label}": pat.reference_candle(f"__candle{label}", max_age, F.col("n_bars")) for label in thresholds}).drop(*flagged)
    # The windows of the means stand above the choice of candles, so the optimizer doesn't copy that into every column.
    means = {f"ma{n}": ind.sma(n) for n in (3, 5, 8, 15, 20)} | {f"p{n}": ind.projected_sma(n) for n in (3, 5, 8, 20)}
    return base.withColumns(means | {"v5": ind.volume_sma(5), "v20": ind.volume_sma(20), "c1": back("close"), "ret": ind.daily_return(), "o1": back("open"), "weak": pat.weak_rebound()})


def supports(bars_with_no: DataFrame, last: int = 40, top: int = 3) -> DataFrame:
    """Of every bar: h_supports (W20) and trendline_support (W21), from strict pivots of the last bars.

    A pivot needs the bars after it, so it counts from two bars later on. Each three-bar pivot knows the one
    before it and every bar carries the last such pair along. The five-bar pivots are gathered from the frame, which
    is cheaper than a sort of the pivots as a series of their own (3.5 against 9 seconds of C7 on 533,473 bars).
    """
    low, bar_no = F.col("low"), F.col("bar_no")
    five = yes((low < back("low", 1)) & (low < back("low", 2)) & (low < F.lead("low", 1).over(series())) & (low < F.lead("low", 2).over(series())))
    three = yes((low < back("low", 1)) & (low < F.lead("low", 1).over(series())))
    flagged = bars_with_no.withColumns({"__p5": F.when(five, low), "__p3": F.when(three, F.struct("bar_no", low.alias("low")))})
    before = F.last("__p3", ignorenulls=True).over(ind.rows(Window.unboundedPreceding, -1))
    paired = flagged.withColumn("__p3", F.when(F.col("__p3").isNotNull(), F.struct(F.col("__p3").alias("p2"), before.alias("p1"))))
    pair = F.last("__p3", ignorenulls=True).over(ind.rows(Window.unboundedPreceding, -2))
    found = paired.withColumns({"__a5": F.collect_list("__p5").over(ind.rows(-(last - 3), -2)), "__p3": pair})
    near = F.filter("__a5", lambda p: p < F.col("close") * 1.01)
    p1, p2 = F.col("__p3.p1"), F.col("__p3.p2")
    slope = (p2["low"] - p1["low"]) / (p2["bar_no"] - p1["bar_no"])
    line = F.when((p1["bar_no"] >= bar_no - (last - 3)) & (p2["low"] > p1["low"]), F.bround(p2["low"] + slope * (bar_no - p2["bar_no"]), 0))
    out = found.withColumns({"h_supports": F.slice(F.sort_array(near, asc=False), 1, top), "trendline_support": line})
    return out.drop("__p5", "__p3", "__a5")


def scan_standard_candle(bars, universe=None, target=None, min_turnover=500e8, lookback_days=220, min_bars=80, label=500):
    """A reference candle at most 15 bars old; from age 3 on near the 15- or 20-bar mean."""
    if universe is not None:
        bars = bars.join(universe.select("code").distinct(), "code", "left_semi")
    cut = bars if target is None else as_of(bars, target, lookback_days)
    f = candle_features(cut, {label: min_turnover}, lookback_days if target is None else None)
    if target is not None:
        f = last_bar(f).where(F.col("dt") == F.lit(target).cast("date"))
    return candle_picks(f, label, min_bars=min_bars)


def candle_picks(f: DataFrame, *labels: int, min_bars: int = 80) -> DataFrame:
    """The candle-pick columns of the bars whose reference candle qualifies, for the first of the labels that does."""
    close, low = F.col("close"), F.col("low")
    near = yes(pat.near(close, F.col("ma15"), 0.025) | pat.near(low, F.col("ma15"), 0.025) | pat.near(close, F.col("ma20"), 0.025) | pat.near(low, F.col("ma20"), 0.025))

    def chosen(label: int) -> Column:
        ref = F.col(f"ref{label}")
        hit = (F.col("n_bars") >= min_bars) & ref.isNotNull() & ((F.col("bar_no") - ref["bar_no"] < 3) | near)
        return F.when(hit, F.struct(F.lit(label).alias("label"), ref.alias("ref")))

    hit = f.withColumn("__pick", F.coalesce(*map(chosen, labels))).where("__pick is not null")
    ref = F.col("__pick.ref")
    age = F.col("bar_no") - ref["bar_no"]
    trend = lambda n: F.when(yes(F.col(f"p{n}") > F.col(f"ma{n}")), "up").otherwise("down")
    expected = F.struct(*(F.col(f"p{n}").alias(f"ma{n}") for n in (3, 5, 8, 20)), *(trend(n).alias(f"ma{n}_trend") for n in (3, 5, 8, 20)))
    return hit.select(
        F.col("dt").alias("scan_date"),
        F.col("__pick.label").alias("candle_class"),
        "code",
        age.alias("day_type"),
        close.cast("long").alias("close"),
        low.cast("long").alias("low"),
        ref["peak"].alias("former_peak"),
        F.round("ret", 6).alias("rate"),
        F.round(F.when(F.col("v20") > 0, F.col("volume") / F.col("v20") * 100).otherwise(100.0), 6).alias("vol_ratio"),
        F.round(F.try_divide(F.col("volume"), ref["volume"]) * 100, 6).alias("vol_change_ratio"),
        F.round(F.when(F.col("ma5") > 0, F.abs(F.col("ma3") - F.col("ma5")) / F.col("ma5") * 100).otherwise(0.0), 6).alias("ma3_ma5_disparity"),
        yes(F.col("v5") > F.col("v20")).alias("vol_trend_up"),
        pat.volume_drying(F.col("cum"), ref["cum"], age, ref["volume"]).alias("vol_drying_ok"),
        yes((F.col("ma3") > F.col("ma5")) & (F.col("ma5") > F.col("ma20"))).alias("is_bullish_alignment"),
        (age.isin(1, 2) & pat.gap_up_after(F.when(age == 1, F.col("open")).otherwise(F.col("o1")), ref["close"])).alias("is_gap_up"),
        ((age == 2) & F.col("weak")).alias("has_weak_ma3_rebound"),
        "h_supports",
        "trendline_support",
        expected.alias("expected_ma"),
        ref["dt"].alias("ref_date"),
    )


def scan_integrated(bars, universe=None, target=None, high_turnover=500e8, low_turnover=150e8, n=15, lookback_days=220):
    """Both candle classes from one pass; the higher class first, each code once a date, at most n rows."""
    if universe is not None:
        bars = bars.join(universe.select("code").distinct(), "code", "left_semi")
    cut = bars if target is None else as_of(bars, target, lookback_days)
    f = candle_features(cut, {500: high_turnover, 150: low_turnover}, lookback_days if target is None else None)
    if target is not None:
        f = last_bar(f).where(F.col("dt") == F.lit(target).cast("date"))
    return priority_cut(candle_picks(f, 500, 150), n)


def integrate(picks_500: DataFrame, picks_150: DataFrame) -> DataFrame:
    """All picks of the higher class, and those of the lower whose code has none that day.

    For picks made apart; candle_picks with two labels gives the same from one pass.
    """
    return picks_500.unionByName(picks_150.join(picks_500.select("scan_date", "code"), ["scan_date", "code"], "left_anti"))


def priority_cut(df: DataFrame, n: int = 15) -> DataFrame:
    """O2: per date the higher class first, then the younger candle, then the larger volume ratio."""
    order = Window.partitionBy("scan_date").orderBy(F.desc("candle_class"), "day_type", F.desc("vol_ratio"), "code")
    return df.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= n)


def candle_sort(df: DataFrame) -> DataFrame:
    """O1."""
    return df.orderBy("day_type", F.desc("vol_ratio"), "code")


def scan_near_ma(bars, universe=None, target=None, min_turnover=500e8, lookback_days=400, min_bars=25, within=20):
    """A standard candle within the last bars but not today, and the close or low at the 15- or 20-bar mean."""
    if universe is not None:
        bars = bars.join(universe.select("code").distinct(), "code", "left_semi")
    base = numbered(bars if target is None else as_of(bars, target, lookback_days), lookback_days if target is None else None)
    flag = pat.standard_candle(min_turnover) & (F.col("n_bars") >= 2)
    f = base.withColumns({"ma15": ind.sma(15), "ma20": ind.sma(20), "ret": ind.daily_return(), "near15": pat.near_ma(15), "near20": pat.near_ma(20), "cand": flag})
    latest = F.last(F.when(F.col("cand"), F.struct("bar_no", "dt")), ignorenulls=True).over(ind.rows(Window.unboundedPreceding, -1))
    f = f.withColumns({"ref": F.when(F.col("bar_no") - latest["bar_no"] < within, latest), "up15": yes(F.col("ma15") > F.lag("ma15").over(series())), "up20": yes(F.col("ma20") > F.lag("ma20").over(series()))})
    if target is not None:
        f = last_bar(f)
    hit = (F.col("n_bars") >= min_bars) & F.col("ref").isNotNull() & ~F.col("cand") & (F.col("near15") | F.col("near20"))
    return f.where(hit).select(F.col("dt").alias("scan_date"), "code", F.col("close").cast("long").alias("close"), F.col("low").cast("long").alias("low"), F.round("ret", 6).alias("rate"), F.round("ma15", 6).alias("ma15"), F.round("ma20", 6).alias("ma20"), "near15", "near20", F.col("up15").alias("trend15_up"), F.col("up20").alias("trend20_up"), F.col("ref.dt").alias("ref_date"))
