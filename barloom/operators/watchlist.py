"""Signal watchlists and their follow-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions.indicators import series
from ..functions.patterns import yes
from ..functions.scalars import touch_list
from ..plans.features import as_of, last_bar, numbered
from .joins import dedup_first


def register_anchors(watchlist: DataFrame, picks: DataFrame, signal_date: str | None = None, order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Add the codes that the list doesn't hold yet; inside the batch the first row of a code wins.

    A code's first signal is final. signal_date None takes each pick's own scan_date.
    """
    day = F.col("scan_date") if signal_date is None else F.lit(signal_date).cast("date")
    new = dedup_first(picks, ["code"], list(order)).join(watchlist.select("code"), "code", "left_anti")
    rows = new.select("code", "name", day.alias("anchor_date"), F.col("close").cast("long").alias("anchor_close"), "pattern", F.lit("active").alias("status"))
    return watchlist.select("code", "name", "anchor_date", "anchor_close", "pattern", "status").unionByName(rows)


def bars_elapsed(bars: DataFrame, anchors: DataFrame) -> DataFrame:
    """bars of anchored codes after the anchor, with elapsed: bars since it, or days where it is no bar."""
    base = numbered(bars)
    at = base.select("code", F.col("dt").alias("anchor_date"), F.col("bar_no").alias("__anchor_no"))
    known = anchors.join(at, ["code", "anchor_date"], "left")
    joined = base.join(known, "code").where(F.col("dt") > F.col("anchor_date"))
    return joined.withColumn("elapsed", F.coalesce(F.col("bar_no") - F.col("__anchor_no"), F.datediff("dt", "anchor_date"))).drop("__anchor_no")


def scan_tracked_pullback(bars: DataFrame, watchlist: DataFrame, target: str | None = None, lookback_days: int = 400, max_days: int = 35, min_bars: int = 25, means: tuple[int, ...] = (5, 10, 15, 20)) -> DataFrame:
    """Anchored codes 1 to max_days days on, back at the first rising mean that fits."""
    listed = watchlist.groupBy("code").agg(F.collect_set("anchor_date").alias("__days"))
    known = bars.join(listed, "code")
    base = numbered(known if target is None else as_of(known, target, lookback_days), lookback_days if target is None else None)
    # The bars of anchor days so far, one a code as a rule, are carried along, so the anchor's number needs no second series.
    at = F.collect_list(F.when(F.array_contains("__days", F.col("dt")), F.struct("dt", "bar_no"))).over(ind.rows(Window.unboundedPreceding, 0))
    base = base.withColumn("__at", at) if target is None else base
    f = base.withColumns({f"m{n}": ind.sma(n) for n in means} | {"ret": ind.daily_return()})
    touched = F.lit(None).cast("int")
    for n in reversed(means):
        m, c = F.col(f"m{n}"), F.col("close")
        rests = ((c >= 0.975 * m) & (c <= 1.03 * m)) | ((F.col("low") <= 1.01 * m) & (c >= m))
        touched = F.when(yes(m > F.lag(m).over(series())) & yes(rests), F.lit(n)).otherwise(touched)
    f = f.withColumn("touched_ma", touched)
    if target is not None:
        f = last_bar(f)
    f = f.where((F.col("n_bars") >= min_bars) & F.col("touched_ma").isNotNull())
    hits = f.join(watchlist.select("code", "name", "anchor_date", "anchor_close"), "code").where(F.datediff("dt", "anchor_date").between(1, max_days))
    elapsed = F.datediff("dt", "anchor_date")
    if target is None:
        anchor = F.try_element_at(F.filter("__at", lambda a: a["dt"] == F.col("anchor_date")), F.lit(1))
        elapsed = F.coalesce(F.col("bar_no") - anchor["bar_no"], elapsed)
    return hits.select(F.col("dt").alias("scan_date"), "code", "name", F.col("close").cast("long").alias("close"), F.round("ret", 6).alias("rate"), "anchor_date", "anchor_close", elapsed.cast("int").alias("elapsed"), "touched_ma")


def append_tracked(fresh: DataFrame, tracked: DataFrame, keys: tuple[str, ...] = ("scan_date", "code")) -> DataFrame:
    """Fresh picks and the tracked ones that aren't among them."""
    return fresh.unionByName(tracked.join(fresh.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def previous_trading_day(bars: DataFrame, target: str, calendar_code: str) -> DataFrame:
    """One row: the last day before the target on which the calendar code has a bar."""
    return bars.where((F.col("code") == calendar_code) & (F.col("dt") < F.lit(target).cast("date"))).agg(F.max("dt").alias("previous_day"))


def review_previous_picks(bars: DataFrame, previous_picks: DataFrame, target: str | None = None, n: int = 12, lookback_days: int = 400, min_profit: float = 3.0) -> DataFrame:
    """yesterday's picks against today's bar: return, largest profit, lines and extremes touched, hit.

    target None reviews every date's picks at the code's next bar.
    """
    top = Window.partitionBy("scan_date", "strategy").orderBy(F.desc(F.abs("rate")), "code")
    chosen = previous_picks.where("match_type = 'predictive'").withColumn("__rn", F.row_number().over(top)).where(F.col("__rn") <= n)
    known = bars.join(chosen.select("code").distinct(), "code", "left_semi")
    low20, high20 = ind.prior_extremes(20)
    spans = (5, 10, 13, 20, 60, 120)
    base = numbered(known if target is None else as_of(known, target, lookback_days))
    f = base.withColumns({f"ma{k}": ind.sma(k) for k in spans} | {"low20": low20, "high20": high20, "c1": ind.back("close"), "d1": ind.back("dt")})
    if target is None:
        joined = f.join(chosen.withColumnsRenamed({"close": "pick_close", "rate": "pick_rate"}).withColumn("d1", F.col("scan_date")), ["code", "d1"])
    else:
        joined = last_bar(f).join(chosen.withColumnsRenamed({"close": "pick_close", "rate": "pick_rate"}), "code")
    lines = {f"{k}MA": F.col(f"ma{k}") for k in spans}
    profit = ind.percent(F.col("high"), F.col("c1"))
    extremes = F.concat(touch_list(F.col("low"), {"low20": F.col("low20")}, 0.018), touch_list(F.col("high"), {"high20": F.col("high20")}, 0.018))
    return joined.select("scan_date", F.col("dt").alias("review_date"), "strategy", "code", F.round(ind.percent(F.col("close"), F.col("c1")), 6).alias("day_return"), F.round(profit, 6).alias("max_profit"), F.concat_ws(", ", touch_list(F.col("low"), lines, 0.015)).alias("ma_touches"), F.concat_ws(", ", extremes).alias("extreme_touches"), yes(profit >= min_profit).alias("hit"))


def hit_split(review: DataFrame) -> DataFrame:
    """Hits, misses and the hit rate per strategy (A5)."""
    return review.groupBy("strategy").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_rate"))
