"""Queries of the bar store, the universe, indicators and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions import patterns as pat
from ..functions import scalars as sc
from ..functions.indicators import back
from ..operators import bars as store
from ..operators import universe as uni
from ..plans.features import features, numbered
from ..scratch import scratch_path, stored
from ..sources import readers, sinks
from ..sources.store import BarStore
from . import query
from .derived import FEATS, LISTING, MEANS, OVER, PANEL, WIDE, frame, lag_sql, listing, mean_sql, panel, projected_sql, table

BAR = ["code", "dt", "open", "high", "low", "close", "volume"]
TARGET = "1999-06-30"


def r6(name: str, col=None):
    return F.round(F.col(name) if col is None else col, 6).alias(name)


def spark_panel(spark, sf_dir, **cols):
    """code, dt and the given columns of all series, rounded if they are numbers."""
    f = numbered(panel(spark, sf_dir)).withColumns(cols)
    kinds = dict(f.dtypes)
    return f.select("code", "dt", *(r6(c) if kinds[c] == "double" else c for c in cols))


def panel_sql(**cols: str) -> str:
    return f"WITH {PANEL} SELECT code, dt, " + ", ".join(f"{x} AS {c}" for c, x in cols.items()) + " FROM bars"


def rounded(x: str) -> str:
    return f"round({x}, 6)"


@query(f"WITH {PANEL} SELECT * FROM bars WHERE dt BETWEEN DATE '{TARGET}' - 400 AND DATE '{TARGET}'")
def s1_read_bars_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written by month and read back through the date window."""
    path = scratch_path(spark, "bars")
    sinks.write_bars(panel(spark, sf_dir), path)
    return readers.read_bars_window(spark, path, TARGET)


FILLED = """code, CASE WHEN open = 0 OR open IS NULL THEN close ELSE open END AS open, CASE WHEN high = 0 OR high IS NULL THEN close ELSE high END AS high,
  CASE WHEN low = 0 OR low IS NULL THEN close ELSE low END AS low, close, coalesce(volume, 0) AS volume"""


@query(f"WITH {LISTING} SELECT {FILLED}, DATE '2002-01-02' AS dt FROM listing WHERE close > 0")
def s2_bars_from_listing(spark, sf_dir):
    return store.bars_from_listing(listing(spark, sf_dir), "2002-01-02")


BATCH = "SELECT code, dt, open, high, low, close + 1 AS close, volume FROM bars WHERE dt >= DATE '1999-01-01' AND dt < DATE '2000-01-01'"


@query(f"WITH {PANEL}, batch AS ({BATCH}) SELECT * FROM batch UNION ALL SELECT * FROM bars WHERE dt < DATE '1999-06-01'AND (code, dt) NOT IN (SELECT (code, dt) FROM batch)")
def s3_upsert_bars(spark, sf_dir):
    """A year's batch over a stored table: only the batch's months are read and written."""
    b = panel(spark, sf_dir)
    old = b.where("dt < date'1999-06-01'")
    new = b.where("dt >= date'1999-01-01' and dt < date'2000-01-01'").withColumn("close", F.col("close") + 1)
    twice = new.withColumn("seq", F.lit(2)).unionByName(new.withColumns({"close": F.col("close") + 5, "seq": F.lit(1)}))
    kept = BarStore(spark, scratch_path(spark, "store"))
    kept.upsert(old)
    kept.upsert(twice, "seq")
    return kept.read()


@query(f"WITH {PANEL} SELECT dt, count(*) AS n_bars, count(*) >= 9 AS complete FROM bars GROUP BY dt")
def s4_bars_complete(spark, sf_dir):
    return store.bars_complete(panel(spark, sf_dir), 9)


GAPS = f"""days AS (SELECT CAST(d AS DATE) AS dt FROM generate_series(DATE '{TARGET}' - 20, DATE '{TARGET}' - 1, INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6),
short AS (SELECT d.dt, count(b.code) AS n_bars FROM days d LEFT JOIN bars b ON b.dt = d.dt GROUP BY d.dt HAVING count(b.code) < 10),
missing AS (SELECT * FROM short WHERE (SELECT count(*) FROM short) <= 14)"""


@query(f"WITH {PANEL}, {GAPS} SELECT * FROM missing")
def s5_find_missing_days(spark, sf_dir):
    return store.find_missing_days(panel(spark, sf_dir), TARGET, max_gap_days=14, min_codes=10)


@query(
    f"""WITH {PANEL}, held AS (SELECT * FROM bars WHERE isodow(dt) NOT IN (2, 4) AND (isodow(dt) <> 1 OR code <= '000004')),
days AS (SELECT CAST(d AS DATE) AS dt FROM generate_series(DATE '{TARGET}' - 120, DATE '{TARGET}' - 1, INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6)
SELECT d.dt, count(h.code) AS n_bars FROM days d LEFT JOIN held h ON h.dt = d.dt GROUP BY d.dt HAVING count(h.code) < 10"""
)
def s5_find_missing_weekdays(spark, sf_dir):
    """A store without Tuesdays and Thursdays and with few codes on Mondays, looked at over 120 days."""
    b = panel(spark, sf_dir)
    held = b.where((~F.weekday("dt").isin(1, 3)) & ((F.weekday("dt") != 0) | (F.col("code") <= "000004")))
    return store.find_missing_days(held, TARGET, lookback_days=120, max_gap_days=86, min_codes=10)


HELD = "SELECT * FROM bars WHERE NOT (dt BETWEEN DATE '1999-06-14' AND DATE '1999-06-20' AND code > '000004')"


@query(
    f"""WITH {PANEL}, held AS ({HELD}), gaps AS (SELECT min(dt) AS a, max(dt) AS b FROM
  (SELECT d.dt FROM (SELECT CAST(d AS DATE) AS dt FROM generate_series(DATE '{TARGET}' - 20, DATE '{TARGET}' - 1, INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6) d
   LEFT JOIN held h ON h.dt = d.dt GROUP BY d.dt HAVING count(h.code) < 10))
SELECT * FROM held UNION ALL SELECT b.* FROM bars b, gaps g WHERE b.dt BETWEEN g.a AND g.b AND (b.code, b.dt) NOT IN (SELECT (code, dt) FROM held)"""
)
def s6_backfill_bars(spark, sf_dir):
    b = stored(panel(spark, sf_dir), "bars")
    held = b.where("not (dt between date'1999-06-14' and date'1999-06-20' and code > '000004')")
    return store.backfill_bars(held, b, b, store.find_missing_days(held, TARGET, max_gap_days=20, min_codes=10))


@query(f"WITH {PANEL} SELECT * FROM bars WHERE dt >= DATE '{TARGET}' - 430")
def s7_prune_bars(spark, sf_dir):
    """Expired months leave the store unread; the oldest kept one is rewritten."""
    kept = BarStore(spark, scratch_path(spark, "store"))
    kept.upsert(panel(spark, sf_dir))
    kept.prune(TARGET, 430)
    return kept.read()


@query(
    f"""WITH {LISTING}, kept AS (SELECT * FROM wide WHERE dt >= DATE '2002-01-02' - 430), today AS (SELECT {FILLED}, DATE '2002-01-02' AS dt FROM listing WHERE close > 0)
SELECT code, dt, open, high, low, close, volume FROM kept UNION ALL SELECT code, dt, open, high, low, close, volume FROM today"""
)
def s8_sync_bars(spark, sf_dir):
    """A store that the daily job prunes and completes in one commit."""
    b = panel(spark, sf_dir)
    kept = BarStore(spark, scratch_path(spark, "store"))
    kept.upsert(b)
    kept.sync(listing(spark, sf_dir), b, "2002-01-02")
    return kept.read()


CANDLE_LOG = f"WITH {PANEL} SELECT CAST(dt AS VARCHAR) AS date, code, close, volume FROM bars WHERE dt BETWEEN DATE '{TARGET}' - 20 AND DATE '{TARGET}'"


@query(CANDLE_LOG)
def s9_read_candle_log(spark, sf_dir):
    """NDJSON with bad lines and bad dates among the rows."""
    path = scratch_path(spark, "log")
    rows = panel(spark, sf_dir).where(F.col("dt") <= F.lit(TARGET).cast("date")).select(F.col("dt").cast("string").alias("date"), "code", "close", "volume")
    lines = rows.select(F.to_json(F.struct("*")).alias("value"))
    bad = rows.limit(2).select(F.lit("{broken").alias("value")).unionByName(rows.limit(2).select(F.lit('{"date":"soon","code":"x"}').alias("value")))
    lines.unionByName(bad).write.text(path)
    return readers.read_candle_log(spark, path, TARGET).select("date", "code", "close", "volume")


@query(CANDLE_LOG)
def s10_prune_candle_log(spark, sf_dir):
    log = readers.candle_log(spark, scratch_path(spark, "log"))
    log.replace(panel(spark, sf_dir).where(F.col("dt") <= F.lit(TARGET).cast("date")).select(F.col("dt").cast("string").alias("date"), "code", F.lit(None).cast("string").alias("name"), "close", "volume"))
    readers.prune_candle_log(log, TARGET)
    return log.read().drop("name")


RATE = "CASE WHEN abs(change) < 1 THEN change * 100 ELSE change END"
KEEP = "name NOT LIKE '%우' AND NOT regexp_matches(name, '우B|우C|스팩|리츠|레버리지|인버스|ETN|ETF|하이브리드')"


@query(f"WITH {LISTING} SELECT code, market, amount, close, round({RATE}, 6) AS rate FROM (SELECT * FROM listing WHERE market IN ('KOSPI', 'KOSDAQ', 'KOSDAQ GLOBAL') ORDER BY amount DESC, code LIMIT 50) WHERE close > 0")
def s12_top_universe(spark, sf_dir):
    return uni.top_universe(listing(spark, sf_dir), 50).select("code", "market", "amount", "close", r6("rate"))


@query(f"WITH {LISTING} SELECT code, name, market FROM listing WHERE market IN ('KOSPI', 'KOSDAQ') AND {KEEP}")
def s15_full_universe(spark, sf_dir):
    rows = listing(spark, sf_dir)
    return uni.full_universe(rows.where("market = 'KOSPI'"), rows.where("market = 'KOSDAQ'")).select("code", "name", "market")


def fallback_sql(least: float) -> str:
    return f"""WITH {LISTING}, full_list AS (SELECT code, name, market FROM listing WHERE market IN ('KOSPI', 'KOSDAQ') AND {KEEP}),
few AS (SELECT code, name, market FROM listing WHERE market IN ('KOSPI', 'KOSDAQ') AND {KEEP} AND volume * close >= {least})
SELECT * FROM few UNION ALL SELECT * FROM full_list WHERE (SELECT count(*) FROM few) = 0"""


def with_fallback(spark, sf_dir, least):
    full = uni.full_universe(uni.market_filter(listing(spark, sf_dir), ("KOSPI", "KOSDAQ")))
    few = uni.prefilter_turnover_change(full, least, -1e9)
    return uni.with_fallback(few, full).select("code", "name", "market")


@query(fallback_sql(20000.0))
def s15_universe_prefiltered(spark, sf_dir):
    return with_fallback(spark, sf_dir, 20000.0)


@query(fallback_sql(1e15))
def s15_universe_fallback(spark, sf_dir):
    """No listing passes the prefilter, so the full list is scanned."""
    return with_fallback(spark, sf_dir, 1e15)


@query(f"WITH {LISTING} SELECT code, market FROM listing WHERE market IN ('KOSPI', 'KOSDAQ', 'KOSDAQ GLOBAL')")
def p1_market_filter(spark, sf_dir):
    return uni.market_filter(listing(spark, sf_dir)).select("code", "market")


@query(f"WITH {LISTING} SELECT code, name FROM listing WHERE name IS NULL OR {KEEP}")
def p2_exclude_instruments(spark, sf_dir):
    return uni.exclude_instruments(listing(spark, sf_dir), null_is_excluded=False).select("code", "name")


PREFILTER = f"""WITH {LISTING}, m AS (SELECT *, volume * close >= {{t}} AS loose, coalesce({RATE} >= {{c}}, false) AS rises FROM listing),
k AS (SELECT count(*) AS n FROM m WHERE loose AND rises) SELECT code, close, volume, round(change, 6) AS change FROM m, k WHERE loose AND (rises OR n < 5)"""


@query(PREFILTER.format(t=20000.0, c=3.0))
def p3_prefilter_strict(spark, sf_dir):
    return uni.prefilter_turnover_change(listing(spark, sf_dir), 20000.0, 3.0).select("code", "close", "volume", r6("change"))


@query(PREFILTER.format(t=20000.0, c=1e6))
def p3_prefilter_fallback(spark, sf_dir):
    return uni.prefilter_turnover_change(listing(spark, sf_dir), 20000.0, 1e6).select("code", "close", "volume", r6("change"))


@query(f"WITH {LISTING} SELECT code, volume, close, round(change, 6) AS change FROM listing")
def p4_resolve_columns(spark, sf_dir):
    raw = listing(spark, sf_dir).select("code", F.col("volume").alias("AccVolume"), F.col("close").alias("LastSale"), F.col("change").alias("PctChange"))
    return uni.resolve_columns(raw).select("code", "volume", "close", r6("change"))


@query(f"WITH {LISTING} SELECT code, name, CAST(close AS BIGINT) AS close, coalesce(round_even(change, 2), 0) AS rate FROM listing")
def p12_latest_price_snapshot(spark, sf_dir):
    return uni.latest_price_snapshot(listing(spark, sf_dir))


@query("""SELECT event_id, d - greatest(isodow(d) - 5, 0)::INT AS day FROM (SELECT event_id, CAST(ts + INTERVAL 9 HOUR AS DATE) AS d FROM events)""")
def p14_trading_day_target(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", uni.trading_day_target(F.col("ts")).alias("day"))


CANDLE = f"coalesce(c1 IS NOT NULL AND close * volume >= 30000 AND close >= open * 1.09 AND high >= c1 * 1.15 AND high >= low * 1.15, false)"


@query(f"WITH {PANEL}, x AS (SELECT *, {lag_sql('close')} AS c1 FROM bars) SELECT code, dt, {CANDLE} AS candle FROM x")
def p5_standard_candle(spark, sf_dir):
    return spark_panel(spark, sf_dir, candle=pat.standard_candle(30000.0))


@query(
    f"""WITH {FEATS}, y AS (SELECT *, {projected_sql(5)} AS p5, {projected_sql(10)} AS p10, {projected_sql(20)} AS p20 FROM feats)
SELECT code, dt, coalesce(ma3 > ma5 AND ma5 > ma20, false) AS bullish, coalesce(close < p5 AND p5 < p10 AND p10 < p20 AND p20 < ma60 AND ma60 < ma120, false) AS reverse FROM y"""
)
def p6_ma_alignment(spark, sf_dir):
    bullish, reverse = pat.ma_alignment()
    return spark_panel(spark, sf_dir, bullish=bullish, reverse=reverse)


@query(
    f"""WITH {PANEL}, y AS (SELECT *, {projected_sql(5)} AS p5, {projected_sql(10)} AS p10, {projected_sql(20)} AS p20 FROM bars)
SELECT code, dt, coalesce(close >= p5 * 0.995, false) AS above5, coalesce(close >= p10 * 0.995, false) AS above10, coalesce(close >= p20 * 0.995, false) AS above20, coalesce((close - p10) / close > 0.08, false) AS stretched FROM y"""
)
def p7_ma_position_flags(spark, sf_dir):
    return spark_panel(spark, sf_dir, **pat.ma_position_flags())


def near_sql(x: str, m: str) -> str:
    return f"{x} BETWEEN {m} * (1 - 0.025) AND {m} * (1 + 0.025)"


@query(f"WITH {FEATS} SELECT code, dt, coalesce({near_sql('close', 'ma15')} OR {near_sql('low', 'ma15')}, false) AS near15, coalesce({near_sql('close', 'ma20')} OR {near_sql('low', 'ma20')}, false) AS near20 FROM feats")
def p8_near_ma(spark, sf_dir):
    return spark_panel(spark, sf_dir, near15=pat.near_ma(15), near20=pat.near_ma(20))


@query(
    f"""WITH {FEATS}, t AS (SELECT *, coalesce(high - greatest(open, close) >= 0.5 * abs(close - open) AND ({near_sql('high', 'ma60')} OR {near_sql('high', 'ma120')}), false) AS touch FROM feats)
SELECT code, dt, max(CAST(touch AS INT)) OVER {frame(10)} = 1 AS touched FROM t"""
)
def p9_upper_tail_touch(spark, sf_dir):
    f = numbered(panel(spark, sf_dir)).withColumn("tail_touch", pat.tail_touch_bar())
    return f.select("code", "dt", pat.upper_tail_touch().alias("touched"))


@query(f"WITH {FEATS} SELECT code, dt, coalesce(ma120 > close AND ma60 < close AND {near_sql('close', 'ma60')}, false) AS law FROM feats")
def p10_ma60_law_flag(spark, sf_dir):
    return spark_panel(spark, sf_dir, law=pat.ma60_law_flag())


@query(
    f"""WITH {FEATS}, l AS (SELECT *, max(high) OVER ({OVER} ROWS BETWEEN 21 PRECEDING AND 2 PRECEDING) AS peak, [ma5, ma20, ma60, ma120] AS m FROM feats)
SELECT code, dt, round(coalesce(list_filter(m, lambda x: x > 0 AND x <= close)[-1], low), 6) AS support,
  round(coalesce(list_filter(m, lambda x: x > close)[1], CASE WHEN peak > close THEN peak END, close * 1.1), 6) AS resistance FROM l"""
)
def p13_support_resistance(spark, sf_dir):
    f = features(panel(spark, sf_dir), keep_running=True).withColumn("peak", ind.extreme("high", 20, -2))
    s, r = pat.support_resistance_role({f"{n}MA": F.col(f"ma{n}") for n in (5, 20, 60, 120)}, F.col("close"), F.col("low"), F.col("peak"))
    return f.select("code", "dt", r6("support", s), r6("resistance", r))


@query(panel_sql(**{f"ma{n}": rounded(mean_sql("close", n)) for n in MEANS}))
def w1_sma(spark, sf_dir):
    return spark_panel(spark, sf_dir, **{f"ma{n}": ind.sma(n) for n in MEANS})


@query(panel_sql(v5=rounded(mean_sql("volume", 5)), v20=rounded(mean_sql("volume", 20))))
def w2_volume_sma(spark, sf_dir):
    return spark_panel(spark, sf_dir, v5=ind.volume_sma(5), v20=ind.volume_sma(20))


@query(f"WITH {FEATS} SELECT code, dt, round(ret, 6) AS ret, round(ret1, 6) AS ret1 FROM feats")
def w3_daily_return(spark, sf_dir):
    return spark_panel(spark, sf_dir, ret=ind.daily_return(), ret1=ind.daily_return(1))


@query(panel_sql(**{f"p{n}": rounded(projected_sql(n)) for n in (3, 5, 8, 10, 15, 20)}))
def w4_projected_sma(spark, sf_dir):
    return spark_panel(spark, sf_dir, **{f"p{n}": ind.projected_sma(n) for n in (3, 5, 8, 10, 15, 20)})


def up(a: str, b: str) -> str:
    return f"CASE WHEN {a} > {b} THEN 'up' ELSE 'down' END"


@query(panel_sql(s5=up(projected_sql(5), mean_sql("close", 5)), s20=up(projected_sql(20), mean_sql("close", 20)), c10=up(projected_sql(10), projected_sql(10, 1)), c60=up(mean_sql("close", 60), mean_sql("close", 60, -1))))
def w5_sma_trend(spark, sf_dir):
    return spark_panel(spark, sf_dir, s5=ind.sma_trend(5), s20=ind.sma_trend(20), c10=ind.sma_trend(10, "commentator"), c60=ind.sma_trend(60, "commentator"))


@query(f"WITH {FEATS} SELECT code, dt, round(CASE WHEN v20 > 0 THEN volume / v20 * 100 ELSE 100 END, 6) AS ratio FROM feats")
def w6_volume_ratio(spark, sf_dir):
    return spark_panel(spark, sf_dir, ratio=ind.volume_ratio())


@query(f"WITH {FEATS} SELECT code, dt, coalesce(v5 > v20, false) AS rises FROM feats")
def w7_volume_trend_up(spark, sf_dir):
    return spark_panel(spark, sf_dir, rises=ind.volume_trend_up())


@query(f"WITH {FEATS} SELECT code, dt, round(CASE WHEN ma5 > 0 THEN abs(ma3 - ma5) / ma5 * 100 ELSE 0 END, 6) AS disparity FROM feats")
def w8_ma_disparity(spark, sf_dir):
    return spark_panel(spark, sf_dir, disparity=ind.ma_disparity())


@query(panel_sql(high500=f"max(high) OVER ({OVER} ROWS BETWEEN 499 PRECEDING AND CURRENT ROW)", high400d=f"max(high) OVER ({OVER} RANGE BETWEEN INTERVAL 400 DAY PRECEDING AND CURRENT ROW)", n_bars=f"count(*) OVER ({OVER} RANGE BETWEEN INTERVAL 400 DAY PRECEDING AND CURRENT ROW)"))
def w9_window_high(spark, sf_dir):
    f = numbered(panel(spark, sf_dir), 400)
    return f.select("code", "dt", ind.window_high().alias("high500"), ind.window_high(lookback_days=400).alias("high400d"), "n_bars")


@query(panel_sql(low20=f"min(low) OVER ({OVER} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)", high20=f"max(high) OVER ({OVER} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"))
def w10_prior_extremes(spark, sf_dir):
    low20, high20 = ind.prior_extremes()
    return spark_panel(spark, sf_dir, low20=low20, high20=high20)


@query(panel_sql(peak=f"CASE WHEN row_number() OVER ({OVER}) >= 25 THEN max(high) OVER ({OVER} ROWS BETWEEN 21 PRECEDING AND 2 PRECEDING) END"))
def w11_former_peak_recent(spark, sf_dir):
    return spark_panel(spark, sf_dir, peak=ind.former_peak_recent())


@query(panel_sql(peak=f"CAST(max(high) OVER ({OVER} ROWS BETWEEN 60 PRECEDING AND 2 PRECEDING) AS BIGINT)"))
def w12_former_peak_ref(spark, sf_dir):
    return spark_panel(spark, sf_dir, peak=pat.former_peak_ref())


def breakout_sql(n: int, turnover: float = 20000.0, surge: float = 1.5) -> str:
    return f"coalesce(close > ma{n} AND c1 <= {lag_sql(f'ma{n}')} AND close * volume >= {turnover} AND volume >= {surge} * v20, false)"


@query(f"WITH {FEATS} SELECT code, dt, {', '.join(f'{breakout_sql(n)} AS b{n}' for n in (60, 120, 224))} FROM feats")
def w13_breakout_bar(spark, sf_dir):
    return spark_panel(spark, sf_dir, **{f"b{n}": pat.breakout_bar(n, 20000.0, 1.5) for n in (60, 120, 224)})


@query(f"WITH {FEATS}, x AS (SELECT *, {breakout_sql(60)} AS b FROM feats) SELECT code, dt, max(CASE WHEN b THEN bar_no END) OVER {frame(30)} AS last_no, bar_no FROM x", ints=("last_no", "bar_no"))
def w14_latest_flag_within(spark, sf_dir):
    f = numbered(panel(spark, sf_dir)).withColumn("b", pat.breakout_bar(60, 20000.0, 1.5))
    return f.select("code", "dt", pat.latest_flag_within(F.col("b"), [F.col("close")])["bar_no"].alias("last_no"), "bar_no")


@query(panel_sql(low58=f"min(low) OVER ({OVER} ROWS BETWEEN 60 PRECEDING AND 3 PRECEDING)"))
def w15_pre_breakout_low(spark, sf_dir):
    return spark_panel(spark, sf_dir, low58=pat.pre_breakout_low())


@query(
    f"""WITH {FEATS}, x AS (SELECT code, dt, bar_no, volume, {CANDLE} AS candle FROM feats), n AS (SELECT * FROM x WHERE candle)
SELECT x.code, x.dt, min(x.bar_no - n.bar_no) AS age FROM x JOIN n ON x.code = n.code AND n.bar_no BETWEEN x.bar_no - 15 AND x.bar_no
WHERE n.bar_no = x.bar_no OR x.bar_no - n.bar_no >= 3 OR x.volume < n.volume GROUP BY x.code, x.dt""",
    ints=("age",),
)
def w16_reference_candle_age(spark, sf_dir):
    f = numbered(panel(spark, sf_dir)).withColumn("candle", F.when(pat.standard_candle(30000.0), F.struct("bar_no", "volume")))
    ref = pat.reference_candle()
    return f.select("code", "dt", (F.col("bar_no") - ref["bar_no"]).alias("age")).where("age is not null")


@query(panel_sql(gap=f"coalesce(open > {lag_sql('close')}, false)"))
def w17_gap_up(spark, sf_dir):
    return spark_panel(spark, sf_dir, gap=pat.gap_up_after(F.col("open"), back("close")))


@query(panel_sql(weak=f"coalesce(({lag_sql('high', 1)} - {lag_sql('close', 2)}) / {lag_sql('close', 2)} * 100 < 3.5, false)"))
def w18_weak_rebound(spark, sf_dir):
    return spark_panel(spark, sf_dir, weak=pat.weak_rebound())


@query(panel_sql(drying=f"coalesce(avg(volume) OVER {frame(3)} < 0.6 * {lag_sql('volume', 3)}, false)"))
def w19_volume_drying(spark, sf_dir):
    f = numbered(panel(spark, sf_dir)).withColumn("cum", F.sum("volume").over(ind.rows(Window.unboundedPreceding, 0)))
    return f.select("code", "dt", pat.volume_drying(F.col("cum"), back("cum", 3), F.lit(3), back("volume", 3)).alias("drying"))


@query(
    f"""WITH {FEATS}, x AS (SELECT *, coalesce(ret >= 4 AND volume >= 2 * v20 AND close * volume >= 20000, false) AS base FROM feats),
y AS (SELECT *, max(CASE WHEN base THEN row(volume, bar_no) END) OVER {frame(30)} AS b FROM x)
SELECT code, dt, bar_no - b[2] AS days_ago, b[1] AS base_volume FROM y""",
    ints=("days_ago",),
)
def w22_base_candle_recent(spark, sf_dir):
    f = numbered(panel(spark, sf_dir)).withColumn("base", pat.base_candle_recent(20000.0))
    f = f.withColumn("b", F.max(F.when(F.col("base"), F.struct("volume", "bar_no"))).over(ind.rows(-29, 0)))
    return f.select("code", "dt", (F.col("bar_no") - F.col("b.bar_no")).alias("days_ago"), F.col("b.volume").alias("base_volume"))


@query(
    f"""WITH {FEATS}, x AS (SELECT *, coalesce(ret >= 4 AND volume >= 2 * v20 AND close * volume >= 20000, false) AS base FROM feats),
y AS (SELECT *, max(CASE WHEN base THEN row(volume, bar_no) END) OVER {frame(30)} AS b, CASE WHEN v20 > 0 THEN volume / v20 * 100 ELSE 100 END AS ratio FROM x),
z AS (SELECT *, coalesce(bar_no = b[2], false) OR coalesce(ret >= 4 AND ratio >= 180, false) AS fresh, b IS NOT NULL AND coalesce(volume < b[1], false) AS dry FROM y)
SELECT code, dt, CASE WHEN fresh THEN 'base_today' WHEN dry THEN 'dry_pullback' ELSE 'steady' END AS state, round(CASE WHEN NOT fresh AND dry THEN (1 - volume / b[1]) * 100 END, 6) AS drop FROM z"""
)
def w23_volume_state(spark, sf_dir):
    f = features(panel(spark, sf_dir), keep_running=True).withColumns({"base": pat.base_candle_recent(20000.0), "ratio": ind.volume_ratio()})
    f = f.withColumn("b", F.max(F.when(F.col("base"), F.struct("volume", "bar_no"))).over(ind.rows(-29, 0)))
    state, drop = pat.volume_state(F.col("bar_no") - F.col("b.bar_no"), F.col("b.volume"), F.col("ret"), F.col("ratio"))
    return f.select("code", "dt", state.alias("state"), r6("drop", drop))


def strong_sql(k: int) -> str:
    b = lambda x: lag_sql(x, k) if k else x
    return f"coalesce({b('ret')} >= 5 AND {b('ret')} <= 25 AND {b('close')} > {b('open')} AND {b('volume')} >= 2.5 * {b('v20')}, false)"


def pattern3_sql(k: int) -> str:
    held = [f"coalesce(close >= 0.99 * {lag_sql('close', k)}, false)"]
    held += [f"coalesce({lag_sql('close', b)} >= 0.98 * {lag_sql('ma10', b)} AND {lag_sql('close', b)} >= 0.99 * {lag_sql('close', k)}, false)" for b in range(1, k)]
    return f"WHEN {strong_sql(k)} AND {' AND '.join(held)} THEN 3"


@query(f"WITH {FEATS} SELECT code, dt, CASE WHEN {strong_sql(0)} AND coalesce(high - close >= 0.75 * (close - open), false) THEN 2 {' '.join(map(pattern3_sql, (2, 3, 4)))} ELSE 1 END AS pattern FROM feats")
def w25_sub_pattern(spark, sf_dir):
    return features(panel(spark, sf_dir)).select("code", "dt", pat.sub_pattern().alias("pattern"))


def completed_sql(k: int) -> str:
    held = [f"coalesce({lag_sql('close')} >= 0.99 * {lag_sql('close', k)}, false)"]
    held += [f"coalesce({lag_sql('close', b)} >= 0.98 * {lag_sql('ma10', b)} AND {lag_sql('close', b)} >= 0.99 * {lag_sql('close', k)}, false)" for b in range(2, k)]
    return f"WHEN {strong_sql(k)} AND {' AND '.join(held)} THEN 3"


RESTED = f"coalesce({lag_sql('low')} <= 1.025 * {lag_sql('ma5')} AND {lag_sql('close')} >= 0.995 * {lag_sql('ma5')} AND {lag_sql('low')} >= {lag_sql('low', 2)} AND close >= 1.04 * open, false)"
TAIL2 = f"coalesce({lag_sql('high', 2)} - {lag_sql('close', 2)} >= 0.75 * ({lag_sql('close', 2)} - {lag_sql('open', 2)}), false)"


@query(f"WITH {FEATS} SELECT code, dt, CASE WHEN NOT {RESTED} THEN 1 WHEN {strong_sql(2)} AND {TAIL2} THEN 2 {' '.join(map(completed_sql, (3, 4, 5)))} ELSE 1 END AS pattern FROM feats")
def w26_sub_pattern_completed(spark, sf_dir):
    return features(panel(spark, sf_dir)).select("code", "dt", pat.sub_pattern_completed().alias("pattern"))


@query(f"WITH {PANEL} SELECT dt, count(*) AS n_bars FROM bars GROUP BY dt")
def a1_bars_per_date(spark, sf_dir):
    return store.bars_per_date(panel(spark, sf_dir))


@query(f"WITH {WIDE} SELECT code, count(*) AS n_bars FROM wide GROUP BY code")
def a2_bars_per_code(spark, sf_dir):
    return store.bars_per_code(panel(spark, sf_dir))


@query("SELECT o_orderkey, round(CASE WHEN v IS NULL OR v = 0 THEN 5.0 ELSE v END, 6) AS v FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_totalprice AS DOUBLE) END AS v FROM orders)")
def x1_falsy_default(spark, sf_dir):
    v = F.when(F.col("o_orderkey") % 3 == 0, 0.0).when(F.col("o_orderkey") % 5 == 0, F.lit(None).cast("double")).otherwise(F.col("o_totalprice").cast("double"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(sc.falsy_default(v, F.lit(5.0)), 6).alias("v"))


@query("SELECT c_custkey, CASE WHEN length(k) < 6 THEN lpad(k, 6, '0') ELSE k END AS code FROM (SELECT c_custkey, CAST(CAST(c_custkey AS BIGINT) * 977 AS VARCHAR) AS k FROM customer)")
def x2_pad_code(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", sc.pad_code((F.col("c_custkey").cast("long") * 977).cast("string")).alias("code"))


@query("SELECT o_orderkey, CASE WHEN abs(v) < 1 THEN v * 100 ELSE v END AS rate FROM (SELECT o_orderkey, (o_orderkey % 400 - 200) / 100.0::DOUBLE AS v FROM orders)")
def x3_scale_change(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", sc.scale_change((F.col("o_orderkey") % 400 - 200) / F.lit(100.0)).alias("rate"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def x4_parse_two_date_formats(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format(d, "yyyyMMdd")).otherwise("soon")
    return table(spark, sf_dir, "orders").select("o_orderkey", sc.parse_two_date_formats(text).alias("day"))


@query("SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '(20\\d{2})', 1), '') AS INT) AS year FROM documents")
def x6_parse_year(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sc.parse_year(F.col("text")).alias("year"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE v END AS amount, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE v * 100000000 END AS base FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders)")
def x7_parse_amount(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 7 == 0, "N/A").otherwise(F.format_number(F.floor("o_totalprice"), 0))
    amount = sc.parse_amount(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", amount.cast("long").alias("amount"), sc.to_base_unit(amount).alias("base"))


@query("SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * 1000000 AS base FROM orders")
def x8_to_base_unit(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", sc.to_base_unit(F.floor("o_totalprice"), 1_000_000).alias("base"))


@query(f"WITH {PANEL} SELECT code, dt, CAST(list_sum(list_transform(string_split(code, ''), lambda x: ascii(x))) AS BIGINT) + CAST(close AS BIGINT) % 997 AS seed FROM bars")
def x9_code_seed(spark, sf_dir):
    return panel(spark, sf_dir).select("code", "dt", sc.code_seed(F.col("code"), F.col("close")).alias("seed"))


@query("SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN '' ELSE base64(encode(text)) END AS enc FROM documents")
def x11_encode_b64(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sc.encode_b64(F.col("text")).alias("enc"))
