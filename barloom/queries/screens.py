"""Queries of the scans, follow-up, joins, ranking and retention."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import indicators as ind
from ..functions.indicators import back
from ..functions.scalars import touch_list
from ..operators import asof, charts, joins, ranking, scans, watchlist
from ..plans.features import numbered
from ..scratch import scratch_path, stored
from ..sources.state import CodeState, last_features
from ..sources.store import DatedStore
from . import query
from .bars import CANDLE, breakout_sql, near_sql
from .derived import CODE, DENSE, FEATS, LISTING, OVER, PANEL, THEMES, dense, frame, lag_sql, listing, mean_sql, panel, projected_sql, supplier_code, table, themes

RATE = "round(ret, 6) AS rate"


def pick_sql(where: str, strategy: str, pattern: str = "'Pattern 1'", source: str = "feats") -> str:
    return f"SELECT dt AS scan_date, '{strategy}' AS strategy, code, CAST(close AS BIGINT) AS close, {RATE}, 'predictive' AS match_type, {pattern} AS pattern FROM {source} WHERE {where}"


C1 = pick_sql("n_bars >= 224 AND v20 > 0 AND volume >= 1.2 * v20", "yey")
C3 = pick_sql("n_bars >= 125 AND ma120 > 0.99 * close AND low <= 1.025 * ma60 AND close >= 0.985 * ma60", "ma60_rule", "'60일의 법칙'")
C4 = pick_sql("n_bars >= 140 AND ret1 BETWEEN 4 AND 300 AND c1 > o1 AND vol1 >= 1.2 * v20_1 AND close < open AND volume <= 0.75 * vol1", "podosi_yey")
C5 = pick_sql("n_bars >= 130 AND ret >= 6 AND ret < 300 AND close > open AND volume >= 1.5 * v20 AND close * volume >= 0 AND close >= ma20", "v2")


def c1(spark, sf_dir):
    return scans.scan_volume_surge(panel(spark, sf_dir), lookback_days=None)


def c5(spark, sf_dir):
    return scans.scan_strong_candle(panel(spark, sf_dir), lookback_days=None, high=300.0, surge=1.5, min_turnover=0.0)


@query(f"WITH {FEATS} {C1}")
def c1_scan_volume_surge(spark, sf_dir):
    return c1(spark, sf_dir)


MASKED = f"""{PANEL},
g0 AS (SELECT *, count(*) OVER ({OVER} RANGE BETWEEN INTERVAL 400 DAY PRECEDING AND CURRENT ROW) AS n_bars, (close - {lag_sql('close')}) / {lag_sql('close')} * 100 AS ret, {mean_sql('volume', 20)} AS v20, {mean_sql('close', 60)} AS ma60, {mean_sql('close', 120)} AS ma120 FROM bars)"""


@query(f"WITH {MASKED} " + pick_sql("n_bars >= 224 AND v20 > 0 AND volume >= 1.2 * v20", "yey", source="g0"))
def c1_scan_volume_surge_400_days(spark, sf_dir):
    """Panel mode with the slice of 400 days that each date would load."""
    return scans.scan_volume_surge(panel(spark, sf_dir))


LAST = "(SELECT max(dt) FROM bars)"


@query(
    f"""WITH {PANEL}, cut AS (SELECT * FROM bars WHERE dt BETWEEN {LAST} - 400 AND {LAST}),
f AS (SELECT *, row_number() OVER ({OVER}) AS n_bars, (close - {lag_sql('close')}) / {lag_sql('close')} * 100 AS ret, {mean_sql('volume', 20)} AS v20, row_number() OVER (PARTITION BY code ORDER BY dt DESC) AS rn FROM cut)
SELECT {LAST} AS scan_date, 'yey' AS strategy, code, CAST(close AS BIGINT) AS close, {RATE}, 'predictive' AS match_type, 'Pattern 1' AS pattern FROM f WHERE rn = 1 AND n_bars >= 30 AND v20 > 0 AND volume >= 0.5 * v20"""
)
def c1_scan_as_of(spark, sf_dir):
    """As-of mode at the newest date, a gate of 30 bars and half the usual volume."""
    b = panel(spark, sf_dir)
    day = b.agg(F.max("dt")).first()[0]
    return scans.scan_volume_surge(b, target=str(day or "2001-01-01"), min_bars=30, surge=0.5)


RETEST = f"""x AS (SELECT *, {', '.join(f"{breakout_sql(n)} AS x{n}" for n in (60, 120, 224))}, min(low) OVER ({OVER} ROWS BETWEEN 60 PRECEDING AND 3 PRECEDING) AS low60 FROM feats),
y AS (SELECT *, {', '.join(f"max(CASE WHEN x{n} THEN row(bar_no, low60) END) OVER {frame(30)} AS b{n}" for n in (60, 120, 224))} FROM x),
z AS (SELECT *, CASE
 WHEN b120 IS NOT NULL AND ma120 > ma60 AND low >= b120[2] * 0.975 AND close >= 0.95 * ma60 AND close <= 1.05 * ma120 THEN 'Pattern 1'
 WHEN b60 IS NOT NULL AND ma60 > ma20 AND low >= b60[2] * 0.975 AND close >= 0.95 * ma20 AND close <= 1.05 * ma60 THEN 'Pattern 2'
 WHEN b224 IS NOT NULL AND ma224 > ma120 AND low >= b224[2] * 0.975 AND close >= 0.95 * ma120 AND close <= 1.05 * ma224 THEN 'Pattern 3' END AS pattern FROM y)"""
C2 = "n_bars >= {gate} AND win_high >= 1.0 * close AND ma5 > ma20 AND (ma5 >= ma5_1 OR ma20 >= ma20_1) AND pattern IS NOT NULL"
EASY = {"high_factor": 1.0, "breakout_turnover": 20000.0, "breakout_surge": 1.5}


@query(f"WITH {FEATS}, {RETEST} {pick_sql(C2.format(gate=224), 'podosi', 'pattern', 'z')}")
def c2_scan_breakout_retest(spark, sf_dir):
    return scans.scan_breakout_retest(panel(spark, sf_dir), lookback_days=None, **EASY)


def as_of_sql(days: int, pick: str, source: str = "feats", more: str = "") -> str:
    """The picks of the last bars in the slice of days up to the newest date; pick reads from lastrow."""
    cut = f"bars AS (SELECT * FROM allbars WHERE dt BETWEEN (SELECT max(dt) FROM allbars) - {days} AND (SELECT max(dt) FROM allbars)),\nf0 AS ("
    feats = FEATS.replace("bars AS ", "allbars AS ", 1).replace("f0 AS (", cut, 1)
    return f"WITH {feats}{more}, lastrow AS (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY code ORDER BY dt DESC) = 1) SELECT * REPLACE ({LAST} AS scan_date) FROM ({pick})"


def newest(bars):
    return str(bars.agg(F.max("dt")).first()[0] or "2001-01-01")


@query(as_of_sql(1200, pick_sql(C2.format(gate=130), "podosi", "pattern", "lastrow"), "z", ", " + RETEST))
def c2_scan_as_of(spark, sf_dir):
    b = panel(spark, sf_dir)
    return scans.scan_breakout_retest(b, target=newest(b), lookback_days=1200, min_bars=130, **EASY)


@query(as_of_sql(1200, C3.replace("FROM feats", "FROM lastrow")))
def c3_scan_as_of(spark, sf_dir):
    b = panel(spark, sf_dir)
    return scans.scan_ma60_rule(b, target=newest(b), lookback_days=1200)


@query(as_of_sql(400, C4.replace("FROM feats", "FROM lastrow").replace("n_bars >= 140", "n_bars >= 30")))
def c4_scan_as_of(spark, sf_dir):
    b = panel(spark, sf_dir)
    return scans.scan_surge_then_rest(b, target=newest(b), min_bars=30, high=300.0, surge=1.2)


@query(as_of_sql(400, C5.replace("FROM feats", "FROM lastrow").replace("n_bars >= 130", "n_bars >= 30")))
def c5_scan_as_of(spark, sf_dir):
    b = panel(spark, sf_dir)
    return scans.scan_strong_candle(b, target=newest(b), min_bars=30, high=300.0, surge=1.5, min_turnover=0.0)


FROM_STATE = {
    "c1": pick_sql("n_bars >= 30 AND v20 > 0 AND volume >= 0.5 * v20", "yey", source="lastrow"),
    "c2": pick_sql(C2.format(gate=130), "podosi", "pattern", "lastrow"),
    "c3": C3.replace("FROM feats", "FROM lastrow"),
    "c4": C4.replace("FROM feats", "FROM lastrow").replace("n_bars >= 140", "n_bars >= 30"),
    "c5": C5.replace("FROM feats", "FROM lastrow").replace("n_bars >= 130", "n_bars >= 30"),
}
ALL_OF_STATE = as_of_sql(400, " UNION ALL ".join(FROM_STATE.values()), "z", ", " + RETEST)


def advanced(spark, sf_dir, bars):
    """A state of 400 days from the bars of all but the newest day, then advanced by that day; with its date."""
    kept = CodeState(spark, scratch_path(spark, "state"))
    days = sorted(r["dt"] for r in bars.select("dt").distinct().orderBy(F.desc("dt")).limit(2).collect())
    for i, day in enumerate(days):
        # the first batch has wrong bars of its newest day, which the second corrects
        batch = bars.where(F.col("dt") <= F.lit(day)).withColumn("close", F.when(F.col("dt") < F.lit(day), F.col("close")).otherwise(0.0)) if i == 0 else bars.where(F.col("dt").between(F.lit(days[i - 1]), F.lit(day)))
        kept.advance(batch, str(day))
    return kept.read(), str(days[-1] if days else "2001-01-01")


def scans_of_state(spark, sf_dir, bars):
    state, day = advanced(spark, sf_dir, bars)
    f = last_features(state, day, breakout_turnover=EASY["breakout_turnover"], breakout_surge=EASY["breakout_surge"])
    found = scans.scan_volume_surge(f, target=day, min_bars=30, surge=0.5)
    found = found.unionByName(scans.scan_breakout_retest(f, target=day, min_bars=130, **EASY))
    found = found.unionByName(scans.scan_ma60_rule(f, target=day))
    found = found.unionByName(scans.scan_surge_then_rest(f, target=day, min_bars=30, high=300.0, surge=1.2))
    return found.unionByName(scans.scan_strong_candle(f, target=day, min_bars=30, high=300.0, surge=1.5, min_turnover=0.0))


@query(ALL_OF_STATE)
def c1_c5_from_state(spark, sf_dir):
    """All five scans as of the newest date from a state that daily batches advanced."""
    return scans_of_state(spark, sf_dir, panel(spark, sf_dir))


@query(ALL_OF_STATE.replace(PANEL.replace("bars AS ", "allbars AS ", 1), DENSE.replace("dense AS ", "allbars AS ", 1)))
def c1_c5_from_state_dense(spark, sf_dir):
    """The same of series with a bar nearly every day."""
    return scans_of_state(spark, sf_dir, dense(spark, sf_dir))


def slices_sql(pick: str, more: str = "", source: str = "feats") -> str:
    """The picks of each code's last bar of each month, from slices of 400 days cut for each; pick reads from lastrow."""
    cut = f"""{DENSE},
ends AS (SELECT code, max(dt) AS day FROM dense GROUP BY code, date_trunc('month', dt)),
bars AS (SELECT e.code || ' ' || strftime(e.day, '%Y-%m-%d') AS code, dt, open, high, low, close, volume FROM ends e JOIN dense b ON b.code = e.code AND b.dt BETWEEN e.day - 400 AND e.day),
f0 AS ("""
    feats = cut + FEATS.partition("f0 AS (")[2]
    return f"WITH {feats}{more}, lastrow AS (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY code ORDER BY dt DESC) = 1) SELECT * REPLACE (split_part(code, ' ', 1) AS code) FROM ({pick})"


def at_month_ends(spark, sf_dir, scan, **settings):
    """A scan of every date over slices of 400 days, at each code's last bar of each month."""
    d = dense(spark, sf_dir)
    ends = d.groupBy("code", F.trunc("dt", "month")).agg(F.max("dt").alias("scan_date")).select("code", "scan_date")
    return scan(d, **settings).join(ends, ["code", "scan_date"], "left_semi")


@query(slices_sql(C1.replace("FROM feats", "FROM lastrow")))
def c1_scan_at_month_ends(spark, sf_dir):
    """With the gate of 224 bars and a slice that holds about 240."""
    return at_month_ends(spark, sf_dir, scans.scan_volume_surge)


@query(slices_sql(pick_sql(C2.format(gate=224), "podosi", "pattern", "lastrow"), ", " + RETEST, "z"))
def c2_scan_at_month_ends(spark, sf_dir):
    return at_month_ends(spark, sf_dir, scans.scan_breakout_retest, **EASY)


@query(slices_sql(C3.replace("FROM feats", "FROM lastrow")))
def c3_scan_at_month_ends(spark, sf_dir):
    return at_month_ends(spark, sf_dir, scans.scan_ma60_rule)


@query(slices_sql(C4.replace("FROM feats", "FROM lastrow")))
def c4_scan_at_month_ends(spark, sf_dir):
    return at_month_ends(spark, sf_dir, scans.scan_surge_then_rest, high=300.0, surge=1.2)


@query(slices_sql(C5.replace("FROM feats", "FROM lastrow")))
def c5_scan_at_month_ends(spark, sf_dir):
    return at_month_ends(spark, sf_dir, scans.scan_strong_candle, high=300.0, surge=1.5, min_turnover=0.0)


@query(f"WITH {FEATS} {C3}")
def c3_scan_ma60_rule(spark, sf_dir):
    return scans.scan_ma60_rule(panel(spark, sf_dir), lookback_days=None)


@query(f"WITH {FEATS} {C4}")
def c4_scan_surge_then_rest(spark, sf_dir):
    return scans.scan_surge_then_rest(panel(spark, sf_dir), lookback_days=None, high=300.0, surge=1.2)


@query(f"WITH {FEATS} {C5}")
def c5_scan_strong_candle(spark, sf_dir):
    return c5(spark, sf_dir)


def candle_sql(label: int, turnover: float) -> str:
    """Candle picks of one class from joins of bars with earlier candles."""
    flag = CANDLE.replace("30000", str(turnover))
    n = f"n{label}"
    return f"""{n} AS (SELECT code, bar_no, volume, close, dt, peak, cum FROM w WHERE {flag}),
r{label} AS (SELECT w.code, w.bar_no, max(n.bar_no) FILTER (WHERE n.bar_no < w.bar_no) AS older, max(n.bar_no) FILTER (WHERE n.bar_no = w.bar_no) AS today
  FROM w JOIN {n} n ON n.code = w.code AND n.bar_no BETWEEN w.bar_no - 15 AND w.bar_no
  WHERE n.bar_no = w.bar_no OR w.bar_no - n.bar_no >= 3 OR w.volume < n.volume GROUP BY w.code, w.bar_no),
p{label} AS (SELECT w.dt AS scan_date, {label} AS candle_class, w.code, w.bar_no - n.bar_no AS day_type, CAST(w.close AS BIGINT) AS close, CAST(w.low AS BIGINT) AS low, n.peak AS former_peak, round(w.ret, 6) AS rate,
  round(CASE WHEN w.v20 > 0 THEN w.volume / w.v20 * 100 ELSE 100 END, 6) AS vol_ratio, round(w.volume / n.volume * 100, 6) AS vol_change_ratio, round(CASE WHEN w.ma5 > 0 THEN abs(w.ma3 - w.ma5) / w.ma5 * 100 ELSE 0 END, 6) AS ma3_ma5_disparity,
  coalesce(w.v5 > w.v20, false) AS vol_trend_up, w.bar_no > n.bar_no AND (w.cum - n.cum) / (w.bar_no - n.bar_no) < 0.6 * n.volume AS vol_drying_ok,
  coalesce(w.ma3 > w.ma5 AND w.ma5 > w.ma20, false) AS is_bullish_alignment, (w.bar_no - n.bar_no = 1 AND w.open > n.close) OR (w.bar_no - n.bar_no = 2 AND w.o1 > n.close) AS is_gap_up,
  w.bar_no - n.bar_no = 2 AND w.weak AS has_weak_ma3_rebound, n.dt AS ref_date, round(w.p3, 6) AS p3, round(w.p8, 6) AS p8, {', '.join(f"CASE WHEN coalesce(w.p{k} > w.ma{k}, false) THEN 'up' ELSE 'down' END AS t{k}" for k in (3, 5, 8, 20))}
  FROM w JOIN r{label} r USING (code, bar_no) JOIN {n} n ON n.code = w.code AND n.bar_no = coalesce(r.today, r.older)
  WHERE w.n_bars >= 80 AND (w.bar_no - n.bar_no < 3 OR {near_sql('w.close', 'w.ma15')} OR {near_sql('w.low', 'w.ma15')} OR {near_sql('w.close', 'w.ma20')} OR {near_sql('w.low', 'w.ma20')}))"""


W = f"""{FEATS}, w AS (SELECT *, CAST(max(high) OVER ({OVER} ROWS BETWEEN 60 PRECEDING AND 2 PRECEDING) AS BIGINT) AS peak, sum(volume) OVER ({OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
  coalesce(({lag_sql('high', 1)} - {lag_sql('close', 2)}) / {lag_sql('close', 2)} * 100 < 3.5, false) AS weak, {projected_sql(3)} AS p3, {projected_sql(5)} AS p5, {projected_sql(8)} AS p8, {projected_sql(20)} AS p20 FROM feats)"""


#: Of every bar the pivots of the last 40 bars: three highest near or below the close, and the line of the last two.
PIVOTS = f"""v AS (SELECT *, row_number() OVER ({OVER}) AS bar_no, lag(low, 1) OVER ({OVER}) AS a1, lag(low, 2) OVER ({OVER}) AS a2, lead(low, 1) OVER ({OVER}) AS z1, lead(low, 2) OVER ({OVER}) AS z2 FROM bars),
five AS (SELECT * FROM v WHERE low < a1 AND low < a2 AND low < z1 AND low < z2), three AS (SELECT * FROM v WHERE low < a1 AND low < z1),
sup AS (SELECT v.code, v.dt, coalesce(list(p.low ORDER BY p.low DESC) FILTER (WHERE p.low < v.close * 1.01), [])[1:3] AS h_supports FROM v LEFT JOIN five p ON p.code = v.code AND p.bar_no BETWEEN v.bar_no - 37 AND v.bar_no - 2 GROUP BY v.code, v.dt),
l AS (SELECT v.code, v.dt, v.bar_no, list(row(p.bar_no, p.low) ORDER BY p.bar_no DESC) AS r FROM v JOIN three p ON p.code = v.code AND p.bar_no BETWEEN v.bar_no - 37 AND v.bar_no - 2 GROUP BY v.code, v.dt, v.bar_no),
line AS (SELECT code, dt, round_even(r[1][2] + (r[1][2] - r[2][2]) / (r[1][1] - r[2][1]) * (bar_no - r[1][1]), 0) AS trendline_support FROM l WHERE len(r) >= 2 AND r[1][2] > r[2][2])"""
SUPPORTED = "SELECT p.*, sup.h_supports, line.trendline_support FROM {} p JOIN sup ON sup.code = p.code AND sup.dt = p.scan_date LEFT JOIN line ON line.code = p.code AND line.dt = p.scan_date"


def flat(df):
    return df.withColumns({"p3": F.round("expected_ma.ma3", 6), "p8": F.round("expected_ma.ma8", 6)} | {f"t{n}": F.col(f"expected_ma.ma{n}_trend") for n in (3, 5, 8, 20)}).drop("expected_ma")


@query(f"WITH {W}, {candle_sql(500, 30000.0)}, {PIVOTS} {SUPPORTED.format('p500')}", ints=("day_type",))
def c6_scan_standard_candle(spark, sf_dir):
    return flat(scans.scan_standard_candle(panel(spark, sf_dir), min_turnover=30000.0, lookback_days=None))


@query(
    f"""WITH {W}, {candle_sql(500, 60000.0)}, {candle_sql(150, 30000.0)}, {PIVOTS},
u AS (SELECT * FROM p500 UNION ALL SELECT * FROM p150 WHERE (scan_date, code) NOT IN (SELECT (scan_date, code) FROM p500)),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_date ORDER BY candle_class DESC, day_type, vol_ratio DESC, code) AS pos FROM u) WHERE pos <= 3)
{SUPPORTED.format('k')}""",
    ints=("day_type", "pos"),
)
def c7_scan_integrated(spark, sf_dir):
    return flat(scans.scan_integrated(panel(spark, sf_dir), high_turnover=60000.0, low_turnover=30000.0, n=3, lookback_days=None))


@query(
    f"""WITH {FEATS}, x AS (SELECT *, {CANDLE} AS cand FROM feats), y AS (SELECT *, max(CASE WHEN cand THEN dt END) OVER ({OVER} ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING) AS ref_date,
  coalesce({near_sql('close', 'ma15')} OR {near_sql('low', 'ma15')}, false) AS near15, coalesce({near_sql('close', 'ma20')} OR {near_sql('low', 'ma20')}, false) AS near20,
  coalesce(ma15 > {lag_sql('ma15')}, false) AS trend15_up, coalesce(ma20 > {lag_sql('ma20')}, false) AS trend20_up FROM x)
SELECT dt AS scan_date, code, CAST(close AS BIGINT) AS close, CAST(low AS BIGINT) AS low, {RATE}, round(ma15, 6) AS ma15, round(ma20, 6) AS ma20, near15, near20, trend15_up, trend20_up, ref_date
FROM y WHERE n_bars >= 25 AND ref_date IS NOT NULL AND NOT cand AND (near15 OR near20)"""
)
def c8_scan_near_ma(spark, sf_dir):
    return scans.scan_near_ma(panel(spark, sf_dir), min_turnover=30000.0, lookback_days=None)


ANCHORS = f"SELECT code, min(scan_date) AS anchor_date, arg_min(close, scan_date) AS anchor_close FROM ({C1}) GROUP BY code"


def anchors(spark, sf_dir):
    """Every code's first volume surge, as a watchlist."""
    picks = c1(spark, sf_dir).withColumn("name", F.concat(F.lit("n"), "code")).withColumn("pos", F.datediff("scan_date", F.lit("1970-01-01").cast("date")))
    none = spark.createDataFrame([], "code string, name string, anchor_date date, anchor_close bigint, pattern string, status string")
    return watchlist.register_anchors(none, picks)


@query(f"WITH {FEATS} SELECT code, 'n' || code AS name, anchor_date, anchor_close, 'Pattern 1' AS pattern, 'active' AS status FROM ({ANCHORS})")
def j10_register_anchors(spark, sf_dir):
    return anchors(spark, sf_dir)


def rests(n: int) -> str:
    m = f"ma{n}"
    return f"WHEN {m} > {lag_sql(m)} AND ((close >= 0.975 * {m} AND close <= 1.03 * {m}) OR (low <= 1.01 * {m} AND close >= {m})) THEN {n}"


@query(
    f"""WITH {FEATS}, a AS ({ANCHORS}), t AS (SELECT *, CASE {' '.join(map(rests, (5, 10, 15, 20)))} END AS touched_ma FROM feats)
SELECT t.dt AS scan_date, t.code, 'n' || t.code AS name, CAST(t.close AS BIGINT) AS close, round(t.ret, 6) AS rate, a.anchor_date, a.anchor_close, CAST(t.bar_no - b.bar_no AS INT) AS elapsed, t.touched_ma
FROM t JOIN a ON a.code = t.code JOIN feats b ON b.code = a.code AND b.dt = a.anchor_date WHERE t.n_bars >= 25 AND t.touched_ma IS NOT NULL AND t.dt - a.anchor_date BETWEEN 1 AND 35"""
)
def c9_scan_tracked_pullback(spark, sf_dir):
    return watchlist.scan_tracked_pullback(panel(spark, sf_dir), stored(anchors(spark, sf_dir), "anchors"), lookback_days=None)


@query(f"WITH {FEATS}, a AS ({ANCHORS}) SELECT t.code, t.dt, CAST(t.bar_no - b.bar_no AS INT) AS elapsed FROM feats t JOIN a ON a.code = t.code AND t.dt > a.anchor_date JOIN feats b ON b.code = a.code AND b.dt = a.anchor_date")
def w24_bars_elapsed(spark, sf_dir):
    return watchlist.bars_elapsed(panel(spark, sf_dir), anchors(spark, sf_dir)).select("code", "dt", F.col("elapsed").cast("int").alias("elapsed"))


CLOSE = "close"
TOUCH = ", ".join(f"CASE WHEN ma{k} > 0 AND abs(low - ma{k}) <= 0.015 * ma{k} THEN '{k}MA' END" for k in (5, 10, 13, 20, 60, 120))
REVIEW = f"""c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_date ORDER BY abs(rate) DESC, code) AS rn FROM ({C1})) WHERE rn <= 12),
h AS (SELECT *, {lag_sql('dt')} AS d1, min(low) OVER ({OVER} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS low20, max(high) OVER ({OVER} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS high20 FROM feats),
review AS (SELECT c.scan_date, h.dt AS review_date, c.strategy, h.code, round((h.close - h.c1) / h.c1 * 100, 6) AS day_return, round((h.high - h.c1) / h.c1 * 100, 6) AS max_profit,
  array_to_string(list_filter([{TOUCH}], lambda x: x IS NOT NULL), ', ') AS ma_touches,
  array_to_string(list_filter([CASE WHEN low20 > 0 AND abs(low - low20) <= 0.018 * low20 THEN 'low20' END, CASE WHEN high20 > 0 AND abs(high - high20) <= 0.018 * high20 THEN 'high20' END], lambda x: x IS NOT NULL), ', ') AS extreme_touches,
  coalesce((h.high - h.c1) / h.c1 * 100 >= 3.0, false) AS hit FROM h JOIN c ON c.code = h.code AND c.scan_date = h.d1)"""


def review(spark, sf_dir):
    return watchlist.review_previous_picks(panel(spark, sf_dir), c1(spark, sf_dir))


@query(f"WITH {FEATS}, {REVIEW} SELECT * FROM review")
def c10_review_previous_picks(spark, sf_dir):
    return review(spark, sf_dir)


@query(f"WITH {FEATS}, {REVIEW} SELECT strategy, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, round(avg(CAST(hit AS INT)), 6) AS hit_rate FROM review GROUP BY strategy")
def a5_hit_split(spark, sf_dir):
    return watchlist.hit_split(review(spark, sf_dir))


@query(f"WITH {PANEL} SELECT max(dt) AS previous_day FROM bars WHERE code = '000003' AND dt < DATE '1999-06-30'")
def w27_previous_trading_day(spark, sf_dir):
    return watchlist.previous_trading_day(panel(spark, sf_dir), "1999-06-30", "000003")


@query(f"WITH {PANEL}, {PIVOTS} SELECT code, dt, h_supports FROM sup")
def w20_pivot_supports(spark, sf_dir):
    return scans.supports(numbered(panel(spark, sf_dir))).select("code", "dt", "h_supports")


@query(f"WITH {PANEL}, {PIVOTS} SELECT code, dt, trendline_support FROM line")
def w21_trendline_support(spark, sf_dir):
    return scans.supports(numbered(panel(spark, sf_dir))).select("code", "dt", "trendline_support").where("trendline_support is not null")


def chart_sql(means: tuple[int, ...], least: int) -> str:
    cols = []
    for n in means:
        mean = mean_sql("close", n)
        if n == 224 and least == 5:
            mean = f"CASE WHEN n < 224 AND bar_no = n THEN avg_all ELSE {mean} END"
        cols.append(f"round({mean}, 6) AS ma{n}")
    return f"""WITH {PANEL}, b AS (SELECT *, row_number() OVER ({OVER}) AS bar_no, count(*) OVER (PARTITION BY code) AS n, avg(close) OVER (PARTITION BY code) AS avg_all FROM bars),
m AS (SELECT *, {', '.join(cols)} FROM b)
SELECT code, dt, CAST(bar_no - greatest(n - 40, 0) - 1 AS INT) AS x, open, high, low, close, volume, {', '.join(f'ma{n}' for n in means)}, close >= open AS up, least(open, close) AS body_bottom,
  CASE WHEN close = open THEN 1.0::DOUBLE ELSE abs(close - open) END AS body_height, CASE WHEN (bar_no - greatest(n - 40, 0) - 1) % 5 = 0 THEN strftime(dt, '%m-%d') ELSE '' END AS label FROM m WHERE n >= {least} AND bar_no > n - 40"""


@query(chart_sql((5, 10, 20, 60, 120, 224), 40))
def w28_chart_feed_report(spark, sf_dir):
    return charts.chart_feed_report(panel(spark, sf_dir))


@query(chart_sql((3, 5, 8, 20, 60, 120, 224), 5))
def w29_chart_feed_candle(spark, sf_dir):
    return charts.chart_feed_candle(panel(spark, sf_dir))


@query(f"WITH {FEATS} SELECT f.* FROM ({C1}) f WHERE code IN (SELECT {CODE} FROM supplier WHERE s_acctbal >= 0)")
def j1_universe_bars(spark, sf_dir):
    """The universe meets the bars before the windows."""
    solvent = table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(supplier_code().alias("code"))
    return scans.scan_volume_surge(panel(spark, sf_dir), solvent, lookback_days=None)


SURGES = f"""{PANEL}, surges AS MATERIALIZED (SELECT code, dt AS anchor_date FROM
  (SELECT *, row_number() OVER ({OVER}) AS n_bars, {mean_sql('volume', 20)} AS v20 FROM bars) WHERE n_bars >= 224 AND v20 > 0 AND volume >= 1.2 * v20)"""


@query(f"WITH {SURGES} SELECT t.code, t.dt, a.anchor_date FROM bars t JOIN surges a ON a.code = t.code AND t.dt BETWEEN a.anchor_date + 1 AND a.anchor_date + 35")
def j2_watchlist_bars(spark, sf_dir):
    """The bars 1 to 35 days after each volume surge; a code has many."""
    surges = c1(spark, sf_dir).select("code", F.col("scan_date").alias("anchor_date"))
    return asof.range_join(panel(spark, sf_dir).select("code", "dt"), surges, "code", "dt", "anchor_date", 1, 35)


@query(f"WITH {SURGES}, days AS (SELECT code, dt + 3 AS day FROM bars) SELECT d.code, d.day, a.anchor_date FROM days d ASOF LEFT JOIN surges a ON a.code = d.code AND d.day >= a.anchor_date")
def j2_latest_surge(spark, sf_dir):
    """The latest surge as of three days after each bar, whether or not that day has a bar."""
    surges = c1(spark, sf_dir).select("code", F.col("scan_date").alias("anchor_date"))
    days = panel(spark, sf_dir).select("code", F.date_add("dt", 3).alias("day"))
    return asof.as_of_join(days, surges, "code", "day", "anchor_date")


@query(f"WITH {FEATS}, p AS ({C5}) SELECT p.scan_date, p.code, f.dt AS next_day, f.close AS next_close FROM p JOIN (SELECT *, {lag_sql('dt')} AS d1 FROM feats) f ON f.code = p.code AND f.d1 = p.scan_date")
def j3_picks_next_bar(spark, sf_dir):
    """The first bar after each pick, whenever it comes."""
    following = panel(spark, sf_dir).select("code", F.col("dt").alias("next_day"), F.col("close").alias("next_close"))
    return asof.as_of_join(c5(spark, sf_dir).select("code", "scan_date"), following, "code", "scan_date", "next_day", forward=True, strict=True, inner=True)


@query(
    f"""WITH {FEATS}, {THEMES} SELECT p.scan_date, p.code, coalesce(t.category, '기타') AS category, coalesce(t.subthemes[1:2], []) AS subthemes,
  CASE WHEN len(t.subthemes) > 0 THEN t.category || ' > ' || array_to_string(t.subthemes[1:2], ', ') ELSE coalesce(t.category, '기타') END AS detail_theme FROM ({C5}) p LEFT JOIN themes t USING (code)"""
)
def j4_theme_join(spark, sf_dir):
    return joins.theme_join(c5(spark, sf_dir), themes(spark, sf_dir)).select("scan_date", "code", "category", "subthemes", "detail_theme")


@query(f"WITH {FEATS} SELECT p.scan_date, p.code, coalesce(s.s_name, 'unknown') AS name FROM ({C5}) p LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal >= 0) s ON {CODE} = p.code")
def j5_name_join(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(supplier_code().alias("code"), F.col("s_name").alias("name"))
    return joins.name_join(c5(spark, sf_dir).withColumn("name", F.lit("unknown")), names).select("scan_date", "code", "name")


@query(f"WITH {LISTING} SELECT l.code, l.market, CAST(trunc(l.marcap) AS BIGINT) AS marcap, CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN n_name ELSE 'region ' || n_regionkey END AS sector FROM listing l LEFT JOIN (supplier JOIN nation ON s_nationkey = n_nationkey) ON lpad(CAST(s_suppkey AS VARCHAR), 6, '0') = l.code")
def j6_overview(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    some = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"])
    sector = some.select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("code"), F.when(F.col("s_suppkey") % 4 == 0, "").when(F.col("s_suppkey") % 2 == 0, F.col("n_name")).otherwise("").alias("sector"), F.when(F.col("s_suppkey") % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("region "), F.col("n_regionkey").cast("string"))).alias("industry"))
    return joins.overview(listing(spark, sf_dir), sector)


@query("SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code, max(o_orderkey) AS corp_code FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def j7_corp_join(spark, sf_dir):
    pad = lambda c: F.lpad(F.col(c).cast("string"), 6, "0")
    ids = table(spark, sf_dir, "orders").select(pad("o_custkey").alias("stock_code"), F.col("o_orderkey").alias("corp_code"), F.col("o_orderkey").alias("pos"))
    return joins.corp_join(table(spark, sf_dir, "customer").select(pad("c_custkey").alias("code")), ids)


@query(f"WITH {W}, {candle_sql(500, 60000.0)}, {candle_sql(150, 30000.0)} SELECT scan_date, code, candle_class FROM p500 UNION ALL SELECT scan_date, code, candle_class FROM p150 WHERE (scan_date, code) NOT IN (SELECT (scan_date, code) FROM p500)")
def j8_integrate(spark, sf_dir):
    f = scans.candle_features(panel(spark, sf_dir), {500: 60000.0, 150: 30000.0}, None)
    return scans.candle_picks(f, 500, 150).select("scan_date", "code", "candle_class")


@query(f"WITH {FEATS}, a AS ({C5}), b AS ({C4}) SELECT scan_date, code, strategy FROM a UNION ALL SELECT scan_date, code, strategy FROM b WHERE (scan_date, code) NOT IN (SELECT (scan_date, code) FROM a)")
def j9_append_tracked(spark, sf_dir):
    rest = scans.scan_surge_then_rest(panel(spark, sf_dir), lookback_days=None, high=300.0, surge=1.2)
    return watchlist.append_tracked(c5(spark, sf_dir), rest).select("scan_date", "code", "strategy")


@query(
    f"""WITH {THEMES}, c AS (SELECT {CODE} AS code, s_acctbal FROM supplier)
SELECT c.code, CASE WHEN t.code IS NOT NULL THEN array_to_string(list_concat([t.category], t.subthemes)[1:4], ', ') WHEN s_acctbal >= 0 THEN 'manual' ELSE '기타' END AS themes FROM c LEFT JOIN themes t USING (code)"""
)
def j13_stock_themes(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(supplier_code().alias("code"), "s_acctbal")
    manual = s.where("s_acctbal >= 0").select("code", F.array(F.lit("manual")).alias("tags"))
    return joins.stock_themes(s.select("code"), themes(spark, sf_dir), manual)


@query(f"WITH {FEATS}, p AS ({C1} UNION ALL {C5}) SELECT strategy, count(*) AS picks, count(*) FILTER (WHERE rate > 1) AS with_chart, count(*) FILTER (WHERE rate > 0) AS with_comment FROM p GROUP BY strategy")
def a4_strategy_totals(spark, sf_dir):
    p = c1(spark, sf_dir).unionByName(c5(spark, sf_dir)).withColumns({"chart": F.when(F.col("rate") > 1, "x"), "comment": F.when(F.col("rate") > 0, "up").otherwise("")})
    return ranking.strategy_totals(p)


@query(f"WITH {W}, {candle_sql(500, 30000.0)} SELECT candle_class, day_type, count(*) AS n FROM p500 GROUP BY candle_class, day_type", ints=("day_type",))
def a7_scan_summary(spark, sf_dir):
    return ranking.scan_summary(scans.scan_standard_candle(panel(spark, sf_dir), min_turnover=30000.0, lookback_days=None), ["candle_class", "day_type"])


@query(f"WITH {W}, {candle_sql(500, 60000.0)} SELECT scan_date, code, day_type, vol_ratio FROM p500", ints=("day_type",))
def o1_candle_sort(spark, sf_dir):
    """Rows come in the order; a test looks at it."""
    return scans.candle_sort(scans.scan_standard_candle(panel(spark, sf_dir), min_turnover=60000.0, lookback_days=None)).select("scan_date", "code", "day_type", "vol_ratio")


@query(f"WITH {W}, {candle_sql(500, 30000.0)} SELECT * FROM (SELECT scan_date, code, candle_class, day_type, vol_ratio, row_number() OVER (PARTITION BY scan_date ORDER BY candle_class DESC, day_type, vol_ratio DESC, code) AS pos FROM p500) WHERE pos <= 2", ints=("day_type", "pos"))
def o2_priority_cut(spark, sf_dir):
    rows = scans.scan_standard_candle(panel(spark, sf_dir), min_turnover=30000.0, lookback_days=None)
    return scans.priority_cut(rows.select("scan_date", "code", "candle_class", "day_type", "vol_ratio"), 2)


@query(f"WITH {FEATS}, p AS ({C1}) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_date, strategy ORDER BY abs(rate) DESC, code) AS rank FROM p) WHERE rank <= 3", ints=("rank",))
def o3_top_by_abs_rate(spark, sf_dir):
    return ranking.top_by_abs_rate(c1(spark, sf_dir), 3, ("scan_date", "strategy"))


@query(
    f"""WITH {FEATS}, p AS ({C1} UNION ALL {C3}), q AS (SELECT *, count(*) OVER (PARTITION BY scan_date) AS n,
  row_number() OVER (PARTITION BY scan_date ORDER BY CASE WHEN pattern LIKE '★%' THEN 0 ELSE 1 END, CASE WHEN pattern LIKE '%Pattern 1%' THEN 1 WHEN pattern LIKE '%60일의%' THEN 6 ELSE 99 END, rate, code) AS a,
  row_number() OVER (PARTITION BY scan_date ORDER BY abs(rate) DESC, code) AS b FROM (SELECT * REPLACE (CASE WHEN CAST(code AS INT) % 3 = 0 THEN '★ ' || pattern ELSE pattern END AS pattern) FROM p QUALIFY row_number() OVER (PARTITION BY scan_date, code ORDER BY strategy) = 1))
SELECT scan_date, code, strategy, pattern, CASE WHEN n > 4 THEN b ELSE a END AS rank FROM q WHERE CASE WHEN n > 4 THEN b ELSE a END <= 4""",
    ints=("rank",),
)
def o4_report_order(spark, sf_dir):
    both = c1(spark, sf_dir).unionByName(scans.scan_ma60_rule(panel(spark, sf_dir), lookback_days=None))
    one = joins.dedup_first(both, ["scan_date", "code"], ["strategy"])
    starred = one.withColumn("pattern", F.when(F.col("code").cast("int") % 3 == 0, F.concat(F.lit("★ "), "pattern")).otherwise(F.col("pattern")))
    return ranking.report_order(starred, 4, ("scan_date",)).select("scan_date", "code", "strategy", "pattern", "rank")


@query(f"WITH {FEATS}, p AS (SELECT *, row_number() OVER (PARTITION BY scan_date ORDER BY code DESC) AS pos FROM ({C1})) SELECT scan_date, code, pos, pos AS rank FROM p WHERE pos <= 3", ints=("pos", "rank"))
def o5_head_by_pos(spark, sf_dir):
    rows = c1(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("scan_date").orderBy(F.desc("code"))))
    return ranking.head_by_pos(rows, 3).select("scan_date", "code", "pos", "rank")


@query(f"WITH {FEATS}, p AS ({C1}) SELECT * FROM p WHERE scan_date IN (SELECT DISTINCT scan_date FROM p ORDER BY scan_date DESC LIMIT 5)")
def t8_keep_newest_dates(spark, sf_dir):
    return ranking.keep_newest_dates(c1(spark, sf_dir))


@query(f"WITH {FEATS}, p AS ({C1}) SELECT * REPLACE (DATE '2030-01-01' AS scan_date) FROM p WHERE scan_date = (SELECT max(scan_date) FROM p)")
def t9_carry_forward(spark, sf_dir):
    """Nothing today: the newest stored date's picks."""
    picks = c1(spark, sf_dir)
    return ranking.carry_forward(picks, picks.where("scan_date > date'2029-01-01'"), day="2030-01-01")


CARRY = f"h AS ({C1} UNION ALL {C3} UNION ALL {C5}), l AS (SELECT * FROM h WHERE scan_date = (SELECT max(scan_date) FROM h))"


@query(f"WITH {FEATS}, {CARRY} SELECT * FROM l WHERE strategy = 'yey' UNION ALL SELECT * FROM l WHERE strategy = 'ma60_rule'")
def t9_carry_forward_one_strategy(spark, sf_dir):
    """Today has volume surges only; of the two others one is carried, from the newest stored date."""
    history = c1(spark, sf_dir).unionByName(scans.scan_ma60_rule(panel(spark, sf_dir), lookback_days=None)).unionByName(c5(spark, sf_dir))
    today = history.join(F.broadcast(history.agg(F.max("scan_date").alias("scan_date"))), "scan_date", "left_semi").where("strategy = 'yey'")
    return ranking.carry_forward(history, today, strategies=["ma60_rule", "yey"])


@query(f"WITH {FEATS}, a AS ({C1}), b AS ({C5}) SELECT * FROM b UNION ALL SELECT * FROM a WHERE scan_date NOT IN (SELECT scan_date FROM b)")
def t10_replace_date_slice(spark, sf_dir):
    """Results stored by month; those of the later scan replace their dates in the months that they touch."""
    kept = DatedStore(spark, scratch_path(spark, "results"), schemas.PICK.replace("name string, ", ""), "scan_date")
    kept.replace(c1(spark, sf_dir))
    kept.replace_dates(c5(spark, sf_dir))
    return kept.read()


@query(f"WITH {LISTING} SELECT code, market FROM listing WHERE market IN ('KOSPI', 'KOSDAQ')")
def u1_union_listings(spark, sf_dir):
    rows = listing(spark, sf_dir).select("code", "market")
    return rows.where("market = 'KOSPI'").unionByName(rows.where("market = 'KOSDAQ'"), allowMissingColumns=True)


@query("SELECT source, substr(text, 1, 30) AS title, min(doc_id) AS doc_id FROM documents GROUP BY source, substr(text, 1, 30)")
def u2_dedup_first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.substring("text", 1, 30).alias("title"))
    return joins.dedup_first(docs, ["source", "title"], ["doc_id"])


@query("SELECT conv_id, list(role ORDER BY first_turn) AS tags FROM (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY conv_id, role) GROUP BY conv_id")
def u3_ordered_distinct_tags(spark, sf_dir):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    return grouped.select("conv_id", F.array_distinct(F.transform("t", lambda x: x["role"])).alias("tags"))


@query(f"WITH {FEATS}, a AS ({C5}), b AS ({C1}) SELECT scan_date, code, strategy FROM a UNION ALL SELECT scan_date, code, strategy FROM b WHERE (scan_date, code) NOT IN (SELECT (scan_date, code) FROM a)")
def u4_union_with_anti(spark, sf_dir):
    return scans.integrate(c5(spark, sf_dir), c1(spark, sf_dir)).select("scan_date", "code", "strategy")


@query(f"WITH {FEATS}, a AS ({C1}), b AS ({C5}) SELECT * FROM b UNION ALL SELECT * FROM a WHERE (code, scan_date) NOT IN (SELECT (code, scan_date) FROM b)")
def u5_merge_keyed(spark, sf_dir):
    return joins.merge_keyed(c1(spark, sf_dir), c5(spark, sf_dir), ["code", "scan_date"])


@query(f"WITH {PANEL} SELECT code, dt, array_to_string(list_filter([{TOUCH}], lambda x: x IS NOT NULL), ', ') AS touches FROM (SELECT *, {', '.join(f'{mean_sql(CLOSE, k)} AS ma{k}' for k in (5, 10, 13, 20, 60, 120))} FROM bars)")
def x12_touch_list(spark, sf_dir):
    f = numbered(panel(spark, sf_dir)).withColumns({f"ma{k}": ind.sma(k) for k in (5, 10, 13, 20, 60, 120)})
    return f.select("code", "dt", F.concat_ws(", ", touch_list(F.col("low"), {f"{k}MA": F.col(f"ma{k}") for k in (5, 10, 13, 20, 60, 120)}, 0.015)).alias("touches"))

