"""Scans against a plain restatement per series, thresholds, panel mode against as-of mode, and plans."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.functions import patterns as pat
from barloom.operators import bars as store
from barloom.operators import charts, comments, financials, joins, news, ranking, scans, universe, watchlist
from barloom.plans import features as feat

START = dt.date(2020, 1, 1)


def series(seed: int, n: int, code: str, gap: float = 0.0, moves=(-0.03, -0.01, 0.0, 0.01, 0.03, 0.12, -0.08)):
    rng, price, day, out = random.Random(seed), 1000, START, []
    for _ in range(n):
        o = max(50, price + rng.randint(-20, 20))
        drift = 0.004 if len(out) // 90 % 2 else -0.004
        c = max(50, round(o * (1 + drift + rng.choice(moves))))
        h, low = max(o, c) + rng.randint(0, 80), min(o, c) - rng.randint(0, 30)
        out.append((code, day, float(o), float(h), float(max(low, 1)), float(c), float(rng.choice([100, 200, 300, 900, 2000]))))
        price, day = c, day + dt.timedelta(days=1 + (rng.random() < gap) * rng.randint(1, 9))
    return out


SCHEMA = "code string, dt date, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="module")
def bars(spark):
    rows = series(8, 420, "000008", moves=(-0.02, -0.01, 0.0, 0.01, 0.02)) + series(9, 420, "000009", 0.1, moves=(-0.02, -0.01, 0.0, 0.01, 0.02)) + series(1, 420, "000001") + series(2, 300, "0015N0", 0.2) + series(3, 140, "000003") + series(4, 30, "000004")
    return spark.createDataFrame(rows, SCHEMA).cache()


def as_frames(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["dt"]):
        out.setdefault(r["code"], []).append(r)
    return out


def mean(rows, name, n, k=0):
    """pandas' rolling mean at offset -k: missing until n rows exist."""
    end = len(rows) - k
    return sum(r[name] for r in rows[end - n : end]) / n if end >= n else None


def plain_surge(rows):
    v = mean(rows, "volume", 20)
    return len(rows) >= 224 and v and rows[-1]["volume"] >= 1.2 * v


def plain_ma60(rows):
    a, b, last = mean(rows, "close", 60), mean(rows, "close", 120), rows[-1]
    return len(rows) >= 125 and b > 0.99 * last["close"] and last["low"] <= 1.025 * a and last["close"] >= 0.985 * a


def plain_rest(rows):
    if len(rows) < 140:
        return False
    b, y, t = rows[-3], rows[-2], rows[-1]
    ret, v = (y["close"] - b["close"]) / b["close"] * 100, mean(rows, "volume", 20, 1)
    return 4 <= ret <= 22 and y["close"] > y["open"] and y["volume"] >= 1.5 * v and t["close"] < t["open"] and t["volume"] <= 0.75 * y["volume"]


def plain_strong(rows):
    if len(rows) < 130:
        return False
    y, t = rows[-2], rows[-1]
    ret = (t["close"] - y["close"]) / y["close"] * 100
    return 6 <= ret < 20 and t["close"] > t["open"] and t["volume"] >= 1.5 * mean(rows, "volume", 20) and t["close"] >= mean(rows, "close", 20)


def plain_retest(rows, turnover=1e4, surge=0.8):
    if len(rows) < 224:
        return None
    t = rows[-1]
    high = max(r["high"] for r in (rows[-500:] if len(rows) >= 500 else rows))
    m = {n: mean(rows, "close", n) for n in (5, 20, 60, 120, 224)}
    rising = m[5] >= mean(rows, "close", 5, 1) or m[20] >= mean(rows, "close", 20, 1)
    if not (high >= 1.0 * t["close"] and m[5] > m[20] and rising):
        return None

    def low_before(n):
        for k in range(30):
            b = len(rows) - 1 - k
            if b < 1 or b + 1 < n + 1 or mean(rows, "volume", 20, k) is None:
                return None
            now, before = mean(rows, "close", n, k), mean(rows, "close", n, k + 1)
            r = rows[b]
            if now is None or before is None:
                return None
            if r["close"] > now and rows[b - 1]["close"] <= before and r["close"] * r["volume"] >= turnover and r["volume"] >= surge * mean(rows, "volume", 20, k):
                return min(x["low"] for x in rows[max(0, b - 60) : b - 2])
        return None

    for label, over, long, short in (("Pattern 1", 120, 120, 60), ("Pattern 2", 60, 60, 20), ("Pattern 3", 224, 224, 120)):
        low = low_before(over)
        if low is not None and m[long] > m[short] and t["low"] >= low * 0.975 and 0.95 * m[short] <= t["close"] <= 1.05 * m[long]:
            return label
    return None


def panel_of(plain, frames, days=400):
    out = set()
    for code, rows in frames.items():
        for i, r in enumerate(rows):
            cut = [x for x in rows[: i + 1] if (r["dt"] - x["dt"]).days <= days]
            if hit := plain(cut):
                out.add((code, r["dt"], hit if isinstance(hit, str) else None))
    return out


CASES = {
    "surge": (scans.scan_volume_surge, {}, plain_surge),
    "ma60": (scans.scan_ma60_rule, {}, plain_ma60),
    "rest": (scans.scan_surge_then_rest, {}, plain_rest),
    "strong": (scans.scan_strong_candle, {"surge": 1.5, "min_turnover": 0.0}, plain_strong),
    "retest": (scans.scan_breakout_retest, {"high_factor": 1.0, "breakout_turnover": 1e4, "breakout_surge": 0.8}, plain_retest),
}


@pytest.mark.parametrize("name", list(CASES))
def test_panel_mode_equals_a_plain_scan_of_every_slice(bars, name):
    scan, args, plain = CASES[name]
    rows = scan(bars, **args).collect()
    got = {(r["code"], r["scan_date"], r["pattern"] if name == "retest" else None) for r in rows}
    want = panel_of(plain, as_frames(bars))
    assert got == want and (want or name == "rest")


@pytest.mark.parametrize("name", ["surge", "strong", "retest"])
def test_as_of_mode_equals_panel_mode(bars, name):
    scan, args, _ = CASES[name]
    panel = scan(bars, **args).where("code in ('000001', '000003')").collect()
    day = max((r["scan_date"] for r in panel), default=START)
    known = bars.where("code in ('000001', '000003')")
    got = {(r["code"], r["pattern"]) for r in scan(known, target=str(day), require_fresh=True, **args).collect()}
    assert got == {(r["code"], r["pattern"]) for r in panel if r["scan_date"] == day}


def test_stale_series_are_scanned_unless_fresh_is_asked(bars):
    late = str(START + dt.timedelta(days=425))
    some = scans.scan_volume_surge(bars, target=late, surge=0.0).count()
    assert some > 0 and scans.scan_volume_surge(bars, target=late, surge=0.0, require_fresh=True).count() == 0


def test_one_exchange_and_one_sort_by_code(spark, bars, capsys):
    for df in (feat.features(bars, 400), scans.scan_breakout_retest(bars)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(code") == 1 and plan.count("Sort [code") == 1


def test_date_filter_reaches_the_scan(spark, bars, tmp_path):
    from barloom.sources import readers, sinks

    sinks.write_bars(bars, str(tmp_path / "bars"))
    df = readers.read_bars_window(spark, str(tmp_path / "bars"), "2020-06-30", 60)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(dt" in plan.partition("PushedFilters")[2] and df.count() > 0
    assert "month" in plan.partition("PartitionFilters: [")[2].partition("]")[0]
    kept = store.prune_bars(spark.read.parquet(str(tmp_path / "bars")), "2021-03-01", 60)
    assert "month" in kept._jdf.queryExecution().executedPlan().toString().partition("PartitionFilters: [")[2].partition("]")[0]


def test_candles_are_sorted_and_chosen_in_one_pass(spark, bars):
    f = scans.candle_features(bars, {500: 2000.0, 150: 500.0}, None)
    rows = lambda df: sorted(map(str, df.collect()))
    one = scans.candle_picks(f, 500, 150)
    assert one._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(code") == 1
    assert rows(one) == rows(scans.integrate(scans.candle_picks(f, 500), scans.candle_picks(f, 150)))
    keys = [(r["day_type"], -r["vol_ratio"], r["code"]) for r in scans.candle_sort(one).collect()]
    assert keys == sorted(keys)


def test_an_empty_prefilter_falls_back_to_the_full_list(spark):
    df = spark.createDataFrame([("1", "x"), ("2", "y")], "code string, name string")
    assert universe.with_fallback(df.limit(0), df).count() == 2
    assert [r["code"] for r in universe.with_fallback(df.where("code = '2'"), df).collect()] == ["2"]


def candle(code, day, o, h, low, c, v=1000.0):
    return (code, START + dt.timedelta(days=day), float(o), float(h), float(low), float(c), float(v))


@pytest.mark.parametrize(
    ("bar", "hit"),
    [((100, 116, 100, 109.1), True), ((100, 115, 100, 108.9), False), ((100, 114.9, 99, 110), False), ((105, 120, 104.5, 115), False), ((100, 130, 100, 120), True)],
)
def test_standard_candle_thresholds(spark, bar, hit):
    df = feat.numbered(spark.createDataFrame([candle("a", 0, 100, 100, 100, 100), candle("a", 1, *bar)], SCHEMA))
    flags = [r["f"] for r in df.withColumn("f", pat.standard_candle(1000.0)).orderBy("dt").collect()]
    assert flags == [False, hit]


def test_reference_candle_search(spark):
    """Age 1 with rising volume is passed over for age 4; with falling volume it is taken."""
    def search(volume_today):
        days = [candle("a", k, 100, 100, 100, 100, 500) for k in range(20)]
        for k, v in ((15, 3000), (18, 1000)):
            days[k] = candle("a", k, 100, 130, 100, 125, v)
        days[16] = days[19] = candle("a", 16, 100, 100, 100, 100, 500)
        days[16], days[19] = candle("a", 16, 100, 100, 100, 100, 500), candle("a", 19, 100, 100, 100, 100, volume_today)
        f = feat.numbered(spark.createDataFrame(days, SCHEMA)).withColumn("candle", F.when(pat.standard_candle(1000.0), F.struct("bar_no", "volume")))
        ref = pat.reference_candle()
        return f.select("dt", (F.col("bar_no") - ref["bar_no"]).alias("age")).orderBy(F.desc("dt")).first()["age"]

    assert search(2000) == 4 and search(900) == 1


def test_trendline_rounds_half_to_even_and_needs_rising_pivots(spark):
    lows = [50.0] * 40
    lows[10], lows[14] = 10.0, 11.0
    rows = [candle("a", k, 100, 100, low, 100) for k, low in enumerate(lows)]
    out = scans.supports(feat.numbered(spark.createDataFrame(rows, SCHEMA))).orderBy(F.desc("dt")).first()
    assert out["trendline_support"] == round(11 + 0.25 * 25) and out["h_supports"] == [11.0, 10.0]


def test_store_defaults_upsert_and_sync(spark):
    listing = spark.createDataFrame([("a", None, 0.0, 5.0, 10.0, None), ("b", 1.0, 2.0, 3.0, 0.0, 5.0), ("c", 1.0, 2.0, 3.0, float("nan"), 5.0)], "code string, open double, high double, low double, close double, volume double")
    (row,) = store.bars_from_listing(listing, "2024-01-05").collect()
    assert (row["code"], row["open"], row["high"], row["low"], row["volume"]) == ("a", 10.0, 10.0, 5.0, 0.0)
    old = spark.createDataFrame([candle("a", 0, 1, 1, 1, 1), candle("b", 0, 1, 1, 1, 1)], SCHEMA)
    new = spark.createDataFrame([(*candle("a", 0, 2, 2, 2, 2), 1), (*candle("a", 0, 3, 3, 3, 3), 2)], SCHEMA + ", seq int")
    assert sorted((r["code"], r["close"]) for r in store.upsert_bars(old, new, "seq").collect()) == [("a", 3.0), ("b", 1.0)]
    full = spark.createDataFrame([candle("a", 0, 1, 1, 1, 1)], SCHEMA)
    assert store.sync_bars(full, listing, full, str(START), min_codes=1).first()["close"] == 1.0
    assert store.sync_bars(full, listing, full, str(START), min_codes=2).first()["close"] == 10.0


def test_missing_days_refuse_large_gaps(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert store.find_missing_days(none, "2024-01-31").count() == 0
    assert store.find_missing_days(none, "2024-01-31", lookback_days=7).count() == 5


def test_universe_rules(spark):
    rows = [("1", "삼성", "KOSPI"), ("2", "삼성우", "KOSPI"), ("3", "KODEX ETF", "KOSDAQ"), ("4", None, "KOSDAQ"), ("5", "x", "KONEX")]
    df = spark.createDataFrame(rows, "code string, name string, market string")
    assert [r["code"] for r in universe.full_universe(df).collect()] == ["1", "5"]
    assert universe.exclude_instruments(df, null_is_excluded=False).count() == 3
    assert universe.market_filter(df).count() == 4


def test_watchlist_registers_once(spark):
    empty = spark.createDataFrame([], "code string, name string, anchor_date date, anchor_close bigint, pattern string, status string")
    picks = spark.createDataFrame([("a", "n", 10, "first", 1), ("a", "n", 11, "second", 2), ("b", "n", 12, "first", 3)], "code string, name string, close bigint, pattern string, pos int")
    one = watchlist.register_anchors(empty, picks, "2024-01-05")
    two = watchlist.register_anchors(one, picks.withColumn("close", F.col("close") + 5), "2024-02-05")
    assert sorted((r["code"], r["anchor_close"], r["pattern"]) for r in two.collect()) == [("a", 10, "first"), ("b", 12, "first")]


def test_retention_and_carry_forward(spark):
    days = spark.createDataFrame([(START + dt.timedelta(days=k), f"c{k}", s) for k in range(6) for s in ("a", "b")], "scan_date date, code string, strategy string")
    assert ranking.keep_newest_dates(days).count() == 10
    assert {(r["code"], r["strategy"]) for r in ranking.carry_forward(days, days.limit(0), day="2024-01-01").collect()} == {("c5", "a"), ("c5", "b")}
    today = spark.createDataFrame([(START + dt.timedelta(days=9), "new", "a")], days.schema)
    carried = ranking.carry_forward(days, today, day="2024-01-01", strategies=["a", "b", "none"])
    assert {(r["code"], r["strategy"]) for r in carried.collect()} == {("new", "a"), ("c5", "b")}
    assert ranking.carry_forward(days, today, strategies=["a"]).count() == 1
    assert ranking.replace_date_slice(days, days.limit(1).withColumn("code", F.lit("new"))).count() == 11


def test_news_blocks_follow_their_headers(spark):
    text = "### first\n#### A (+1%)\nline one\n### second\n\n● B&C (-2.5%), D (3%)\nline two\n**no percent**\n"
    files = spark.createDataFrame([("/x/2024.01.05 news.md", text), ("/x/none.md", "no date"), ("/x/y.md", "date 2023-02-01\n#### Z\nbody text")], "path string, text string")
    dated = news.news_dates(files)
    assert sorted(r["news_date"] for r in dated.collect()) == ["2023-02-01", "2024-01-05"]
    lines = news.news_lines(dated)
    first = {r["header"]: (r["category"], r["text"]) for r in news.news_blocks(lines).collect()}
    assert first["A (+1%)"] == ("first", "line one") and first["B&C (-2.5%), D (3%)"] == ("second", "line two\n**no percent**")
    assert {r["header"]: r["category"] for r in news.news_blocks(lines, compat=True).collect()}["A (+1%)"] == "second"
    tokens = {(r["stock_name"], r["rate"]) for r in news.news_tokens(news.news_blocks(lines)).collect()}
    assert tokens == {("A", "+1%"), ("B&C", "-2.5%"), ("D", "3%"), ("Z", "")}


def test_last_account_counts_even_without_an_amount(spark):
    rows = [("a", 2023, "CFS", 1, "매출액", "1,000"), ("a", 2023, "CFS", 2, "매출액", "-"), ("a", 2023, "CFS", 3, "영업이익", "7"), ("a", 2023, "OFS", 4, "매출액", "9"), ("b", 2023, "OFS", 5, "당기순이익(손실)", "-3")]
    df = spark.createDataFrame(rows, "code string, year int, fs_div string, pos int, account_nm string, thstrm_amount string")
    out = {r["code"]: (r["revenue"], r["operating_profit"], r["net_income"]) for r in financials.financial_statement_long(df).collect()}
    assert out == {"a": (None, 7, None), "b": (None, None, -3)}


def test_comment_repair(spark):
    df = spark.createDataFrame([("전저점(0원) 1234567.0원(+2%) 5.0원으로 상단 상단", 1000), (".0원 마감", 1234), ("원의 시작", 1234), (None, 5)], "comment string, close bigint")
    out = [r["repaired"] for r in comments.repair_comment(df, prefixes=True).collect()]
    assert out == ["전저점(880원) 1,234,567원(+2%) 5원으로 상단", "오늘 1,234원 마감", "오늘 1,234원의 시작", None]


def test_theme_tags(spark):
    picks = spark.createDataFrame([("a",), ("b",), ("c",)], "code string")
    themes = spark.createDataFrame([("a", "x", ["p", "q", "r"]), ("b", "y", [])], "code string, category string, subthemes array<string>")
    assert {r["code"]: r["detail_theme"] for r in joins.theme_join(picks, themes).collect()} == {"a": "x > p, q", "b": "y", "c": "기타"}


def test_short_series_have_no_report_chart(bars):
    codes = {r["code"] for r in charts.chart_feed_report(bars).select("code").distinct().collect()}
    assert codes == {"000001", "0015N0", "000003", "000008", "000009"}
    last = charts.chart_feed_candle(bars).where("code = '000004'").orderBy(F.desc("dt")).collect()
    assert last[0]["ma224"] is not None and all(r["ma224"] is None for r in last[1:])
