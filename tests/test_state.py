"""The state per code: advanced day by day it equals a rebuild, and scans of it equal those of bars."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from barloom import schemas
from barloom.operators import scans
from barloom.plans import features as feat
from barloom.sources.state import CodeState, last_features

START, N = date(2021, 1, 1), 460
LAST = START + timedelta(days=N - 1)


@pytest.fixture(scope="module")
def bars(spark):
    rng = random.Random(5)
    rows = []
    for c in range(40):
        close = rng.randrange(800, 1200)
        for k in range(N if c % 8 else 60):  # some codes end long before the others
            if c % 3 == 0 and rng.random() < 0.2:
                continue
            before, close = close, max(50, close + rng.randrange(-40, 41) + (rng.randrange(60, 200) if rng.random() < 0.03 else 0) - (close > 1500) * 30)
            low, high = min(before, close) - rng.randrange(9), max(before, close) + rng.randrange(30)
            volume = rng.randrange(10, 1000) * (5 if close - before > 60 else 1)
            price = None if rng.random() < 0.003 else float(close)
            rows.append((f"c{c:02}", START + timedelta(days=k), float(before), float(high), float(low), price, float(volume)))
    return spark.createDataFrame(rows, schemas.BAR).cache()


def plain(state):
    return sorted((r["code"], [tuple(b) for b in r["bars"]]) for r in state.collect())


def test_daily_batches_equal_a_rebuild(spark, bars, tmp_path):
    daily, whole = CodeState(spark, str(tmp_path / "a")), CodeState(spark, str(tmp_path / "b"))
    assert daily.read().count() == 0
    first = LAST - timedelta(days=3)
    daily.advance(bars.where(F.col("dt") <= F.lit(first)).withColumn("close", F.when(F.col("dt") == F.lit(first), 1.0).otherwise(F.col("close"))), str(first))
    for k in range(1, 4):
        day = first + timedelta(days=k)
        batch = bars.where(F.col("dt").between(F.lit(day - timedelta(days=1)), F.lit(day)))
        twice = batch.withColumn("seq", F.lit(2)).unionByName(batch.withColumns({"close": F.lit(0.0), "seq": F.lit(1)}))
        daily.advance(twice, str(day), "seq")
    whole.advance(bars, str(LAST))
    assert plain(daily.read()) == plain(whole.read())
    held = whole.read().select("code", F.explode("bars").alias("b")).select("code", "b.dt", "b.close")
    want = bars.where(F.col("dt") >= F.lit(LAST - timedelta(days=400)))
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, want.select("code", "dt", "close").collect()))
    assert whole.read().where("code = 'c00'").count() == 1 and want.where("code = 'c00'").count() < 60
    assert len(daily._names("data")) == 2 and len(daily._versions()) == 2


def test_a_new_session_finds_the_state_and_a_killed_batch_leaves_it(spark, bars, tmp_path, monkeypatch):
    kept = CodeState(spark, str(tmp_path / "s"), buckets=8)
    kept.advance(bars, str(LAST))
    before = plain(kept.read())
    monkeypatch.setattr(CodeState, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        kept.advance(bars.withColumn("close", F.lit(1.0)), str(LAST))
    monkeypatch.undo()
    for t in spark.catalog.listTables():
        if t.name.startswith("code_state_"):
            spark.sql(f"DROP TABLE {t.name}")  # what a session of its own would not know
    other = CodeState(spark, str(tmp_path / "s"), buckets=16)
    assert plain(other.read()) == before
    other.advance(bars.where(F.col("dt") == F.lit(LAST)), str(LAST))
    assert plain(other.read()) == before


@pytest.mark.parametrize("target", [LAST, LAST - timedelta(days=37)])
def test_features_and_scans_equal_those_of_bars(spark, bars, tmp_path, target):
    kept = CodeState(spark, str(tmp_path / "s"), keep_days=450)
    kept.advance(bars, str(LAST))
    universe = bars.select("code").distinct().where("code <> 'c05'")
    f = last_features(kept.read(), str(target), universe=universe, breakout_turnover=1e5, breakout_surge=1.5).cache()
    cut = bars.join(universe, "code", "left_semi")
    want = feat.last_bar(feat.breakouts(feat.features(feat.as_of(cut, str(target))), min_turnover=1e5, surge=1.5))
    names = sorted(set(want.columns) & set(f.columns) - {"bar_no"})
    assert set(want.columns) - {"day"} <= set(f.columns) and "b224" in names

    def rows(df):
        return {r["code"]: r.asDict(recursive=True) for r in df.select(*names).collect()}

    got, wanted = rows(f), rows(want)
    assert got.keys() == wanted.keys() and len(got) > 30
    for code in got:
        assert got[code] == wanted[code], code
    assert any(r["b120"] for r in got.values()) and any(r["ma224"] is None for r in got.values())
    easy = {"high_factor": 1.0, "breakout_turnover": 1e5, "breakout_surge": 1.5, "min_bars": 130}
    for scan, settings in [(scans.scan_volume_surge, {"surge": 0.5}), (scans.scan_breakout_retest, easy), (scans.scan_ma60_rule, {}), (scans.scan_surge_then_rest, {"low": 0.5, "surge": 0.5, "rest": 2.0}), (scans.scan_strong_candle, {"low": 0.5, "surge": 0.5, "min_turnover": 0.0})]:
        a = scan(f, target=str(target), require_fresh=target == LAST, **settings)
        b = scan(bars, universe, str(target), require_fresh=target == LAST, **settings)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_scans_of_a_state_move_no_row_and_batches_move_only_themselves(spark, bars, tmp_path):
    kept = CodeState(spark, str(tmp_path / "s"))
    kept.advance(bars, str(LAST))
    plan = scans.scan_breakout_retest(last_features(kept.read(), str(LAST)), target=str(LAST))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Exchange", "Sort", "Window"))
    joined = kept.read().join(bars.groupBy("code").agg(F.count("*").alias("n")).hint("shuffle_hash"), "code", "full_outer")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Sort " not in plan
