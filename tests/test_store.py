"""Committed stores, as-of and range joins, running sums and extremes, against plain restatements."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from barloom import schemas
from barloom.functions import indicators as ind
from barloom.operators import asof
from barloom.operators import bars as ops
from barloom.plans import features as feat
from barloom.sources.store import BarStore, DatedStore, PartStore

START = date(2020, 1, 1)


@pytest.fixture(scope="module")
def bars(spark):
    rng = random.Random(1)
    rows = [(c, START + timedelta(days=k), 1.0, 3.0, 0.5, float(rng.randrange(1, 99)), float(rng.randrange(9))) for c in "abc" for k in range(120)]
    return spark.createDataFrame(rows, schemas.BAR).cache()


def content(df):
    return sorted(tuple(r) for r in df.select(*ops.KEYS, *ops.FIELDS).collect())


def files(path, part=""):
    return {str(f) for f in path.rglob("*.parquet") if part in str(f)}


def test_first_write_and_upsert_touch_only_the_batch_months(spark, bars, tmp_path):
    kept = BarStore(spark, str(tmp_path / "s"))
    assert kept.read().count() == 0 and kept.parts() == {}
    kept.upsert(bars)
    assert content(kept.read()) == content(bars) and sorted(kept.parts()) == ["2020-01", "2020-02", "2020-03", "2020-04"]
    before = files(tmp_path)
    batch = bars.where("dt between date'2020-03-05' and date'2020-03-09'").withColumn("close", F.col("close") + 1)
    kept.upsert(batch.withColumn("seq", F.lit(2)).unionByName(batch.withColumns({"close": F.lit(0.0), "seq": F.lit(1)})), "seq")
    assert content(kept.read()) == content(ops.upsert_bars(bars, batch))
    kept.vacuum(keep=1)
    assert {f.split("__part=")[1][:7] for f in before ^ files(tmp_path)} == {"2020-03"}
    assert content(kept.window(date(2020, 2, 10), date(2020, 3, 3))) == content(ops.upsert_bars(bars, batch).where("dt between date'2020-02-10' and date'2020-03-03'"))


def test_a_write_that_dies_before_its_commit_leaves_the_old_state(spark, bars, tmp_path, monkeypatch):
    kept = BarStore(spark, str(tmp_path / "s"))
    kept.upsert(bars)
    reader = kept.read()
    monkeypatch.setattr(BarStore, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        kept.upsert(bars.withColumn("close", F.lit(7.0)))
    monkeypatch.undo()
    assert content(BarStore(spark, str(tmp_path / "s")).read()) == content(bars)
    kept.upsert(bars.withColumn("close", F.lit(7.0)))
    assert content(reader) == content(bars)  # a reader that began before the commit ends on the old files
    assert {r["close"] for r in kept.read().select("close").distinct().collect()} == {7.0}
    kept.vacuum(keep=1)
    assert files(tmp_path) == {str(f) for p in kept.parts().values() for f in (tmp_path / "s" / p).glob("*.parquet")}


def test_a_second_writer_is_refused(spark, bars, tmp_path):
    one, two = (PartStore(spark, str(tmp_path / "s"), schemas.BAR, F.col("code")) for _ in range(2))
    written = one.write(bars)
    two.replace(bars.where("code = 'a'"))
    one._versions = list
    with pytest.raises(RuntimeError):
        one.commit(written)
    assert sorted(two.parts()) == ["a"]


def test_prune_drops_months_unread_and_rewrites_the_edge(spark, bars, tmp_path):
    kept = BarStore(spark, str(tmp_path / "s"))
    kept.upsert(bars)
    march = files(tmp_path, "2020-03")
    kept.prune("2020-04-20", 60)
    kept.vacuum(keep=1)
    assert content(kept.read()) == content(bars.where("dt >= date'2020-02-20'"))
    assert not files(tmp_path, "2020-01") and march <= files(tmp_path)
    names = files(tmp_path)
    kept.prune("2020-04-20", 60)
    assert files(tmp_path) == names and sorted(kept.parts()) == ["2020-02", "2020-03", "2020-04"]


@pytest.mark.parametrize("complete", [False, True])
def test_sync_equals_the_whole_table_version(spark, bars, tmp_path, complete):
    target = "2020-04-27"
    held = bars.where("dt < date'2020-04-27' and not dt between date'2020-04-14' and date'2020-04-16'")
    held = held.unionByName(bars.where("dt = date'2020-04-27'")) if complete else held
    listing = spark.createDataFrame([("a", 1.0, 2.0, 1.0, 5.0, 7.0), ("b", 0.0, 0.0, 0.0, 6.0, None), ("z", 1.0, 1.0, 1.0, 0.0, 1.0)], "code string, open double, high double, low double, close double, volume double")
    kept = BarStore(spark, str(tmp_path / "s"))
    kept.upsert(held)
    march = files(tmp_path, "2020-03")
    kept.sync(listing, bars, target, days_to_keep=60, min_codes=3)
    pruned = ops.prune_bars(held, target, 60)
    repaired = ops.backfill_bars(pruned, bars, listing, ops.find_missing_days(pruned, target, min_codes=3))
    want = repaired if complete else ops.upsert_bars(repaired, ops.bars_from_listing(listing, target))
    assert content(kept.read()) == content(want) and march <= files(tmp_path)
    assert len(kept._versions()) == 2


def test_replaced_dates_leave_other_months_alone(spark, bars, tmp_path):
    kept = DatedStore(spark, str(tmp_path / "s"))
    kept.replace(bars)
    february = files(tmp_path, "2020-02")
    new = bars.where("code = 'a' and dt between date'2020-03-30' and date'2020-04-02'").withColumn("close", F.lit(0.0))
    kept.replace_dates(new)
    assert content(kept.read()) == content(bars.where("not dt between date'2020-03-30' and date'2020-04-02'").unionByName(new))
    assert february <= files(tmp_path)


def test_parts_of_any_name(spark, tmp_path):
    kept = PartStore(spark, str(tmp_path / "s"), "k string, v int", F.coalesce("k", F.lit("none")), "json")
    rows = [("a b/c=1", 1), ("한글", 2), (None, 3), ("x%20", 4)]
    kept.replace(spark.createDataFrame(rows, "k string, v int"))
    assert sorted(kept.parts()) == sorted(["a b/c=1", "한글", "none", "x%20"])
    kept.replace(spark.createDataFrame([("한글", 5)], "k string, v int"))
    assert sorted((r["k"] or "", r["v"]) for r in kept.read().collect()) == sorted([("a b/c=1", 1), ("한글", 5), ("", 3), ("x%20", 4)])


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_as_of_join_matches_brute_force(spark, forward, strict):
    rng = random.Random(7)
    day = lambda: None if rng.random() < 0.05 else START + timedelta(days=rng.randrange(60))
    key = lambda: rng.choice(["a", "b", "c", None])
    left, right = [(key(), day(), i) for i in range(200)], [(key(), day(), i) for i in range(80)]
    got = asof.as_of_join(spark.createDataFrame(left, "k string, d date, i int"), spark.createDataFrame(right, "k string, e date, j int"), "k", "d", "e", forward, strict)

    def nearest(k, d):
        fits = [(e, j) for q, e, j in right if None not in (q, e, k, d) and q == k and (e == d and not strict or (e > d if forward else e < d))]
        best = (min if forward else max)((e for e, _ in fits), default=None)
        return best, min((j for e, j in fits if e == best), default=None)

    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr((k, d, i, *nearest(k, d))) for k, d, i in left)
    matched = [r for r in left if nearest(r[0], r[1])[1] is not None]
    inner = asof.as_of_join(spark.createDataFrame(left, "k string, d date, i int"), spark.createDataFrame(right, "k string, e date, j int"), "k", "d", "e", forward, strict, inner=True)
    assert inner.count() == len(matched) and inner._jdf.queryExecution().executedPlan().toString().count("Join") == 0
    with pytest.raises(ValueError):
        asof.as_of_join(got, got, "k", "d", "e")


def test_range_join_matches_brute_force(spark):
    rng = random.Random(8)
    left, right = ([(rng.choice("abc"), START + timedelta(days=rng.randrange(-90, 90)), i) for i in range(150)] for _ in range(2))
    a, b = spark.createDataFrame(left, "k string, d date, i int"), spark.createDataFrame(right, "k string, e date, j int")
    for least, most in ((1, 35), (0, 0), (-3, 4)):
        got = asof.range_join(a, b, "k", "d", "e", least, most)
        want = [(k, d, i, e, j) for k, d, i in left for q, e, j in right if k == q and least <= (d - e).days <= most]
        assert sorted(map(tuple, got.select("k", "d", "i", "e", "j").collect())) == sorted(want)


def test_means_and_extremes_match_plain_ones(spark):
    rng = random.Random(9)
    price = lambda: rng.choice([None, float("nan"), float("inf")]) if rng.random() < 0.01 else round(rng.uniform(1, 1000), 3)
    rows = [(c, START + timedelta(days=k), 1.0, round(rng.uniform(1, 9), 2) if rng.random() > 0.02 else None, rng.uniform(1, 9), price(), price()) for c in "ab" for k in range(700)]
    f = feat.numbered(spark.createDataFrame(rows, schemas.BAR))
    spans = (2, 3, 20, 60, 224)
    ends = [(n, last) for n in (1, 7, 8, 9, 20, 59, 64, 65, 500) for last in (0, -1, -3)]
    cols = {f"m{n}": ind.sma(n) for n in spans} | {f"b{n}": ind.full_mean("close", n, -1) for n in spans} | {f"p{n}": ind.projected_sma(n) for n in spans[1:]}
    cols |= {f"h{n}_{-last}": ind.extreme("high", n, last) for n, last in ends} | {f"l{n}_{-last}": ind.extreme("low", n, last) for n, last in ends}
    got = {(r["code"], r["dt"]): r for r in f.withColumns(cols).collect()}
    for code in "ab":
        series = [r for r in rows if r[0] == code]
        fine = [x if x is not None and abs(x) < float("inf") else None for x in (r[5] for r in series)]
        for t, r in enumerate(series):
            row = got[code, r[1]]
            for n in spans:
                for name, end in (("m", t + 1), ("b", t)):
                    part = fine[end - n : end] if end >= n else []
                    want = sum(part) / n if part and None not in part else None
                    assert row[f"{name}{n}"] is None if want is None else abs(row[f"{name}{n}"] - want) < 1e-9
            for n, last in ends:
                part = series[max(0, t + last - n + 1) : max(0, t + last + 1)]
                assert row[f"h{n}_{-last}"] == max((x[3] for x in part if x[3] is not None), default=None)
                assert row[f"l{n}_{-last}"] == min((x[4] for x in part), default=None)


def test_no_plan_of_means_holds_a_wide_frame(spark, bars):
    import re

    plan = feat.features(bars)._jdf.queryExecution().executedPlan().toString()
    widths = [int(b) - int(a) for a, b in re.findall(r"specifiedwindowframe\(RowFrame, (-\d+), (-\d+|currentrow)", plan.replace("currentrow$()", "0")) if b.lstrip("-").isdigit()]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    assert widths and max(widths) < ind.STEP


def test_results_fall_back_to_the_default_file(spark, tmp_path):
    from barloom.sources import readers, sinks

    rows = [("v2", "2024-01-02", "a", 1), ("v2", "2024-01-03", "b", 2), (None, "2024-01-02", "x", 3), (None, "2024-01-03", "y", 4), (None, "2024-01-04", "z", 5), ("v2", "2024-01-02", "c", 0)]
    picks = spark.createDataFrame(rows, "strategy string, scan_date string, code string, close bigint").withColumn("scan_date", F.to_date("scan_date"))
    sinks.write_dated_arrays(picks, ["code", "close"], str(tmp_path / "r"))
    (tmp_path / "r" / "scan_results_yey_20240104.json").write_text("[]")
    wanted = spark.createDataFrame([("v2", "2024-01-02"), ("v2", "2024-01-04"), ("yey", "2024-01-03"), ("yey", "2024-01-04"), ("v2", "2024-01-09")], "strategy string, scan_date string").withColumn("scan_date", F.to_date("scan_date"))
    got = readers.read_results(spark, str(tmp_path / "r"), wanted, "code string, close bigint")
    assert sorted((r["strategy"], str(r["scan_date"]), r["found_in"], r["code"]) for r in got.collect()) == [("v2", "2024-01-02", "v2", "a"), ("v2", "2024-01-02", "v2", "c"), ("v2", "2024-01-04", "", "z"), ("yey", "2024-01-03", "", "y")]


def test_first_rows_are_chosen_before_the_shuffle(spark):
    from barloom.operators.joins import dedup_first

    rows = [("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), (None, 5, None), (None, 4, "n")]
    first = dedup_first(spark.createDataFrame(rows, "k string, o int, v string"), ["k"], ["o"])
    assert sorted(map(repr, map(tuple, first.collect()))) == sorted(map(repr, [("a", 1, "y"), (None, 4, "n")]))
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan
