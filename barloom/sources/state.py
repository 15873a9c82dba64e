"""A state per code: the bars of the last days with their running sums, for scans as of one date.

A row a code holds the ring of its bars of the last keep_days, each with the running sums and counts up to
it. A day's batch advances all rings in one pass; a scan reads one row a code and finds what the feature pass
gives its last bar (means as differences of two sums) without an exchange, a sort or a window.

States are bucketed tables by code: advancing shuffles the batch only, as long as there are at least as many
buckets as spark.sql.shuffle.partitions. Each version is a folder of its own under a manifest (see store.py),
so readers see the state before or after a batch. The catalog entry of a version is made anew where a
session doesn't know it; the path is what lasts.

Bounds: a ring has at most one bar a day of keep_days, whatever the length of the history.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.indicators import percent
from ..functions.patterns import yes
from ..operators import bars as ops
from ..plans.features import MEANS
from .store import PartStore

BAR = "dt:date,open:double,high:double,low:double,close:double,volume:double"
SUMS = "n:bigint,whole:double,part:double"
STATE = f"code string, bars array<struct<{BAR},s_close:struct<{SUMS}>,s_volume:struct<{SUMS}>>>"


def finite(x: Column) -> Column:
    return F.when(F.abs(x) < float("inf"), x)


def added(sums: Column, x: Column) -> Column:
    """Running number and sum (whole parts, fractions) with one more value; one that is null or not finite adds nothing."""
    v = F.coalesce(finite(x), F.lit(0.0))
    one = finite(x).isNotNull().cast("bigint")
    return F.struct((sums["n"] + one).alias("n"), (sums["whole"] + (v - v % 1)).alias("whole"), (sums["part"] + v % 1).alias("part"))


def with_sums(ring: Column) -> Column:
    """Bars in the order of their days, each with the running sums of closes and volumes."""
    plain = F.array_sort(F.transform(ring, lambda b: F.struct(b["dt"].alias("dt"), *(b[f].alias(f) for f in ops.FIELDS))))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("whole"), F.lit(0.0).alias("part"))
    empty = F.from_json(F.lit("[]"), STATE.partition("bars ")[2])
    start = F.struct(zero.alias("c"), zero.alias("v"), empty.alias("out"))

    def step(s: Column, b: Column) -> Column:
        c, v = added(s["c"], b["close"]), added(s["v"], b["volume"])
        bar = F.struct(b["dt"].alias("dt"), *(b[f].alias(f) for f in ops.FIELDS), c.alias("s_close"), v.alias("s_volume"))
        return F.struct(c.alias("c"), v.alias("v"), F.concat(s["out"], F.array(bar)).alias("out"))

    return F.aggregate(plain, start, step, lambda s: s["out"])


class CodeState(PartStore):
    """The state of all codes at a path. It may be advanced to any later date, by batches that also correct bars it still holds."""

    def __init__(self, spark: SparkSession, path: str, keep_days: int = 400, buckets: int | None = None):
        super().__init__(spark, path, STATE, F.lit("state"))
        self.keep_days = keep_days
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _table(self, folder: str) -> str:
        """The catalog's name of a version; its folder is data/<id>/__part=<buckets>."""
        name = f"code_state_{folder.split('/')[1]}"
        if not self.spark.catalog.tableExists(name):
            buckets = int(folder.rpartition("=")[2])
            self.spark.sql(f"CREATE TABLE {name} ({STATE}) USING parquet CLUSTERED BY (code) INTO {buckets} BUCKETS LOCATION '{self.path}/{folder}'")
        return name

    def read(self, only=None) -> DataFrame:
        """code, bars: the newest version, in its buckets; no rows before the first batch."""
        known = self.parts()
        return self.spark.table(self._table(next(iter(known.values())))) if known else self.spark.createDataFrame([], STATE)

    def write(self, rows: DataFrame) -> dict[str, str]:
        version = uuid.uuid4().hex
        folder = f"data/{version}/__part={self.buckets}"
        rows.select("code", "bars").write.bucketBy(self.buckets, "code").format("parquet").option("path", f"{self.path}/{folder}").saveAsTable(f"code_state_{version}")
        return {str(self.buckets): folder}

    def vacuum(self, keep: int = 2) -> None:
        """Also takes versions that are deleted from the catalog."""
        before = set(self._names("data"))
        super().vacuum(keep)
        for version in before - set(self._names("data")):
            self.spark.sql(f"DROP TABLE IF EXISTS code_state_{version}")

    def advance(self, batch: DataFrame, target: str, seq_col: str | None = None) -> None:
        """Take the batch's bars up to the target: new ones join the rings, those of a known day replace it.

        Bars older than keep_days before the target leave; codes without any left leave too. Of
        repeated keys of a batch the one that upsert_bars takes counts. The first batch makes the state.
        """
        end = F.lit(target).cast("date")
        kept = lambda b: b["dt"].between(F.date_sub(end, self.keep_days), end)
        rows = batch.where(F.col("code").isNotNull() & F.col("dt").between(F.date_sub(end, self.keep_days), end))
        rows = ops.upsert_bars(rows.limit(0), rows, seq_col)
        new = rows.groupBy("code").agg(F.collect_list(F.struct("dt", *ops.FIELDS)).alias("__new"))  # a bar a day of keep_days at most
        joined = self.read().join(new.hint("shuffle_hash"), "code", "full_outer")
        fresh = F.coalesce("__new", F.array().cast(f"array<struct<{BAR}>>"))
        days = F.transform(fresh, lambda b: b["dt"])
        joined = joined.withColumns({"__fresh": fresh, "__days": days})
        old = F.transform(F.filter("bars", lambda b: kept(b) & ~F.array_contains("__days", b["dt"])), lambda b: F.struct(b["dt"].alias("dt"), *(b[f].alias(f) for f in ops.FIELDS)))
        rings = joined.select("code", F.concat(F.coalesce(old, F.array().cast(f"array<struct<{BAR}>>")), "__fresh").alias("ring")).where(F.size("ring") > 0)
        self.commit(self.write(rings.select("code", with_sums(F.col("ring")).alias("bars"))), self.parts())


def last_features(state: DataFrame, target: str, lookback_days: int = 400, universe: DataFrame | None = None, breakout_turnover: float = 2e9, breakout_surge: float = 2.5, k: int = 30) -> DataFrame:
    """The features of each code's last bar in the slice of lookback_days up to the target, from its ring.

    The scans take this as their bars, with the same target; as_of tells them that it has one row a code.
    lookback_days must not exceed the keep_days of the state, nor may the target lie after bars it lacks.
    The breakouts that scan_breakout_retest looks for are found with the thresholds given here.
    """
    if universe is not None:
        state = state.join(universe.select("code").distinct(), "code", "left_semi")
    end = F.lit(target).cast("date")
    ring = F.filter("bars", lambda b: b["dt"].between(F.date_sub(end, lookback_days), end))
    rows = state.select("code", end.alias("as_of"), ring.alias("__r")).where(F.size("__r") > 0)
    rows = rows.withColumn("n_bars", F.size("__r"))
    n = F.col("n_bars")

    def at(offset: Column | int) -> Column:
        """The bar at an offset from the last, null outside the slice."""
        return F.get("__r", n - 1 - offset)

    def mean(name: str, width: int, offset: Column | int = 0) -> Column:
        """Mean of `width` values that end at an offset; null unless the slice holds all."""
        last, first = at(offset)[f"s_{name}"], at(offset + (width - 1))
        before, own = first[f"s_{name}"], finite(first[name])
        v = F.coalesce(own, F.lit(0.0))
        count = last["n"] - before["n"] + own.isNotNull().cast("bigint")
        return F.when(count == width, ((last["whole"] - before["whole"] + (v - v % 1)) + (last["part"] - before["part"] + v % 1)) / width)

    def extreme(name: str, first: Column, last: Column) -> Column:
        """Extreme of the bars at the places first to last (from 1, as far as they exist)."""
        start = F.greatest(first, F.lit(1))
        values = F.transform(F.slice("__r", start, F.greatest(last - start + 1, F.lit(0))), lambda b: b[name])
        return F.array_max(values) if name == "high" else F.array_min(values)

    def pre_low(offset: Column | int) -> Column:
        return extreme("low", n - 60 - offset, n - 3 - offset)

    spans = (60, 120, 224)
    ages = F.sequence(F.lit(0), F.lit(k))

    def means(name: str, width: int) -> Column:
        """The means that end at offsets 0 to k."""
        return F.transform(ages, lambda j: mean(name, width, j))

    rows = rows.withColumns({f"__m{w}": means("close", w) for w in spans} | {"__v20": means("volume", 20)})

    def crossed(width: int):
        def flag(j: Column) -> Column:
            b = at(j)
            rise = (b["close"] > F.get(f"__m{width}", j)) & (at(j + 1)["close"] <= F.get(f"__m{width}", j + 1))
            return yes(rise & (b["close"] * b["volume"] >= breakout_turnover) & (b["volume"] >= breakout_surge * F.get("__v20", j)))

        return flag

    rows = rows.withColumns({f"__a{w}": F.get(F.filter(F.slice(ages, 1, k), crossed(w)), F.lit(0)) for w in spans})
    zero = F.lit(0)
    cols = {f: at(0)[f] for f in ("dt", *ops.FIELDS)}
    cols |= {f"ma{w}": F.get(f"__m{w}", zero) if w in spans else mean("close", w) for w in MEANS}
    cols |= {"v5": mean("volume", 5), "v20": F.get("__v20", zero), "v20_1": F.get("__v20", zero + 1), "ma5_1": mean("close", 5, 1), "ma20_1": mean("close", 20, 1)}
    cols |= {"ret": percent(at(0)["close"], at(1)["close"]), "ret1": percent(at(1)["close"], at(2)["close"]), "c1": at(1)["close"], "o1": at(1)["open"], "vol1": at(1)["volume"]}
    cols |= {"n_bars": n, "bar_no": n, "win_high": extreme("high", n - 499, n), "pre_low": pre_low(0)}
    cols |= {f"b{w}": F.when(F.col(f"__a{w}").isNotNull(), F.struct((n - F.col(f"__a{w}")).alias("bar_no"), pre_low(F.col(f"__a{w}")).alias("low60"))) for w in spans}
    # as one entry of an array, so that the filters of scans aren't rewritten in terms of the rings
    return rows.select("code", "as_of", F.inline(F.array(F.struct(*(c.alias(name) for name, c in cols.items())))))
