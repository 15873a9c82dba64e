"""The keyed bar store (S2-S8) as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import falsy_default, number_or_null

KEYS = ["code", "dt"]
FIELDS = ["open", "high", "low", "close", "volume"]


def bars_from_listing(listing: DataFrame, dt: Column | str) -> DataFrame:
    """Today's bar of each listed code: missing prices are the close, a missing volume 0; close > 0."""
    zero = F.lit(0.0)
    close = falsy_default(number_or_null(F.col("close")), zero)
    prices = [falsy_default(number_or_null(F.col(n)), close).alias(n) for n in ("open", "high", "low")]
    day = F.lit(dt).cast("date") if isinstance(dt, str) else dt
    return listing.select("code", day.alias("dt"), *prices, close.alias("close"), falsy_default(number_or_null(F.col("volume")), zero).alias("volume")).where("close > 0")


def upsert_bars(store: DataFrame, batch: DataFrame, seq_col: str | None = None) -> DataFrame:
    """Insert or replace on (code, dt): a bar of the batch wins; inside it the largest seq_col, then the largest values.

    An aggregate that combines before the shuffle, so repeated keys travel once.
    """
    order = F.col(seq_col) if seq_col else F.lit(0)
    old = store.select(*KEYS, *FIELDS, F.lit(0).alias("__batch"), F.lit(None).cast("long").alias("__seq"))
    new = batch.select(*KEYS, *FIELDS, F.lit(1).alias("__batch"), order.cast("long").alias("__seq"))
    order = F.struct("__batch", F.coalesce("__seq", F.lit(-(2**63))), *FIELDS)
    newest = old.unionByName(new).groupBy(*KEYS).agg(F.max_by(F.struct(*FIELDS), order).alias("bar"))
    return newest.select(*KEYS, "bar.*")


def bars_complete(bars: DataFrame, min_codes: int = 1000) -> DataFrame:
    """dt, n_bars, complete."""
    return bars.groupBy("dt").agg(F.count("*").alias("n_bars")).withColumn("complete", F.col("n_bars") >= min_codes)


def find_missing_days(bars: DataFrame, target: str, lookback_days: int = 20, max_gap_days: int = 10, min_codes: int = 1000) -> DataFrame:
    """dt, n_bars of the weekdays before the target with too few bars; none if there are too many such days."""
    spark, end = bars.sparkSession, F.lit(target).cast("date")
    days = spark.range(1).select(F.explode(F.sequence(F.date_sub(end, lookback_days), F.date_sub(end, 1))).alias("dt")).where(F.weekday("dt") < 5)
    recent = bars.where(F.col("dt").between(F.date_sub(end, lookback_days), F.date_sub(end, 1))).groupBy("dt").agg(F.count("*").alias("n"))
    short = days.join(recent, "dt", "left").select("dt", F.coalesce("n", F.lit(0)).alias("n_bars")).where(F.col("n_bars") < min_codes)
    return short.withColumn("__all", F.count("*").over(Window.partitionBy())).where(F.col("__all") <= max_gap_days).drop("__all")


def backfill_rows(history: DataFrame, universe: DataFrame, missing: DataFrame) -> DataFrame:
    """The history of the universe's codes over the whole span of the missing days."""
    span = missing.agg(F.min("dt").alias("__from"), F.max("dt").alias("__to"))
    rows = history.crossJoin(F.broadcast(span)).where(F.col("dt").between(F.col("__from"), F.col("__to"))).join(universe.select("code").distinct(), "code", "left_semi")
    filled = [falsy_default(number_or_null(F.col(n)), F.col("close")).alias(n) for n in ("open", "high", "low")]
    return rows.select(*KEYS, *filled, "close", falsy_default(number_or_null(F.col("volume")), F.lit(0.0)).alias("volume"))


def backfill_bars(store: DataFrame, history: DataFrame, universe: DataFrame, missing: DataFrame) -> DataFrame:
    """The store with the history over the missing days; bars outside their span stay as they are."""
    span = missing.agg(F.min("dt").alias("__from"), F.max("dt").alias("__to"))
    placed = store.crossJoin(F.broadcast(span)).withColumn("__in", F.coalesce(F.col("dt").between(F.col("__from"), F.col("__to")), F.lit(False)))
    inside, outside = placed.where("__in"), placed.where("not __in")
    return outside.select(*KEYS, *FIELDS).unionByName(upsert_bars(inside, backfill_rows(history, universe, missing)))


def prune_bars(bars: DataFrame, target: str, days_to_keep: int = 430) -> DataFrame:
    """Bars of the kept days; on a store partitioned by month whole partitions drop out."""
    first = F.date_sub(F.lit(target).cast("date"), days_to_keep)
    kept = bars.where(F.col("dt") >= first)
    return kept.where(F.col("month") >= F.date_format(first, "yyyy-MM")) if "month" in bars.columns else kept


def sync_bars(store: DataFrame, listing: DataFrame, history: DataFrame, target: str, min_codes: int = 1000) -> DataFrame:
    """Prune, repair gaps, then take today's listing unless the day is complete already."""
    kept = prune_bars(store, target)
    repaired = backfill_bars(kept, history, listing, find_missing_days(kept, target, min_codes=min_codes))
    done = repaired.where(F.col("dt") == F.lit(target).cast("date")).agg((F.count("*") >= min_codes).alias("__done"))
    today = bars_from_listing(listing, target).crossJoin(F.broadcast(done)).where("not __done").drop("__done")
    return upsert_bars(repaired, today)


def bars_per_date(bars: DataFrame) -> DataFrame:
    return bars.groupBy("dt").agg(F.count("*").alias("n_bars"))


def bars_per_code(bars: DataFrame) -> DataFrame:
    return bars.groupBy("code").agg(F.count("*").alias("n_bars"))
