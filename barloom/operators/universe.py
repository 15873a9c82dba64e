"""Which instruments a scan looks at."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import number_or_null, pad_code, scale_change

#: Markets, and name parts of excluded instruments.
MARKETS = ("KOSPI", "KOSDAQ", "KOSDAQ GLOBAL")
EXCLUDED_END = "우"
EXCLUDED_PARTS = ("우B", "우C", "스팩", "리츠", "레버리지", "인버스", "ETN", "ETF", "하이브리드")


def market_filter(df: DataFrame, markets: tuple[str, ...] = MARKETS) -> DataFrame:
    return df.where(F.col("market").isin(*markets))


def exclude_instruments(df: DataFrame, null_is_excluded: bool = True) -> DataFrame:
    """Drop preferred shares, funds and the like by their names."""
    bad = F.col("name").endswith(EXCLUDED_END) | F.col("name").rlike("|".join(EXCLUDED_PARTS))
    return df.where(~F.coalesce(bad, F.lit(null_is_excluded)))


def prefilter_turnover_change(listing: DataFrame, min_turnover: float = 150e8, min_change: float = 3.0, min_rows: int = 5, scale: str = "guess") -> DataFrame:
    """Rows of enough turnover and rise; if fewer than min_rows are, of enough turnover alone."""
    loose = F.coalesce(F.col("volume") * F.col("close") >= min_turnover, F.lit(False))
    strict = loose & F.coalesce(scale_change(F.col("change"), scale) >= min_change, F.lit(False))
    marked = listing.withColumns({"__loose": loose, "__strict": strict}).where("__loose")
    enough = marked.agg((F.count_if("__strict") >= min_rows).alias("__enough"))  # one row
    return marked.crossJoin(F.broadcast(enough)).where("__strict or not __enough").drop("__loose", "__strict", "__enough")


def resolve_columns(df: DataFrame) -> DataFrame:
    """Rename volume, price and change columns by the names that sources use; the last match wins."""
    found: dict[str, str] = {}
    for name in df.columns:
        low = name.lower()
        if "volume" in low or low == "vol":
            found["volume"] = name
        elif low in ("close", "price", "lastsale"):
            found["close"] = name
        elif "change" in low:
            found["change"] = name
    return df.withColumnsRenamed({old: new for new, old in found.items()})


def predictive_only(df: DataFrame) -> DataFrame:
    return df.where("match_type = 'predictive'")


def day0_only(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce("elapsed_days", F.lit(-1)) == 0)


def latest_price_snapshot(listing: DataFrame, change_cols: tuple[str, ...] = ("change",)) -> DataFrame:
    """code, name, close (missing: 0), rate (rounded half-even to 2) from the first change column that has a value."""
    rate = F.coalesce(*(number_or_null(F.col(c)) for c in change_cols), F.lit(0.0))
    return listing.select("code", "name", F.coalesce(number_or_null(F.col("close")), F.lit(0.0)).cast("long").alias("close"), F.bround(rate, 2).alias("rate"))


def trading_day_target(ts: Column, zone: str = "Asia/Seoul") -> Column:
    """The local date; on a weekend the Friday before."""
    day = F.from_utc_timestamp(ts, zone).cast("date")
    return F.date_sub(day, F.greatest(F.weekday(day) - 4, F.lit(0)))


def top_universe(listing: DataFrame, n: int = 800, markets: tuple[str, ...] = MARKETS, scale: str = "guess") -> DataFrame:
    """The n listings of the largest amount in the given markets, by amount then code."""
    top = market_filter(listing, markets).orderBy(F.desc(F.coalesce("amount", F.lit(0.0))), "code").limit(n)
    return top.withColumns({"code": pad_code(F.col("code")), "rate": scale_change(F.col("change"), scale)}).where("close > 0")


def full_universe(*listings: DataFrame) -> DataFrame:
    """All listings of all markets less the excluded instruments."""
    return exclude_instruments(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), listings))


def with_fallback(prefiltered: DataFrame, full: DataFrame) -> DataFrame:
    """The prefiltered listings, or all of full if there are none."""
    none = prefiltered.agg((F.count("*") == 0).alias("__none"))  # one row
    rest = full.crossJoin(F.broadcast(none)).where("__none").drop("__none")
    return prefiltered.unionByName(rest, allowMissingColumns=True)
