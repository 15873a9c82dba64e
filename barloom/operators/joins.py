"""Enrichment joins and keyed merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the theme of stocks without one.
OTHER = "기타"


def theme_join(picks: DataFrame, themes: DataFrame) -> DataFrame:
    """category (default other), first two subthemes, and the detail text."""
    joined = picks.join(themes.select("code", "category", F.slice("subthemes", 1, 2).alias("__two")), "code", "left")
    category = F.coalesce("category", F.lit(OTHER))
    two = F.coalesce("__two", F.array().cast("array<string>"))
    detail = F.when(F.size(two) > 0, F.concat(category, F.lit(" > "), F.array_join(two, ", "))).otherwise(category)
    return joined.withColumns({"category": category, "subthemes": two, "detail_theme": detail}).drop("__two")


def stock_themes(codes: DataFrame, themes: DataFrame, manual: DataFrame, n: int = 4) -> DataFrame:
    """theme text: the map's tags, else the override's; the first n, else other."""
    tags = F.array_distinct(F.array_compact(F.concat(F.array("category"), F.coalesce("subthemes", F.array().cast("array<string>")))))
    joined = codes.join(themes.select("code", tags.alias("__a")), "code", "left").join(manual.select("code", F.col("tags").alias("__b")), "code", "left")
    some = F.when(F.size(F.coalesce("__a", F.array().cast("array<string>"))) > 0, F.col("__a")).otherwise(F.col("__b"))
    return joined.withColumn("themes", F.coalesce(F.nullif(F.array_join(F.slice(some, 1, n), ", "), F.lit("")), F.lit(OTHER))).drop("__a", "__b")


def name_join(picks: DataFrame, names: DataFrame) -> DataFrame:
    """The map's name where it has one."""
    known = names.select("code", F.col("name").alias("__name"))
    return picks.join(known, "code", "left").withColumn("name", F.coalesce("__name", "name")).drop("__name")


def overview(listing: DataFrame, sector: DataFrame) -> DataFrame:
    """market, marcap and sector (else industry), non-empty only."""
    named = sector.select("code", F.coalesce(F.nullif("sector", F.lit("")), F.nullif("industry", F.lit(""))).alias("sector")).where("sector is not null")
    marcap = F.nanvl("marcap", F.lit(None).cast("double")).cast("long")
    return listing.select("code", "market", marcap.alias("marcap")).join(named, "code", "left")


def corp_join(codes: DataFrame, corp_map: DataFrame) -> DataFrame:
    """Codes with a registry id; of repeated ids the last."""
    last = corp_map.groupBy("stock_code").agg(F.max_by("corp_code", "pos").alias("corp_code"))
    return codes.join(last.withColumnRenamed("stock_code", "code"), "code")


def news_code_join(tokens: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Codes of stock names: the name map (last entry wins), then the alias map, else dropped."""
    by_name = names.groupBy(F.col("name").alias("stock_name")).agg(F.max_by("code", "pos").alias("__a"))
    by_alias = aliases.groupBy(F.col("alias").alias("stock_name")).agg(F.max("code").alias("__b"))
    joined = tokens.join(by_name, "stock_name", "left").join(by_alias, "stock_name", "left")
    return joined.withColumn("code", F.coalesce("__a", "__b")).where("code is not null").drop("__a", "__b")


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an explicit order, then by content (U2): an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.struct(*rest).alias("r"))).alias("__first"))
    return first.select(*(F.col(c) if c in keys else F.col(f"__first.{c}") for c in df.columns))


def merge_keyed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace all old rows of their keys; other keys stay."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
