"""Financial statements as yearly rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import parse_amount, parse_year, to_base_unit

#: Account labels of each measure, in the order of preference.
ACCOUNTS = {"revenue": ("매출액", "수익(매출액)"), "operating_profit": ("영업이익",), "net_income": ("당기순이익", "당기순이익(손실)")}
AMOUNTS = list(ACCOUNTS)


def prefer_consolidated(filings: DataFrame) -> DataFrame:
    """Of each (code, year) the consolidated rows if there are any, else the separate ones."""
    w = Window.partitionBy("code", "year")
    best = F.min(F.when(F.col("fs_div") == "CFS", 0).otherwise(1)).over(w)
    return filings.withColumn("__best", best).where(F.when(F.col("fs_div") == "CFS", 0).otherwise(1) == F.col("__best")).drop("__best")


def account_pivot(filings: DataFrame) -> DataFrame:
    """A row per (code, year); of a repeated account the last row counts, even if it has no amount."""
    def last(label: str):
        row = F.max(F.when(F.trim("account_nm") == label, F.struct("pos", parse_amount(F.col("thstrm_amount")).alias("amount"))))
        return row["amount"].cast("long")

    return filings.groupBy("code", "year").agg(*(F.coalesce(*map(last, labels)).alias(name) for name, labels in ACCOUNTS.items()))


def financial_statement_long(filings: DataFrame, years: int = 3) -> DataFrame:
    """The last years of each code, without years that have no amount."""
    rows = account_pivot(prefer_consolidated(filings)).where(F.coalesce(*AMOUNTS).isNotNull())
    newest = F.dense_rank().over(Window.partitionBy("code").orderBy(F.desc("year")))
    return rows.withColumn("__rn", newest).where(F.col("__rn") <= years).drop("__rn")


def financial_table_long(cells: DataFrame) -> DataFrame:
    """Table cells as yearly rows: the first row whose label starts with a key, by column position."""
    long = None
    for name, labels in ACCOUNTS.items():
        starts = F.lit(False)
        for label in labels:
            starts |= F.col("label").startswith(label)
        first = cells.where(starts).withColumn("__r", F.min("row").over(Window.partitionBy("code"))).where(F.col("row") == F.col("__r"))
        part = first.select("code", parse_year(F.col("header")).alias("year"), F.lit(name).alias("measure"), to_base_unit(parse_amount(F.col("text"))).alias("amount"))
        long = part if long is None else long.unionByName(part)
    wide = long.where("year is not null").groupBy("code", "year").pivot("measure", AMOUNTS).agg(F.first("amount"))
    return wide.where(F.coalesce(*AMOUNTS).isNotNull())
