"""Writers of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranking import keep_newest_dates
from .store import PartStore

#: Names of the published snapshots; parts of a report's name that its technique's key lacks.
OVERVIEW_FILE, LATEST_FILE = "stock_overview.json", "latest_prices.json"
REPORT_PARTS = ("차트", "기법")


def by_file(df: DataFrame, *by: str) -> DataFrame:
    """Rows that share a file in one task, files spread over the session's shuffle partitions: many small files cost by number, not by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def replacing(df: DataFrame) -> DataFrameWriter:
    """A writer that replaces only the partitions that df holds.

    Tasks move their own files into the job's staging folder (algorithm 2); what readers see changes when the job ends.
    """
    return df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("mapreduce.fileoutputcommitter.algorithm.version", "2")


def write_picks(df: DataFrame, path: str, fmt: str = "json") -> None:
    """one partition a date and strategy; a rerun replaces only the dates it holds.

    Rows of a partition come together first, so there is a file for each and not one for each of a task's partitions.
    """
    replacing(by_file(df, "scan_date", "strategy")).partitionBy("scan_date", "strategy").format(fmt).save(path)


def write_bars(df: DataFrame, path: str) -> None:
    """The bar store by month; only the months of df are replaced."""
    months = df.withColumn("month", F.date_format("dt", "yyyy-MM"))
    months.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def write_integrated(scan_results: DataFrame, ma_stocks: DataFrame, path: str) -> None:
    """an object a date and line."""
    write_text(integrated(scan_results, ma_stocks), path)


def integrated(scan_results: DataFrame, ma_stocks: DataFrame, by: str = "scan_date") -> DataFrame:
    """per date one object {scan_results, ma_stocks}, arrays in their pos order."""
    def packed(df: DataFrame, name: str) -> DataFrame:
        fields = [c for c in df.columns if c not in (by, "pos")]
        rows = F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("r"))))
        return df.groupBy(by).agg(F.transform(rows, lambda x: x["r"]).alias(name))

    joined = packed(scan_results, "scan_results").join(packed(ma_stocks, "ma_stocks"), by, "full")
    return joined.select(by, F.to_json(F.struct(by, "scan_results", "ma_stocks")).alias("value"))


def nested_history(history: DataFrame) -> DataFrame:
    """JSON objects {yyyymmdd: {strategy: [pick]}}, one for each date and strategy, picks in their pos order.

    A row for each, so that no task holds more than one date's picks of a strategy.
    """
    fields = [c for c in history.columns if c not in ("scan_date", "strategy", "pos")]
    rows = F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("r"))))
    lists = history.groupBy("scan_date", "strategy").agg(F.transform(rows, lambda x: x["r"]).alias("l"))
    day = F.date_format("scan_date", "yyyyMMdd")
    return lists.select(F.to_json(F.create_map(day, F.create_map("strategy", "l"))).alias("value"))


def merged_history(history: DataFrame, keep: int = 5, most: int = 15) -> DataFrame:
    """one object {yyyymmdd: {strategy: [pick]}} of the keep newest dates, newest first.

    Of each list the first most picks by pos, as many as a dashboard shows; so the one row that is made
    stays small at any size of the history. No dates: an empty object. Rows without a date are left out;
    a null strategy is "".
    """
    fields = [c for c in history.columns if c not in ("scan_date", "strategy", "pos")]
    held = keep_newest_dates(history.where("scan_date is not null"), keep).withColumn("strategy", F.coalesce("strategy", F.lit("")))
    first = Window.partitionBy("scan_date", "strategy").orderBy("pos", *fields)
    cut = held.withColumn("__no", F.row_number().over(first)).where(F.col("__no") <= most)
    rows = F.array_sort(F.collect_list(F.struct("__no", F.struct(*fields).alias("r"))))
    lists = cut.groupBy("scan_date", "strategy").agg(F.transform(rows, lambda x: x["r"]).alias("l"))
    days = lists.groupBy("scan_date").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("strategy", "l")))).alias("m"))
    newest = F.reverse(F.array_sort(F.collect_list(F.struct(F.date_format("scan_date", "yyyyMMdd").alias("day"), F.struct(F.to_json("m").alias("j")).alias("s")))))
    parts = F.transform(newest, lambda x: F.concat(F.lit('"'), x["day"], F.lit('":'), x["s"]["j"]))
    return days.agg(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("value"))


def keyed_json(df: DataFrame, key: str = "code") -> DataFrame:
    """key and the JSON of the other columns."""
    return df.select(key, F.to_json(F.struct(*(c for c in df.columns if c != key))).alias("value"))


def yearly_json(financials: DataFrame) -> DataFrame:
    """per code the array of its years."""
    fields = [c for c in financials.columns if c != "code"]
    years = F.array_sort(F.collect_list(F.struct("year", *(c for c in fields if c != "year"))))
    return financials.groupBy("code").agg(F.to_json(years).alias("value"))


def write_keyed(rows: DataFrame, path: str, key: str = "code") -> None:
    """lines {key: value} of keyed or yearly JSON."""
    write_text(rows.select(F.concat(F.lit("{"), F.to_json(F.array(key)).substr(F.lit(2), F.length(F.to_json(F.array(key))) - 2), F.lit(":"), "value", F.lit("}")).alias("value")), path)


def write_snapshots(overview: DataFrame, latest: DataFrame, path: str) -> None:
    """the overview (J6) and the latest prices (P12), each as lines keyed by code under its published name."""
    write_keyed(keyed_json(overview), f"{path}/{OVERVIEW_FILE}")
    write_keyed(keyed_json(latest), f"{path}/{LATEST_FILE}")


def publish_latest(picks: DataFrame) -> DataFrame:
    """the newest dated result of each strategy."""
    newest = picks.groupBy("strategy").agg(F.max("scan_date").alias("scan_date"))
    return picks.join(newest, ["strategy", "scan_date"], "left_semi").select(*picks.columns)


def latest_store(spark: SparkSession, path: str, schema: str) -> PartStore:
    """The published results under latest/, a part a strategy."""
    return PartStore(spark, f"{path}/latest", schema, F.col("strategy"), "json")


def write_latest(picks: DataFrame, path: str) -> None:
    """publish the newest results by one commit; strategies without picks keep theirs."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picks.schema.fields)
    latest_store(picks.sparkSession, path, schema).replace(publish_latest(picks))


def write_dated_arrays(picks: DataFrame, fields: list[str], path: str) -> None:
    """A JSON array of picks for each date and strategy, in the order of pos, if any, and fields; in a folder named as its dated file (a null strategy: the day's default)."""
    name = F.concat(F.lit("scan_results_"), F.coalesce(F.concat("strategy", F.lit("_")), F.lit("")), F.date_format("scan_date", "yyyyMMdd"), F.lit(".json"))
    write_arrays(picks, name, fields, [c for c in ("pos", *fields) if c in picks.columns], path)


def write_arrays(rows: DataFrame, name: Column, fields: list[str], order: list[str], path: str) -> None:
    """A JSON array of the fields for each name, in a folder file=<name>."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*fields).alias("r")))), lambda x: x["r"])
    arrays = by_file(rows.withColumn("file", name), "file").groupBy("file").agg(F.to_json(items).alias("value"))
    replacing(arrays).partitionBy("file").text(path)


def write_text(df: DataFrame, path: str) -> None:
    """One JSON value to a line."""
    df.select("value").write.mode("overwrite").text(path)


def technique_key(report: Column, parts: tuple[str, ...] = REPORT_PARTS) -> Column:
    """A report's name without the fixed parts and outer underscores, in lower case."""
    for part in parts:
        report = F.replace(report, F.lit(part), F.lit(""))
    return F.lower(F.btrim(report, F.lit("_")))


def write_dashboard(rows: DataFrame, path: str, parts: tuple[str, ...] = REPORT_PARTS) -> None:
    """ranked dashboard rows (Q8) as one JSON array a technique and date, in a folder dashboard_<key>_<yyyymmdd>.json.

    The strategy column names the report; missing numbers are 0, missing texts empty. A rerun replaces the
    files that it writes and leaves those of other dates.
    """
    numbers = {c: F.coalesce(c, F.lit(0)) for c in ("close", "rate")}
    texts = {c: F.coalesce(c, F.lit("")) for c in ("name", "pattern", "comment", "chart")}
    name = F.concat(F.lit("dashboard_"), F.coalesce(technique_key(F.col("strategy"), parts), F.lit("")), F.lit("_"), F.date_format("scan_date", "yyyyMMdd"), F.lit(".json"))
    fields = ["code", "name", "close", "rate", "pattern", "comment", "chart"]
    write_arrays(rows.withColumns(numbers | texts), name, fields, ["rank", "strategy", "code"], path)
