"""Readers of the store and of published files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.scalars import parse_two_date_formats
from ..plans.features import as_of
from .store import PartStore


def read_bars_window(spark: SparkSession, path: str, target: str, lookback_days: int | None = 400) -> DataFrame:
    """Bars of the days up to the target; only the months of the window are listed, and the date filter reaches their scan."""
    stored, end = spark.read.parquet(path), F.lit(target).cast("date")
    stored = stored.where(F.col("month") <= F.date_format(end, "yyyy-MM"))
    if lookback_days is not None:
        stored = stored.where(F.col("month") >= F.date_format(F.date_sub(end, lookback_days), "yyyy-MM"))
    return as_of(stored, target, lookback_days).select("code", "dt", "open", "high", "low", "close", "volume")


def recent_candles(rows: DataFrame, as_of_date: str, days: int = 20) -> DataFrame:
    """Rows of the last days by their text date; rows with bad dates go."""
    return rows.where(parse_two_date_formats(F.col("date")) >= F.date_sub(F.lit(as_of_date).cast("date"), days))


def read_candle_log(spark: SparkSession, path: str, as_of_date: str, days: int = 20) -> DataFrame:
    """NDJSON rows of the last days; blank lines, bad JSON and bad dates are skipped."""
    raw = spark.read.schema(schemas.CANDLE_LOG + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return recent_candles(raw.where("_corrupt_record is null").drop("_corrupt_record"), as_of_date, days)


def candle_log(spark: SparkSession, path: str) -> PartStore:
    """A log of candles that is replaced as a whole."""
    return PartStore(spark, path, schemas.CANDLE_LOG, F.lit("log"), "json")


def prune_candle_log(log: PartStore, as_of_date: str, days: int = 20) -> None:
    """Keep the last days, by one commit; readers see the log before or after."""
    log.replace(recent_candles(log.read(), as_of_date, days))


def result_name(part: int, of: str) -> Column:
    """Strategy (1; empty in a default file) or day (2) of a file scan_results_[<strategy>_]<yyyymmdd>.json."""
    return F.regexp_extract(of, r"scan_results_(?:([^/]*)_)?(\d{8})\.json", part)


def read_picks_json(spark: SparkSession, path: str, schema: str = schemas.PICK_JSON) -> DataFrame:
    """Arrays of picks, one file (or folder) a day and strategy; the strategy of a default file is empty."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    columns = [f.split()[0] for f in schema.split(",")]
    return rows.select(F.to_date(result_name(2, "_metadata.file_path"), "yyyyMMdd").alias("scan_date"), result_name(1, "_metadata.file_path").alias("strategy"), *columns)


def read_results(spark: SparkSession, path: str, wanted: DataFrame, schema: str = schemas.PICK_JSON) -> DataFrame:
    """For each wanted (strategy, scan_date) the picks of its file, or of the day's default file where it has none.

    What exists is a listing of the folder, so a file with an empty array counts as there. found_in is
    the strategy of the file that was read, empty for the default.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    own = listed.select(result_name(1, "path").alias("strategy"), F.to_date(result_name(2, "path"), "yyyyMMdd").alias("scan_date")).where("strategy <> ''").distinct().withColumn("found_in", F.col("strategy"))
    asked = wanted.select("strategy", "scan_date").distinct().join(own, ["strategy", "scan_date"], "left").withColumn("found_in", F.coalesce("found_in", F.lit("")))
    return asked.join(read_picks_json(spark, path, schema).withColumnRenamed("strategy", "found_in"), ["scan_date", "found_in"])


def read_themes(raw: DataFrame) -> DataFrame:
    """tags: category and subthemes in order, each once; a list form (tags) stays as it is."""
    empty = F.array().cast("array<string>")
    made = F.array_distinct(F.array_compact(F.concat(F.array("category"), F.coalesce("subthemes", empty))))
    return raw.withColumn("tags", F.coalesce("tags", made) if "tags" in raw.columns else made)


def read_history(spark: SparkSession, path: str, pick: str = schemas.PICK_JSON) -> DataFrame:
    """{date: {strategy: [pick]}}, one object to a line, as rows with scan_date, strategy, pos."""
    fields = ",".join(f.strip().replace(" ", ":", 1) for f in pick.split(","))
    text = spark.read.text(path)
    days = text.select(F.explode(F.from_json("value", f"map<string,map<string,array<struct<{fields}>>>>")).alias("d", "s"))
    rows = days.select("d", F.explode("s").alias("strategy", "p")).select("d", "strategy", F.posexplode("p").alias("pos", "pick"))
    return rows.select(parse_two_date_formats(F.col("d")).alias("scan_date"), "strategy", "pos", "pick.*")


def read_dashboard(spark: SparkSession, path: str) -> DataFrame:
    """Dashboard files as rows with technique, scan_date and pos (from 0)."""
    fields = ",".join(f.strip().replace(" ", ":", 1) for f in schemas.DASHBOARD.split(","))
    files = spark.read.text(path, wholetext=True)
    name = lambda part: F.regexp_extract("file", r"dashboard_(.*)_(\d{8})\.json", part)
    rows = files.select(name(1).alias("technique"), F.to_date(name(2), "yyyyMMdd").alias("scan_date"), F.posexplode(F.from_json("value", f"array<struct<{fields}>>")).alias("pos", "row"))
    return rows.select("technique", "scan_date", "pos", "row.*")


def read_keyed(spark: SparkSession, path: str, schema: str, key: str = "code") -> DataFrame:
    """Lines or whole objects {key: {...}} as rows."""
    fields = ",".join(f.strip().replace(" ", ":", 1) for f in schema.split(","))
    rows = spark.read.text(path).select(F.explode(F.from_json("value", f"map<string,struct<{fields}>>")).alias(key, "v"))
    return rows.select(key, "v.*")


def read_near_ma_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """One near-mean pick to a line."""
    return spark.read.schema(schemas.NEAR_MA_PICK).json(path).where("code is not null")


def read_news_files(spark: SparkSession, path: str) -> DataFrame:
    """path and text of each whole file."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
