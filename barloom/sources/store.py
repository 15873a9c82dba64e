"""Stores whose parts are replaced by atomic commits.

A store keeps its rows in parts (months of bars, strategies of results), each a folder of files. A manifest
names the folder of each part. A change writes the parts it touches into new folders beside the
old ones and then the next manifest, by a rename: readers see the old state or the new one, never
a mix, a write that dies before the rename leaves the old state, and untouched parts keep their files.
Folders that the newest manifests don't name are deleted after a commit; the manifest before the
newest keeps its own, so that readers which started before can end. One writer at a time.

All file access goes through Hadoop's file system of the path. A manifest has a line a part, however
many rows there are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from datetime import date, timedelta
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import bars as ops
from ..operators.ranking import replace_date_slice

#: Manifests whose folders are kept.
KEPT = 2
#: The part of rows whose part is null.
NO_PART = "__HIVE_DEFAULT_PARTITION__"


class PartStore:
    """Rows of a schema in parts by a text column."""

    def __init__(self, spark: SparkSession, path: str, schema: str, part: Column, fmt: str = "parquet"):
        self.spark, self.path, self.schema, self.part, self.fmt = spark, path.rstrip("/"), schema, part, fmt
        self._new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._new(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._new(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _versions(self) -> list[str]:
        return [n for n in self._names("manifests") if n.endswith(".json") and not n.startswith((".", "_"))]

    def _load(self, name: str) -> dict[str, str]:
        lines = self.spark.read.text(f"{self.path}/manifests/{name}").collect()  # a line a part
        return dict(json.loads(r["value"]) for r in lines)

    def parts(self) -> dict[str, str]:
        """The folder of each part, relative to the store; none where nothing was committed yet."""
        versions = self._versions()
        return self._load(versions[-1]) if versions else {}

    def read(self, only: Iterable[str] | None = None) -> DataFrame:
        """The rows of the given parts, or of all. Other parts aren't listed."""
        known = self.parts()
        folders = [f"{self.path}/{known[p]}" for p in sorted(known if only is None else set(only) & set(known))]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).format(self.fmt).load(folders)

    def parts_of(self, rows: DataFrame) -> set[str]:
        """The parts that rows touch; few, as changes come by day."""
        return {r["p"] for r in rows.select(self.part.alias("p")).distinct().collect()}

    def write(self, rows: DataFrame) -> dict[str, str]:
        """Write rows into new folders, which no reader sees before a commit."""
        folder = f"data/{uuid.uuid4().hex}"
        placed = rows.select(*self.spark.createDataFrame([], self.schema).columns).withColumn("__part", self.part)
        placed.hint("rebalance", "__part").write.partitionBy("__part").format(self.fmt).save(f"{self.path}/{folder}")
        return {unquote(n.removeprefix("__part=")): f"{folder}/{n}" for n in self._names(folder) if n.startswith("__part=")}

    def commit(self, written: dict[str, str], replaced: Iterable[str] = ()) -> None:
        """Make the written parts the current ones; parts of `replaced` that weren't written go."""
        versions = self._versions()
        gone = set(replaced)
        now = {p: f for p, f in self.parts().items() if p not in gone} | written
        number = int(versions[-1].removesuffix(".json")) + 1 if versions else 1
        aim = self._new(f"{self.path}/manifests/{number:012d}.json")
        draft = self._new(f"{self.path}/manifests/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray("".join(json.dumps([p, f]) + "\n" for p, f in sorted(now.items())).encode()))
        out.close()
        if self._fs.exists(aim) or not self._fs.rename(draft, aim):
            raise RuntimeError(f"{aim} was committed by another writer")
        self.vacuum()

    def vacuum(self, keep: int = KEPT) -> None:
        """Delete what the newest manifests don't name, and older manifests."""
        versions = self._versions()
        named = {f for v in versions[-keep:] for f in self._load(v).values()}
        for folder in self._names("data"):
            inside = [f"data/{folder}/{n}" for n in self._names(f"data/{folder}") if n.startswith("__part=")]
            dead = [f for f in inside if f not in named]
            for f in [f"data/{folder}"] if len(dead) == len(inside) else dead:
                self._fs.delete(self._new(f"{self.path}/{f}"), True)
        for v in versions[:-keep]:
            self._fs.delete(self._new(f"{self.path}/manifests/{v}"), False)

    def replace(self, rows: DataFrame) -> None:
        """Rows replace their parts as a whole; other parts stay."""
        self.commit(self.write(rows))


class DatedStore(PartStore):
    """Rows by the month of a date column."""

    def __init__(self, spark: SparkSession, path: str, schema: str = schemas.BAR, day: str = "dt"):
        super().__init__(spark, path, schema, F.date_format(day, "yyyy-MM"))
        self.day = day

    def window(self, first: date | None = None, last: date | None = None) -> DataFrame:
        """Rows of the days from first to last; months outside aren't listed."""
        a, b = (f"{d:%Y-%m}" if d else None for d in (first, last))
        found = self.read(p for p in self.parts() if (a is None or p >= a) and (b is None or p <= b))
        found = found if first is None else found.where(F.col(self.day) >= F.lit(first))
        return found if last is None else found.where(F.col(self.day) <= F.lit(last))

    def replace_dates(self, rows: DataFrame) -> None:
        """Rows replace the stored ones of their dates; only their months are read and written."""
        staged = self.write(rows)  # computed once; no manifest names these folders, so the commit deletes them
        months = set(staged) - {NO_PART}
        if staged:
            rows = self.spark.read.schema(self.schema).format(self.fmt).load([f"{self.path}/{f}" for f in staged.values()])
            self.commit(self.write(replace_date_slice(self.read(months), rows, self.day)), months)

    def prune(self, target: str, days_to_keep: int) -> None:
        """Rows older than so many days go; expired months are dropped unread, the oldest kept one is rewritten if it has to be."""
        written, gone = self._pruned(date.fromisoformat(target) - timedelta(days=days_to_keep), set())
        if gone:
            self.commit(written, gone)

    def _pruned(self, first: date, but: set[str]) -> tuple[dict[str, str], set[str]]:
        edge = f"{first:%Y-%m}"
        known = self.parts()
        gone = {p for p in known if p < edge}
        if edge not in known or edge in but or self.read([edge]).where(F.col(self.day) < F.lit(first)).isEmpty():
            return {}, gone
        return self.write(self.read([edge]).where(F.col(self.day) >= F.lit(first))), gone | {edge}


class BarStore(DatedStore):
    """Daily bars, keyed by code and day."""

    def upsert(self, batch: DataFrame, seq_col: str | None = None) -> None:
        """S3: insert or replace; only the batch's months are read and written. The first batch makes the store."""
        months = self.parts_of(batch)
        self.commit(self.write(ops.upsert_bars(self.read(months), batch, seq_col)), months)

    def sync(self, listing: DataFrame, history: DataFrame, target: str, days_to_keep: int = 430, min_codes: int = 1000, max_gap_days: int = 10, lookback_days: int = 20) -> None:
        """Prune, repair gaps, take today's listing unless the day is complete, all in one commit.

        Read are the last lookback_days and what is rewritten: the months of the gap and of the target, and the
        oldest kept one if it holds expired days.
        """
        end = date.fromisoformat(target)
        first = end - timedelta(days=days_to_keep)
        recent = self.window(max(first, end - timedelta(days=lookback_days)), end)
        missing = ops.find_missing_days(recent, target, lookback_days, max_gap_days, min_codes)
        gap = missing.agg(F.min("dt").alias("a"), F.max("dt").alias("b")).first()
        batch = ops.bars_from_listing(listing, target)
        done = recent.where(F.col("dt") == F.lit(end)).count() >= min_codes
        batch = batch.limit(0) if done else batch
        if gap["a"] is not None:
            batch = batch.unionByName(ops.backfill_rows(history, listing, missing).where(F.col("dt") >= F.lit(first)))
        months = self.parts_of(batch)
        written, gone = self._pruned(first, months)
        if months:
            merged = ops.upsert_bars(self.read(months).where(F.col("dt") >= F.lit(first)), batch)
            written |= self.write(merged)
        if months or gone:
            self.commit(written, gone | months)
