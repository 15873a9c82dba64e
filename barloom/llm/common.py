"""Helpers that several operators share: table access, shared scratch tables, components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes per Arrow batch sent to Python; texts are long, so the default of 10,000 rows is too many.
ARROW_ROWS, ARROW_BYTES = 400, 32 << 20


#: By application, the folder of a session that names none.
_own_folders: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts holds, and let Python workers find this package.

    A batch ends at ARROW_ROWS rows or past ARROW_BYTES bytes, so it holds one very long text at most
    beyond these. Both settings are the session's.

    On a cluster the package is installed or sent with --py-files; where it is a plain folder,
    as in tests, workers get the folder's path.
    """
    home, paths = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if home not in paths.get("PYTHONPATH", "").split(os.pathsep):
        paths["PYTHONPATH"] = os.pathsep.join(filter(None, (paths.get("PYTHONPATH", ""), home)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A local session that names none gets one of its own; a cluster must name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        folder = _own_folders.get(app) or _own_folders.setdefault(app, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return folder.rstrip("/")


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: this cuts the lineage.

    The table survives lost executors; the file system drops it when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    """Runs of characters that are not ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def slices(lengths: list[int], most: int = 1_000_000) -> Iterator[slice]:
    """Consecutive slices of a batch of about `most` characters each, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield slice(start, len(lengths))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """Connected components of the undirected edges (a, b), as (node, component = smallest node).

    Alternating large-star and small-star steps (Kiveris et al., 2014) in grouped minima and
    joins. Every round is a written table, so a lost executor costs one round. Nodes without
    an edge don't appear. Raises if the rounds don't suffice: no partial answer is returned.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").where("u is not null and v is not null")
    now = write_shared(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = write_shared(small.where("u <> v").distinct(), "edges")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
