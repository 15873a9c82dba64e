"""Operator 3: cross-site boilerplate lines by their spread over distinct sites.

One HyperLogLog sketch of sites per line hash, merged by aggregation, estimates on how many
distinct sites a line occurs. Lines whose estimate lies near the threshold get an exact distinct
count; the others are decided by their estimate. Lines of the threshold or more are removed from
every document, whatever their share of it. Only a document all of whose lines are boilerplate
keeps its text: it is a copy as a whole, which is a matter for near-duplicate detection, and is
marked as such.

There is one way for every size. Line hashes meet the boilerplate hashes, the hits of each
distinct text are gathered (no more than the text has lines), and texts meet their hits by a
shuffled join on a hash of the text, whose hot partitions Spark splits.

Lines are compared without white space at either end; blank lines always stay. Lines and texts are
known by 64 bits of hash: two texts of one hash share their hits, which removes boilerplate lines
only, so a collision of texts is harmless; one of lines takes a further line in 2^64 / (number of
boilerplate lines) distinct ones.

Edge cases: null texts stay null and empty ones empty; a null site counts as no site; repeated
rows are treated alike; a line on exactly the threshold's number of sites is boilerplate; texts of
any length are split whole; an empty table gives no rows; other columns of docs are kept, of
whatever names but those that begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_SITES = 10
#: log2 of the registers of a sketch; its relative standard error is about 1.04 / sqrt(2^11).
LG_REGISTERS = 11
#: Half width of the band of exact counts, as a share of the threshold: over four standard errors.
BAND = 0.1


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def line_hash(line: Column) -> Column:
    """64 bits of the trimmed line; null for a blank one."""
    bare = F.trim(line, F.lit(" \t\r"))
    return F.when(bare != "", F.xxhash64(bare))


def line_table(docs: DataFrame, site: str = "source") -> DataFrame:
    """key (hash of the text), site, line (hash): the distinct lines of each document."""
    hashes = F.array_distinct(F.transform(lines_of(F.col("text")), line_hash))
    lines = docs.select(F.xxhash64("text").alias("key"), F.col(site).alias("site"), F.explode(hashes).alias("line"))
    return common.write_shared(lines.where(F.col("line").isNotNull()), "lines")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """line: the hashes of lines that occur on at least min_sites distinct sites."""
    placed = lines.where(F.col("site").isNotNull()).select("site", "line")
    sketches = placed.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_REGISTERS)).alias("sketch"))
    estimates = sketches.select("line", F.hll_sketch_estimate("sketch").alias("sites"))
    slack = max(2, round(min_sites * BAND))
    spread = common.write_shared(estimates.where(F.col("sites") >= min_sites - slack), "spread")
    near = spread.where(F.col("sites") <= min_sites + slack).select("line")
    exact = placed.join(near, "line", "left_semi").groupBy("line").agg(F.countDistinct("site").alias("sites"))
    sure = spread.where(F.col("sites") > min_sites + slack).select("line")
    return common.write_shared(sure.unionByName(exact.where(F.col("sites") >= min_sites).select("line")), "boilerplate")


def without_boilerplate(docs: DataFrame, lines: DataFrame, found: DataFrame) -> DataFrame:
    """docs with __text, the text less its boilerplate lines, __n_lines, __n_removed and __whole_copy."""
    hits = lines.select("key", "line").join(found, "line").groupBy(F.col("key").alias("__key")).agg(F.collect_set("line").alias("__held"))
    hits = common.write_shared(hits, "hits")  # so that the join has an exchange of its own, in which a text with many copies can be split
    joined = docs.join(hits.hint("merge"), F.xxhash64("text") == F.col("__key"), "left")
    all_lines = lines_of(F.col("text"))
    gone = lambda line: F.coalesce(F.array_contains("__held", line_hash(line)), F.lit(False))
    own = F.filter(all_lines, lambda line: ~gone(line))
    joined = joined.withColumn("__own", F.when(F.col("__held").isNotNull(), own))
    whole = F.coalesce(~F.exists("__own", lambda line: line_hash(line).isNotNull()), F.lit(False))
    n_lines = F.coalesce(F.size(all_lines), F.lit(0))
    return (
        joined.withColumns({"__whole_copy": whole, "__n_lines": n_lines.cast("long")})
        .withColumn("__cut", F.col("__own").isNotNull() & ~F.col("__whole_copy"))
        .withColumns({"__text": F.when(F.col("__cut"), F.array_join("__own", "\n")).otherwise(F.col("text")), "__n_removed": F.when(F.col("__cut"), F.col("__n_lines") - F.size("__own")).otherwise(F.lit(0)).cast("long")})
        .drop("__key", "__held", "__own", "__cut")
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less its boilerplate lines."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    lines = line_table(docs)
    done = without_boilerplate(docs, lines, boilerplate(lines))
    return done.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.col("__whole_copy").alias("whole_copy"), F.col("__text").alias("text"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; texts and n_chars are those without boilerplate lines."""
    lines = line_table(docs.select("source", "text"))
    done = without_boilerplate(docs, lines, boilerplate(lines))
    done = done.withColumns({"text": F.col("__text"), "n_chars": F.length("__text").cast("long")})
    return done.select(*docs.columns)
