"""Bounded samples of labelled documents, for the operators that fit a classifier."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as fold 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


def within(rows: list, budget: int) -> list:
    """The rows, in order, whose lengths n fit into what is left of the budget; one that doesn't fit is passed over.

    If none fits, the shortest stays, so that no class falls out of a sample.
    """
    total, out = 0, []
    for r in rows:
        if total + r["n"] <= budget:
            total += r["n"]
            out.append(r)
    return out or sorted(rows, key=lambda r: r["n"])[:1]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, each: int, budget: int) -> pd.DataFrame:
    """Columns text and y: at most `each` labelled rows of either class outside the held-out fold.

    Rows come in the order of a hash of their id, whole and of whatever length, as far as their
    characters stay within `budget` a class (a longer text is passed over, unless a class has nothing
    else): that bounds what reaches the driver. Of rows that repeat
    an id the largest label and the longest text's length count, and the first text by content.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("o", F.xxhash64("doc_id"))
    lengths = docs.select("doc_id", F.length("text").alias("n")).where("n is not null").groupBy("doc_id").agg(F.max("n").alias("n"))
    known = known.join(lengths, "doc_id")
    ids = {}
    for y in (0, 1):
        ids |= {r["doc_id"]: y for r in within(known.where(F.col("y") == y).orderBy("o", "doc_id").limit(each).collect(), budget)}
    if not ids:
        return pd.DataFrame({"text": [], "y": []})
    small = docs.sparkSession.createDataFrame(list(ids.items()), "doc_id long, y int")
    rows = docs.select("doc_id", "text").join(F.broadcast(small), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).toPandas().sort_values("doc_id", ignore_index=True)[["text", "y"]]
