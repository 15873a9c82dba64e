"""Operator 2: packing into optimal length buckets.

Dynamic programming over the global histogram of lengths chooses the bucket boundaries for
which padding every document to its bucket's boundary wastes least. Inside each bucket,
documents form batches of as many as fit the token budget at the boundary's length.

The histogram is exact up to EXACT tokens, eight times the token budget, so the boundaries are
optimal for all documents that share a batch. Above, where a document is a batch of its own, lengths
share cells that grow by 1/64 of their length, with exact sums, so that the histogram has a bounded
number of cells however long the texts are. Documents get numbers inside a bucket from counts per
(bucket, slot): no bucket meets in one task, nor do rows without an id.

Edge cases: null and empty texts have length 0 and share the first bucket; a document longer
than the budget is a batch of its own; repeated rows are separate documents, numbered next to each
other; of boundaries that waste alike the lower are taken; an empty table gives no rows; other
columns of what pack gets are kept, but bucket, padded_len, batch and batch_size are replaced; the
query and the stage return doc_id and the columns of pack alone.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BUCKETS = 12
TOKEN_BUDGET = 16_384
EXACT = 8 * TOKEN_BUDGET
#: Documents of a bucket that one slot numbers, about.
SLOT_ROWS = 20_000


def cell(length: Column) -> Column:
    """The histogram cell of a length: the length itself, or the end of its 1/64 of a power of two above EXACT."""
    shift = F.greatest(F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double"))) - 6, F.lit(0)).cast("int")
    step = F.expr("1L") * F.pow(F.lit(2.0), shift).cast("long")
    return F.when(length <= EXACT, length).otherwise(F.floor((length - 1) / step) * step + step).cast("long")


def boundaries(cells: list[tuple[int, int, int, int]], buckets: int = BUCKETS) -> list[int]:
    """Bucket boundaries from (cell, count, sum of lengths, longest), by least total padding.

    cost[k][j] = min over i of cost[k-1][i] + longest_j x count(i..j) - sum(i..j). The best i rises
    with j, so the places between two j whose i is known are searched between these only.
    """
    if not cells:
        return []
    cells = sorted(cells)
    longest = np.array([c[3] for c in cells], float)
    count = np.concatenate([[0], np.cumsum([c[1] for c in cells], dtype=float)])
    total = np.concatenate([[0], np.cumsum([c[2] for c in cells], dtype=float)])
    n, k = len(cells), min(buckets, len(cells))
    best, cut = np.full((k + 1, n + 1), np.inf), np.zeros((k + 1, n + 1), int)
    best[0, 0] = 0
    for used in range(1, k + 1):
        todo = [(1, n, 0, n - 1)]
        while todo:
            first, last, low, high = todo.pop()
            j = (first + last) // 2
            places = slice(low, min(high, j - 1) + 1)
            costs = best[used - 1, places] + longest[j - 1] * (count[j] - count[places]) - (total[j] - total[places])
            cut[used, j] = i = low + int(np.argmin(costs))
            best[used, j] = costs[i - low]
            if first < j:
                todo.append((first, j - 1, low, i))
            if j < last:
                todo.append((j + 1, last, i, high))
    used, j, out = int(np.argmin(best[:, n])), n, []
    while used:
        out.append(int(longest[j - 1]))
        used, j = used - 1, int(cut[used, j])
    return out[::-1]


def pack(lengths: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """lengths (a column n_tokens) with bucket, padded_len, batch (number in its bucket), batch_size.

    The slot of a row comes from a hash of the order columns; rows are numbered by these inside it.
    Where one of them is null, a row number that is written with the row stands in.
    """
    some = F.coalesce(*(F.when(F.col(c).isNull(), F.monotonically_increasing_id()) for c in order), F.lit(0))
    table = common.write_shared(lengths.withColumn("__spread", some), "lengths")
    rows = table.groupBy(cell(F.col("n_tokens")).alias("cell")).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("s"), F.max("n_tokens").alias("m"))
    cells = [(r.cell, r.n, r.s, r.m) for r in rows.collect()]
    edges = boundaries(cells, buckets) or [0]
    held = [0] * len(edges)
    for _, n, _, m in cells:
        held[next(i for i, e in enumerate(edges) if m <= e)] += n
    bucket = F.lit(None).cast("int")
    for i in range(len(edges) - 1, -1, -1):
        bucket = F.when(F.col("n_tokens") <= edges[i], F.lit(i)).otherwise(bucket)
    slots = F.element_at(F.array(*(F.lit(max(1, math.ceil(n / SLOT_ROWS))) for n in held)), F.col("bucket") + 1)
    edge = F.element_at(F.array(*(F.lit(e).cast("long") for e in edges)), F.col("bucket") + 1)
    placed = table.withColumn("bucket", bucket).withColumn("padded_len", edge).withColumn("__slot", F.pmod(F.xxhash64(*order, "n_tokens", "__spread"), slots))
    sizes = placed.groupBy("bucket", "__slot").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = common.write_shared(sizes.select("bucket", "__slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start")), "starts")
    number = F.row_number().over(Window.partitionBy("bucket", "__slot").orderBy(*order, "n_tokens", "__spread")) - 1
    numbered = placed.withColumn("__no", number).join(starts, ["bucket", "__slot"])
    size = F.greatest(F.floor(F.lit(budget) / F.greatest("padded_len", F.lit(1))), F.lit(1))
    return numbered.withColumn("batch_size", size).withColumn("batch", F.floor((F.col("__start") + F.col("__no")) / size)).drop("__slot", "__start", "__no", "__spread")


def token_lengths(docs: DataFrame) -> DataFrame:
    """doc_id and its number of words, the tokens here; any other length column packs alike."""
    return docs.select("doc_id", common.word_count(common.whole_text()).alias("n_tokens"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch of every document."""
    packed = pack(token_lengths(common.table(spark, sf_dir, "documents")))
    return packed.select("doc_id", "n_tokens", "bucket", "padded_len", "batch", "batch_size")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch of every row of the mixed corpus."""
    return pack(token_lengths(docs)).select("doc_id", "n_tokens", "bucket", "padded_len", "batch", "batch_size")
