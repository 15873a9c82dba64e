"""Operator 12: exact top-k search by inner product with vector-approximation files.

1. Cells. Each entry of a vector is put into one of CELLS cells of its dimension, one byte. Cells are
   even on a scale of asinh about the middle of the entries, so they are narrow where entries
   lie dense and reach from the least to the greatest entry of all rows, however far out. Their
   layout decides speed only: cells of whole numbers have exact ends.
2. Approximation file. Of equal vectors only the k + 1 first ids can be among the answers; these rows
   are coded and packed into blocks of about BLOCK rows (codes, ids) beside the exact vectors.
3. Scan. Equal queries are one query. Each block of queries meets each block of the file in a row
   of its own; two matrix products over the cells' middles and half widths give a lower and an
   upper bound of every score. A row stays if fewer than k + 1 others of its block surely come
   before it, and then if that holds over all blocks.
4. Reading. Each query's exact vectors are read in the order of their upper bounds, READ at first
   and four times as many in each further round, until no unread bound reaches the k-th exact score.

Scores are exact whole numbers; ties go to the smaller id. k + 1 answers are found for each
distinct query vector; each query row then leaves itself out.

Edge cases: vectors that are null, have no entries or hold null or non-finite entries neither ask nor
answer; a query meets vectors of its own dimension; a row is a query and a candidate by itself, so
another row of the query's id is a candidate, and an id repeated among the queries has its answers
as often; a null id asks nothing and comes last in a tie; entries and scores beyond 64 bits take the
nearest long; fewer candidates give fewer answers; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .whitening import by_dimension, scaled

K = 5
CELLS = 256
#: Rows of a block of the file and of a block of queries, about; answers of a query read at first.
BLOCK, QUERIES, READ = 8192, 256, 16
#: Scores below this are exact in doubles.
EXACT = float(1 << 52)


def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """d, pos and the least, the greatest, the middle and the spread of the entries of each batch."""
    for d, x, _ in by_dimension(batches):
        low, middle, high = np.percentile(x, [25, 50, 75], axis=0)
        yield pd.DataFrame({"d": d, "pos": np.arange(d), "low": x.min(axis=0), "high": x.max(axis=0), "middle": middle, "spread": high - low})


@dataclass
class Grid:
    """The least and the greatest whole number of each cell of each dimension."""

    low: np.ndarray
    high: np.ndarray

    @classmethod
    def laid(cls, low: np.ndarray, high: np.ndarray, middle: np.ndarray, spread: np.ndarray) -> Grid:
        spread = np.maximum(spread, 1.0)
        a, b = (np.arcsinh((end - middle) / spread) for end in (low.astype(float), high.astype(float)))
        steps = a[:, None] + (b - a)[:, None] * np.linspace(0, 1, CELLS + 1)[None, 1:-1]
        inner = np.ceil(np.clip(middle[:, None] + spread[:, None] * np.sinh(steps), low[:, None], high[:, None])).astype(np.int64)
        return cls(np.concatenate([low[:, None], inner], axis=1), np.concatenate([np.maximum(inner - 1, low[:, None]), high[:, None]], axis=1))

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(cells[1:], column, "right") for cells, column in zip(self.low, x.T, strict=True)], axis=1).astype(np.uint8)

    def bounds(self, queries: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the inner product of each query with each coded row."""
        at = np.arange(codes.shape[1])
        low, high, q = self.low[at, codes].astype(float), self.high[at, codes].astype(float), queries.astype(float)
        middle, half = (low + high) / 2, (high - low) / 2
        score, width = q @ middle.T, np.abs(q) @ half.T
        most = np.abs(q).max(initial=0) * np.abs(np.concatenate([self.low, self.high])).max(initial=0) * codes.shape[1]
        if 2 * most >= EXACT:
            width += 1e-9 * (np.abs(q) @ (np.abs(middle) + half).T)
        return score - width, score + width


def leading(lower: np.ndarray, upper: np.ndarray, key: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places whose score may be among the k first by score, key and row."""
    if len(lower) <= k:
        return np.arange(len(lower))
    some = np.flatnonzero(upper >= np.partition(lower, len(lower) - k)[len(lower) - k])
    last = some[np.lexsort((row[some], key[some], -lower[some]))[k - 1]]
    before = (key[some] < key[last]) | ((key[some] == key[last]) & (row[some] <= row[last]))
    return some[(upper[some] > lower[last]) | (before & (upper[some] == lower[last]))]


def inner_products(a: pd.Series, b: pd.Series) -> pd.Series:
    """Exact inner products of vectors of whole numbers, the nearest long if beyond."""
    out = np.zeros(len(a), np.int64)
    for d, at in a.groupby(a.map(len)).groups.items():
        x, y = np.stack(a.loc[at].to_numpy()).astype(np.int64), np.stack(b.loc[at].to_numpy()).astype(np.int64)
        most = [max(abs(int(m.max())), abs(int(m.min()))) for m in (x, y)]
        if most[0] * most[1] * int(d) < 2**62:
            found = np.einsum("nd,nd->n", x, y)
        else:
            found = np.array([max(-(2**63), min(2**63 - 1, int(v))) for v in (x.astype(object) * y).sum(axis=1)], np.int64)
        out[a.index.get_indexer(at)] = found
    return pd.Series(out)


def first_of(df: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """df with nth of its k first rows of each group; Spark cuts groups to k rows before they are shuffled."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("nth") <= k)


def may_precede(upper: str, last: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of found that may come before the last sure answer of their query; last: qid, l_score, l_key, l_row."""
    tie = (F.col("key") < F.col("l_key")) | ((F.col("key") == F.col("l_key")) & (F.col("row") <= F.col("l_row")))
    joined = found.join(last, "qid", "left")
    return joined.where(F.col("l_score").isNull() | (F.col(upper) > F.col("l_score")) | ((F.col(upper) == F.col("l_score")) & tie)).drop("l_score", "l_key", "l_row")


def layouts(rows: DataFrame) -> dict[int, Grid]:
    """The grid of each dimension that occurs; what reaches the driver doesn't grow with the rows."""
    per_pos = rows.select("x").mapInPandas(ranges, "d int, pos int, low long, high long, middle double, spread double").groupBy("d", "pos")
    middle = [F.percentile_approx(c, 0.5).alias(c) for c in ("middle", "spread")]
    seen = per_pos.agg(F.min("low").alias("low"), F.max("high").alias("high"), *middle).orderBy("d", "pos").toPandas()
    return {int(d): Grid.laid(*(part[c].to_numpy() for c in ("low", "high", "middle", "spread"))) for d, part in seen.groupby("d")}


def approximation_file(rows: DataFrame, blocks: DataFrame, grids: dict[int, Grid]) -> DataFrame:
    """d, block and the packed row numbers, keys and codes of each block; blocks: d, n_blocks."""
    shared = rows.sparkSession.sparkContext.broadcast(grids)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        d = int(pdf["d"].iloc[0])
        codes = shared.value[d].codes(np.stack(pdf["x"].to_numpy()).astype(np.int64))
        return pd.DataFrame({"d": [d], "block": pdf["block"].iloc[:1].to_numpy(), "rows": [pdf["row"].to_numpy(np.int64).tobytes()], "keys": [pdf["key"].to_numpy(np.int64).tobytes()], "codes": [codes.tobytes()]})

    placed = rows.withColumn("d", F.size("x")).join(F.broadcast(blocks), "d").withColumn("block", F.pmod(F.xxhash64("row"), "n_blocks").cast("int"))
    packed = placed.select("d", "block", "row", "key", "x").groupBy("d", "block").applyInPandas(pack, "d int, block int, rows binary, keys binary, codes binary")
    return common.write_shared(packed, "approximations")


def query_blocks(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """d, q_block and the packed numbers and vectors of each block of queries."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["x"].to_numpy()).astype(np.int64)
        return pd.DataFrame({"d": [x.shape[1]], "q_block": pdf["q_block"].iloc[:1].to_numpy(), "qids": [pdf["qid"].to_numpy(np.int64).tobytes()], "xs": [x.tobytes()]})

    placed = queries.withColumn("d", F.size("x")).join(F.broadcast(blocks), "d").withColumn("q_block", F.pmod(F.xxhash64("qid"), "n_q_blocks").cast("int"))
    return placed.select("d", "q_block", "qid", "x").groupBy("d", "q_block").applyInPandas(pack, "d int, q_block int, qids binary, xs binary")


def candidates(file: DataFrame, asked: DataFrame, blocks: DataFrame, grids: dict[int, Grid], k: int) -> DataFrame:
    """qid, row, key, lower, upper of the rows that may be among the k first of each query."""
    shared = file.sparkSession.sparkContext.broadcast(grids)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, qids, xs, rows, keys, codes in pdf[["d", "qids", "xs", "rows", "keys", "codes"]].itertuples(index=False):
                qids, rows, keys = (np.frombuffer(b, np.int64) for b in (qids, rows, keys))
                lower, upper = shared.value[d].bounds(np.frombuffer(xs, np.int64).reshape(-1, d), np.frombuffer(codes, np.uint8).reshape(-1, d))
                kept = [leading(lo, up, keys, rows, k) for lo, up in zip(lower, upper, strict=True)]
                q = np.repeat(np.arange(len(qids)), [len(c) for c in kept])
                c = np.concatenate(kept)
                yield pd.DataFrame({"qid": qids[q], "row": rows[c], "key": keys[c], "lower": lower[q, c], "upper": upper[q, c]})

    left = file.join(F.broadcast(blocks), "d").withColumn("q_block", F.explode(F.sequence(F.lit(0), F.col("n_q_blocks") - 1))).drop("n_blocks", "n_q_blocks")
    right = asked.join(F.broadcast(blocks), "d").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).drop("n_blocks", "n_q_blocks")
    found = common.write_shared(left.join(right, ["d", "block", "q_block"]).mapInPandas(scan, "qid long, row long, key long, lower double, upper double"), "bounds")
    last = first_of(found, "qid", [F.desc("lower"), F.asc("key"), F.asc("row")], k).where(F.col("nth") == k)
    return may_precede("upper", last.select("qid", F.col("lower").alias("l_score"), F.col("key").alias("l_key"), F.col("row").alias("l_row")), found)


def read_exact(found: DataFrame, rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, row, key, vec_id, score of the k first rows of each query, read in the order of their upper bounds."""
    order = Window.partitionBy("qid").orderBy(F.desc("upper"), "key", "row")
    waiting = common.write_shared(found.withColumn("at", F.row_number().over(order)), "waiting")
    best = [F.desc("score"), F.asc("key"), F.asc("row")]
    product, done, start, size = F.pandas_udf(inner_products, "long"), [], 0, READ
    while True:
        now = waiting.where((F.col("at") > start) & (F.col("at") <= start + size)).select("qid", "row", "key")
        met = now.join(rows.select("row", "vec_id", "x"), "row").join(queries.select("qid", F.col("x").alias("q")), "qid")
        done.append(common.write_shared(met.select("qid", "row", "key", "vec_id", product("q", "x").alias("score")), "read"))
        read = first_of(reduce(DataFrame.unionByName, done), "qid", best, k)
        last = read.where(F.col("nth") == k).select("qid", F.col("score").alias("l_score"), F.col("key").alias("l_key"), F.col("row").alias("l_row"))
        start, size = start + size, 4 * size
        unread = waiting.where(F.col("at") > start)
        if unread.isEmpty() or may_precede("upper", last, unread).isEmpty():
            return read.drop("nth")
        waiting = common.write_shared(may_precede("upper", last, unread), "waiting")


def exact_top_k(vectors: DataFrame, asks: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest inner product with each row for which asks holds."""
    common.small_batches(vectors.sparkSession)
    rows = scaled(vectors).withColumns({"row": F.monotonically_increasing_id(), "key": F.coalesce(F.col("vec_id").cast("long"), F.lit(2**63 - 1))})
    rows = common.write_shared(rows, "rows")
    firsts = common.write_shared(first_of(rows, "x", [F.asc("key"), F.asc("row")], k + 1).drop("nth"), "firsts")
    asking = rows.where(F.coalesce(asks, F.lit(False))).select("row", "vec_id", "x")
    queries = common.write_shared(asking.groupBy("x").agg(F.min("row").alias("qid")), "queries")
    sizes = firsts.groupBy(F.size("x").alias("d")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"))
    blocks = common.write_shared(sizes.join(queries.groupBy(F.size("x").alias("d")).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("n_q_blocks")), "d"), "plan")  # a row for each dimension
    grids = layouts(firsts)
    found = candidates(approximation_file(firsts, blocks, grids), query_blocks(queries, blocks), blocks, grids, k + 1)
    best = common.write_shared(read_exact(found, rows, queries, k + 1), "best")
    own = asking.join(queries, "x").select(F.col("row").alias("own"), F.col("vec_id").alias("query_id"), "qid")
    each = own.join(best, "qid").where("row <> own")
    ranked = first_of(each, "own", [F.desc("score"), F.asc("key"), F.asc("row")], k)
    return ranked.select("query_id", F.col("nth").cast("int").alias("rank"), "vec_id", "score")


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 50."""
    return exact_top_k(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
