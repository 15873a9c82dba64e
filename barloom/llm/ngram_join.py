"""Operator 6: n-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles (ASCII white space separates words; a text of fewer words is
one shingle of all of them). Two texts link if their Jaccard similarity is 0.8 or more.

1. Equal word sequences are one text. 140 MinHash values a text give 28 bands of 5 values; a
   pair at the threshold shares no band with a probability of 1.5e-5, a closer one of less.
2. Only texts that share a band with another go on. They get a block: texts reachable over
   common bands keep together, in blocks of about BLOCK_BYTES of shingles and BLOCK texts at
   most. Pairs of blocks that share a band are compared, each in a task of its own, so no band's
   texts meet in one task and no pair of texts is ever a row.
3. Inside a pair of blocks, MinHash values are compared STEP at a time; a pair is dropped as soon
   as the posterior probability (uniform prior) of reaching the threshold falls below TOLERANCE.
   The rest is verified by exact intersection. A task returns, per text, its number of linked
   documents and a spanning forest of its links.
4. Connected components over the forests are the classes; a class is named after its smallest
   doc_id.

Since the number of links of every text is exact, a group of G different near copies is compared
in (G / BLOCK)^2 / 2 tasks; equal texts cost nothing. A word sequence is known by 64 bits of hash: of
10^10 different ones about 3 pairs are expected to be taken for equal.

Edge cases: null, empty and wordless texts link with nothing, not even with each other, and are
classes of their own; pairs at exactly the threshold link; very long texts are whole sets, in
blocks of their own; repeated rows are copies, and of rows with one id and different texts each
counts; a null id comes last in its class; an empty table gives no rows; other columns of docs,
of any name without leading underscores, are kept by the stage and not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

N, THRESHOLD = 5, 0.8
BANDS, ROWS = 28, 5
HASHES = BANDS * ROWS
STEP, TOLERANCE = 20, 1e-6
BLOCK, BLOCK_BYTES = 1024, 2 << 20
#: Pairs of texts that are compared at a time.
PAIRS = 1 << 17
#: Candidate texts up to which their ids (16 bytes each) are broadcast to find their texts.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(20)
_LOW, _HIGH = (_rng.integers(1, 2**32, HASHES, dtype=np.uint32) | np.uint32(1) for _ in range(2))
_MIX = _rng.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(1, 2**63, BANDS, dtype=np.uint64)


def words_of() -> Column:
    """The words of the text, with one space between them."""
    return F.trim(F.regexp_replace(common.whole_text(), r"[\x20\x09-\x0D]+", " "))


def text_id() -> Column:
    """64 bits of the word sequence; null for a text without words."""
    words = words_of()
    return F.when(words != "", F.xxhash64(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def shingles(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; one space stands between words."""
    split = [t.split(" ") if t else [] for t in texts]
    flat = [w for words in split for w in words]
    hashes = pd.util.hash_array(np.array(flat, dtype=object), categorize=False) if flat else np.zeros(0, np.uint64)
    out, at = [], 0
    for words in split:
        h, at = hashes[at : at + len(words)], at + len(words)
        width = max(1, len(h) - N + 1)
        grams = np.zeros(width if len(h) else 0, np.uint64)
        for i in range(min(N, len(h))):
            grams = mixed(grams * np.uint64(0x9E3779B97F4A7C15) + h[i : i + width])
        out.append(np.unique(grams))
    return out


def signature(grams: np.ndarray) -> np.ndarray:
    """MinHash values of a set of shingles, one set at least."""
    best = np.full(HASHES, 2**32 - 1, np.uint32)
    for i in range(0, len(grams), 1024):
        part = grams[i : i + 1024]
        low, high = part.astype(np.uint32)[None, :], (part >> np.uint64(32)).astype(np.uint32)[None, :]
        np.minimum(best, (low * _LOW[:, None] + high * _HIGH[:, None]).min(axis=1), out=best)
    return best


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    """The 64-bit hash of each band of each signature."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    return mixed((mixed(parts + _BAND[None, :, None]) * _MIX).sum(axis=2) + _BAND).astype(np.int64)


def bands(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Band hashes and number of shingles of each text."""
    for texts in batches:
        out: list[tuple[np.ndarray | None, int]] = []
        for part in common.slices(texts.map(len).tolist()):
            for grams in shingles(texts.iloc[part].tolist()):
                out.append((band_hashes(signature(grams)[None, :])[0] if len(grams) else None, len(grams)))
        yield pd.DataFrame(out, columns=["bands", "n_grams"])


def payloads(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        sets = [g for part in common.slices(texts.map(len).tolist()) for g in shingles(texts.iloc[part].tolist())]
        yield pd.DataFrame({"sig": [signature(g).tobytes() for g in sets], "grams": [g.tobytes() for g in sets]})


def least_matches(seen: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest matches of `seen` values for which P(similarity >= threshold) is the tolerance or more.

    Under a uniform prior the posterior is Beta(matches + 1, seen - matches + 1), whose tail above
    t equals P(Binomial(seen + 1, t) <= matches).
    """
    p, term = 0.0, (1 - threshold) ** (seen + 1)
    for m in range(seen + 1):
        p += term
        if p >= tolerance:
            return m
        term *= (seen + 1 - m) / (m + 1) * threshold / (1 - threshold)
    return seen


_LEAST = {k: least_matches(k) for k in range(STEP, HASHES + 1, STEP)}


def likely(sig: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) whose sizes and MinHash values leave the threshold within reach."""
    near = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])
    i, j = i[near], j[near]
    matches = np.zeros(len(i), np.int16)
    for k in range(0, HASHES, STEP):
        matches += (sig[i, k : k + STEP] == sig[j, k : k + STEP]).sum(axis=1).astype(np.int16)
        keep = matches >= _LEAST[k + STEP]
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


def links_between(sig: np.ndarray, grams: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) whose exact similarity reaches the threshold."""
    size = np.array([len(g) for g in grams])
    some = [likely(sig, size, i[k : k + PAIRS], j[k : k + PAIRS], threshold) for k in range(0, max(1, len(i)), PAIRS)]
    i, j = (np.concatenate(x) for x in zip(*some, strict=True))
    if not len(i):
        return i, j
    used = np.unique(np.concatenate([i, j]))
    flat = np.concatenate([grams[u] for u in used])
    by_pair, by_matrix = 1.5e-5 * len(i) + 4e-8 * (size[i] + size[j]).sum(), 1e-7 * len(flat) + 6e-11 * len(flat) / 2 * len(used) ** 2
    if by_pair <= by_matrix:
        both = np.array([len(np.intersect1d(grams[a], grams[b], assume_unique=True)) for a, b in zip(i, j, strict=True)])
    else:
        _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(used)), size[used])
        common_to = np.cumsum(count > 1) - 1
        held = count[column] > 1
        row, column = row[held], common_to[column[held]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        overlap = np.zeros((len(used), len(used)), np.float32)
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            a, b = np.searchsorted(column, (start, start + 4096))
            dense = np.zeros((len(used), 4096), np.float32)
            dense[row[a:b], column[a:b] - start] = 1
            overlap += dense @ dense.T
        both = overlap[np.searchsorted(used, i), np.searchsorted(used, j)]
    linked = both >= threshold * (size[i] + size[j] - both) - 1e-9
    return i[linked], j[linked]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest reachable index of each of n nodes."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def compare_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between the texts of one pair of blocks: per text its linked documents and its root."""
    pdf = pdf.drop_duplicates("tid").sort_values("tid", ignore_index=True)
    sig = np.stack([np.frombuffer(s, np.uint32) for s in pdf["sig"]])
    grams = [np.frombuffer(g, np.uint64) for g in pdf["grams"]]
    side, docs = pdf["side"].to_numpy(), pdf["n_docs"].to_numpy()
    if pdf["one"].iloc[0]:
        i, j = np.triu_indices(len(pdf), 1)
    else:
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        i, j = np.repeat(a, len(b)), np.tile(b, len(a))
    i, j = links_between(sig, grams, i, j)
    links = np.bincount(i, docs[j], len(pdf)) + np.bincount(j, docs[i], len(pdf))
    out = pd.DataFrame({"tid": pdf["tid"], "links": links.astype(np.int64), "root": pdf["tid"].to_numpy()[forest(len(pdf), i, j)]})
    return out[out["links"] > 0]


def with_blocks(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """tid, block: texts that share bands keep together, as many to a block as its limits allow."""
    for _ in range(2):
        lowest = members.groupBy("tid").agg(F.min("hub").alias("hub"))
        nearer = members.select("bucket", "tid").join(lowest, "tid")
        hubs = nearer.groupBy("bucket").agg(F.min("hub").alias("hub"))
        members = nearer.select("bucket", "tid").join(hubs, "bucket")
    labels = members.groupBy("tid").agg(F.min("hub").alias("label")).join(sizes, "tid")
    taken = F.sum(8 * F.col("n_grams") + 4 * HASHES) / BLOCK_BYTES
    parts = labels.groupBy("label").agg(F.ceil(F.greatest(taken, F.count("*") / BLOCK)).alias("parts"))
    return labels.join(parts, "label").select("tid", F.xxhash64("label", F.pmod(F.xxhash64("tid"), F.col("parts"))).alias("block"))


def classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, tid) of docs, and for each tid: first_id, n_links, class_id and rep, the tid that stays of its class."""
    common.small_batches(docs.sparkSession)
    shape = "struct<bands:array<long>,n_grams:int>"
    rows = docs.select("doc_id", text_id().alias("tid"), F.pandas_udf(bands, shape)(words_of()).alias("b")).select("doc_id", "tid", "b.*")
    rows = common.write_shared(rows, "bands")
    worded = rows.where(F.col("tid").isNotNull())
    texts = common.write_shared(worded.groupBy("tid").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_docs"), F.first("bands").alias("bands"), F.first("n_grams").alias("n_grams")), "texts")
    banded = texts.select("tid", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("tid").alias("hub")).where("n > 1").select("bucket", "hub")
    members = common.write_shared(banded.join(shared, "bucket"), "members")
    blocks = common.write_shared(with_blocks(members, texts.select("tid", "n_grams")), "blocks")
    at = members.select("bucket", "tid").join(blocks, "tid").select("bucket", "block").distinct()
    pairs = at.withColumnRenamed("block", "a").join(at.withColumnRenamed("block", "b"), "bucket").where("a <= b").select("a", "b").distinct()
    pairs = pairs.withColumn("pair", F.xxhash64("a", "b"))

    wanted = common.write_shared(texts.select("tid", "first_id", "n_docs").join(blocks, "tid"), "wanted")
    hint = F.broadcast if wanted.count() <= BROADCAST_IDS else (lambda df: df)
    here = docs.select("doc_id", "text").join(hint(wanted), F.col("doc_id").eqNullSafe(F.col("first_id")))
    here = here.where(text_id() == F.col("tid")).select("tid", "block", "n_docs", words_of().alias("words"))
    here = here.dropDuplicates(["tid"])  # rows without an id, or that repeat one, may hold one text many times
    here = here.select("tid", "block", "n_docs", F.pandas_udf(payloads, "struct<sig:binary,grams:binary>")("words").alias("p"))
    payload = common.write_shared(here.select("tid", "block", "n_docs", "p.sig", "p.grams"), "payload")
    sides = pairs.select(F.col("a").alias("block"), "pair", F.lit(0).alias("side"), (F.col("a") == F.col("b")).alias("one")).unionByName(pairs.where("a < b").select(F.col("b").alias("block"), "pair", F.lit(1).alias("side"), F.lit(False).alias("one")))
    found = payload.join(sides, "block").groupBy("pair").applyInPandas(compare_blocks, "tid long, links long, root long")
    found = common.write_shared(found, "found")
    classes = common.components(found, "tid", "root")
    links = found.groupBy("tid").agg(F.sum("links").alias("links"))
    known = texts.select("tid", "first_id", "n_docs").join(classes.withColumnRenamed("node", "tid"), "tid", "left").join(links, "tid", "left")
    known = common.write_shared(known.select("tid", "first_id", F.coalesce("component", "tid").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links")), "known")
    first = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "tid")).alias("m")
    named = known.join(known.groupBy("component").agg(first), "component").select("tid", "first_id", "n_links", F.col("m.first_id").alias("class_id"), F.col("m.tid").alias("rep"))
    return rows.select("doc_id", "tid"), common.write_shared(named, "named")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, tid, class_id, n_links, kept of every row; kept marks the row that stays of its class."""
    rows, named = classified(docs)
    out = rows.join(named, "tid", "left")
    kept = F.when(F.col("rep").isNull(), F.lit(True)).otherwise((F.col("rep") == F.col("tid")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    return out.select("doc_id", "tid", F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), kept.alias("kept"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class and the number of links of every document."""
    found = near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "n_links", "kept")


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class; documents without words stay, one of each doc_id.

    What stays is known for each class, so no group of copies is joined with its rows.
    """
    rows, named = classified(docs.select("doc_id", "text"))
    stays = named.where("rep = tid").select(F.col("first_id").alias("doc_id"), "tid").unionByName(rows.where("tid is null").distinct())

    def keyed(df: DataFrame, tid: Column) -> DataFrame:
        """Keys without nulls, so that the join and the choice of one row share an exchange."""
        none = F.col("doc_id").isNull().cast("int") + 2 * tid.isNull().cast("int")
        return df.withColumns({"__none": none, "__id": F.coalesce("doc_id", F.lit(0)), "__tid": F.coalesce(tid, F.lit(0))})

    keys = ["__none", "__id", "__tid"]
    joined = keyed(docs, text_id()).join(keyed(stays, F.col("tid")).select(*keys), keys, "left_semi")
    return joined.dropDuplicates(keys).select(*docs.columns)
