"""Operator 11: periodic runs of words, by recursive frequency splitting and a lag scan.

A run is a stretch of words whose words `period` apart are equal, of at least `copies` periods and
MIN_LENGTH words, that no neighbouring word extends; its period is the smallest it has.

1. Splitting. Each word of a run of `copies` periods occurs at least `copies` times in it. A word
   that occurs less often in its segment (at first the whole text) is in no run and splits the
   segment; segments shorter than a run go. Pieces that have changed are counted again, until no
   word is too rare. Ordinary prose is gone after a few rounds. All texts of a batch are split at
   once, by sorting pairs of segment and word.
2. Lag scan. For each lag q up to a `copies`-th of a surviving segment, its blocks of q words are
   compared with their successors by prefix hashes: a run of `copies` periods holds
   copies - 1 whole blocks in a row that are equal. That takes n / q steps a lag, n log n in all.
   A stretch so found is compared word by word and extended as far as it goes, so hashes decide
   nothing. Blocks inside a run found at a smaller lag belong to that run, whose period divides
   their lag, and are skipped.

Collapsing drops the words of a run after its first period.

Each text is worked on whole by one task and no text meets another: no shuffle. Words are split at ASCII
white space and compared by their bytes.

Edge cases: null, empty and blank texts have no words, no runs and collapse to the empty text;
texts may have any length (memory grows with the longest text of a batch); overlapping runs are
all reported, and a word that any of them drops is dropped; repeated rows are treated alike; an
empty table gives no rows; other columns of docs are kept, of whatever names but __periodic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fewest words, and fewest periods, of a run.
MIN_LENGTH, COPIES = 6, 4
#: Base of the prefix hashes (any odd number) and a multiplier that spreads word numbers.
_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def split_segments(words: np.ndarray, text: np.ndarray, copies: int = COPIES, min_length: int = MIN_LENGTH) -> list[tuple[int, int]]:
    """The segments (from, to) in which each word occurs `copies` times or more; words and text are numbers by place."""
    at, segment, found = np.arange(len(words)), text, []
    kinds = int(words.max()) + 1 if len(words) else 1
    while len(at):
        _, place, count = np.unique(segment * kinds + words[at], return_inverse=True, return_counts=True)
        often = count[place] >= copies
        changed = np.bincount(segment, ~often) > 0
        stable = at[~changed[segment]]
        if len(stable):
            edges = np.flatnonzero(np.diff(segment[~changed[segment]])) + 1
            found += [(int(part[0]), int(part[-1]) + 1) for part in np.split(stable, edges)]
        again = often & changed[segment]
        at, segment = at[again], segment[again]
        if not len(at):
            break
        segment = np.concatenate([[0], np.cumsum((np.diff(at) != 1) | (np.diff(segment) != 0))])
        long = np.bincount(segment)[segment] >= min_length
        at, segment = at[long], segment[long]
    return sorted(s for s in found if s[1] - s[0] >= min_length)


def matches(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading places of a and b are equal."""
    done, step, most = 0, 64, min(len(a), len(b))
    while done < most:
        differ = a[done : min(done + step, most)] != b[done : min(done + step, most)]
        if differ.any():
            return done + int(differ.argmax())
        done, step = done + step, step * 2
    return most


def lag_scan(w: np.ndarray, copies: int = COPIES, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of one segment."""
    n, out = len(w), []
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
    value = (w.astype(np.uint64) + np.uint64(1)) * _SPREAD
    prefix = np.concatenate([[np.uint64(0)], np.cumsum((value ^ (value >> np.uint64(31))) * power[:-1])])
    reach = np.zeros(n, np.int64)  # end of the runs found so far that hold a place
    for q in range(1, n // copies + 1):
        sums = np.diff(prefix[::q])
        same = sums[:-1] * power[q] == sums[1:]
        row = same[: len(same) - copies + 3].copy()
        for j in range(1, copies - 2):
            row &= same[j : len(row) + j]
        first = np.flatnonzero(row) * q
        if len(first):
            first = first[reach[first] < first + (copies - 1) * q]
        end = 0
        for i in first.tolist():
            if i + q <= end:  # in the stretch compared last
                continue
            length = matches(w[i + q :], w[i:])
            if length < (copies - 2) * q:
                continue
            end = i + q + length
            start = i - matches(w[: i + q][::-1][: i + 1], w[:i][::-1])
            if end - start >= max(min_length, copies * q):
                out.append((start, end - start, q))
                np.maximum(reach[start:end], end, out=reach[start:end])
        if n and reach[0] == n:
            break
    return out


def runs_of_texts(texts: list[bytes], copies: int = COPIES, min_length: int = MIN_LENGTH) -> list[tuple[list[bytes], np.ndarray]]:
    """The words of each text, and its runs (rows of start, length, period) by start, then period."""
    split = [t.split() for t in texts]
    sizes = np.array([len(s) for s in split], np.int64)
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = [word for s in split for word in s]
    words, _ = pd.factorize(flat)
    offset = np.concatenate([[0], np.cumsum(sizes)])
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, b in split_segments(words.astype(np.int64), np.repeat(np.arange(len(texts)), sizes), copies, min_length):
        i = int(np.searchsorted(offset, a, "right")) - 1
        found[i] += [(a - int(offset[i]) + start, length, period) for start, length, period in lag_scan(words[a:b], copies, min_length)]
    return [(s, np.array(sorted(f, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)) for s, f in zip(split, found, strict=True)]


def collapsed(words: list[bytes], runs: np.ndarray) -> str:
    """The words that no run repeats, with one space between them."""
    if len(runs):
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
    return b" ".join(words).decode()


def periodic(docs: DataFrame, text: Column | str = "text", copies: int = COPIES, min_length: int = MIN_LENGTH) -> DataFrame:
    """docs with __periodic: n_words, runs (array of start, length, period) and the collapsed text."""
    if copies < 3:
        raise ValueError("a run has three periods at least")
    common.small_batches(docs.sparkSession)

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for part in common.slices(texts.map(len).tolist()):
                for words, runs in runs_of_texts([t.encode() for t in texts.iloc[part]], copies, min_length):
                    out.append((len(words), runs[:, 0], runs[:, 1], runs[:, 2], collapsed(words, runs)))
            yield pd.DataFrame(out, columns=["n", "start", "length", "period", "collapsed"])

    source = F.col(text) if isinstance(text, str) else text
    shape = "struct<n:long,start:array<long>,length:array<long>,period:array<long>,collapsed:string>"
    found = docs.withColumn("__periodic", F.pandas_udf(scan, shape)(F.coalesce(source, F.lit(""))))
    p = F.col("__periodic")
    runs = F.arrays_zip(p["start"].alias("start"), p["length"].alias("length"), p["period"].alias("period"))
    return found.withColumn("__periodic", F.struct(p["n"].alias("n_words"), runs.alias("runs"), p["collapsed"].alias("collapsed")))


def planted() -> Column:
    """The text of the contract: documents whose hash of the id ends in 0 repeat their words from some place on."""
    words = F.array_remove(F.split(common.whole_text(), r"[\x20\x09-\x0D]+"), "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10).cast("long"), F.size(words).cast("long")
    a = F.try_mod(g, n)
    rest = n - a
    p = 1 + F.floor(rest / (3 + g % 8)).cast("long")
    again = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), F.ceil(rest / p).cast("int")))
    text = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(again, F.lit(1), rest.cast("int"))), " ")
    return F.when((h % 10 == 0) & (n > 0), text).otherwise(common.whole_text())


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document (null ids have no planted runs), and digests of the runs and of the collapsed text."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", planted().alias("text"))
    p = F.col("__periodic")
    runs = p["runs"]
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    found = periodic(docs).select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(p["collapsed"], 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return found.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
