"""Operator 8: embedding near-dedup with product quantisation.

1. Copies. Equal vectors are one vector with a weight, so a group of copies is never compared inside.
2. Index. Coarse inverted lists are the cells of two coarse quantisers, one for each half of the
   components (an inverted multi-index): k-means over a bounded sample (SAMPLE vectors) gives K
   centroids a half and K x K lists, K growing with the square root of the rows, so that lists
   keep about LIST_SIZE vectors up to some 10^8 rows. Of the centroids of a half none is kept
   within the threshold's distance of one with more vectors: a large group of near copies stays
   in few lists. k-means over the sample's residuals gives the codewords of 8 subspaces. Every
   vector is indexed: normalised, put into the list of its nearest centroids and coded. The
   codes' error, the distance between a residual and its code, is kept too.
3. Probes. A vector visits the lists whose border lies within a radius of it. A pair is found if
   either visits the other's list. With miss=0 the radius is the threshold's distance, and no
   link can lie elsewhere. Else it is learned from the sample: the least at which a share of at most
   `miss` of its pairs is lost, both for neighbours made at exactly the threshold's cosine in
   directions of the data and for the least similar true pairs. No number of lists is cut.
4. Lists and their visitors are split into blocks of about BLOCK vectors; a pair of blocks is one
   task, so no list meets in one task and no pair of vectors is ever a row. Inside, asymmetric
   table-lookup distances (query against codes) drop pairs whose distance less the code's error
   exceeds the threshold's: a lower bound, so it drops no link. The rest is ranked by exact cosine
   in double precision. A task returns, per vector, its number of links and a spanning forest;
   connected components follow.

A pair that both sides find is counted in the list of the lower number; inside a list where the
smaller id is the visitor.

Edge cases: vectors that are null, zero or hold null or non-finite components link with nothing;
vectors of each dimension have an index of their own and link among themselves; each row is a
vector of its own, so rows that repeat an id are compared like others (copies link) and each is
returned; a null id links with nothing and is kept; pairs at exactly the threshold link; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .ngram_join import forest

THRESHOLD = 0.95
SAMPLE = 16_384
#: Vectors of a list, about; centroids of a half at most, 16 sample vectors to each.
LIST_SIZE, MOST_CENTROIDS = 256, SAMPLE // 16
SUBSPACES, CODEWORDS = 8, 256
BLOCK = 1024
#: Share of the sample's pairs that the probes may lose, and the number of pairs that the radius is learned from.
MISS, PAIRS = 5e-4, 4096


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's algorithm; empty clusters keep their centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([((centres**2).sum(1) - 2 * part @ centres.T).argmin(1) for part in np.array_split(x, max(1, len(x) // 2048))])
        count = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


class Half:
    """Coarse centroids of some of the components, more than reach apart."""

    def __init__(self, x: np.ndarray, k: int, reach: float):
        self.centres = k_means(x, k)
        count, kept = np.bincount(self.distances(x).argmin(1), minlength=len(self.centres)), []
        for c in np.argsort(-count, kind="stable"):
            if not kept or ((self.centres[kept] - self.centres[c]) ** 2).sum(1).min() > reach**2:
                kept.append(int(c))
        self.centres = self.centres[kept]
        self.apart = np.sqrt(np.maximum(((self.centres[:, None] - self.centres[None]) ** 2).sum(2), 1e-12))

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to the centroids."""
        return np.maximum((x**2).sum(1)[:, None] + (self.centres**2).sum(1)[None] - 2 * x @ self.centres.T, 0)

    def borders(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid, and the distance to the border between it and each other one."""
        d, rows = self.distances(x), np.arange(len(x))
        home = d.argmin(1)
        border = np.maximum(d - d[rows, home][:, None], 0) / (2 * self.apart[home])
        border[rows, home] = 0
        return home, border


class Index:
    """Two coarse quantisers, the codewords of each subspace of the residuals, and the radius of probes."""

    def __init__(self, sample: np.ndarray, k: int, threshold: float, miss: float):
        self.dim, self.reach = sample.shape[1], reach_of(threshold)
        self.split = (self.dim + 1) // 2
        self.cuts = np.linspace(0, self.dim, min(SUBSPACES, self.dim) + 1).astype(int)
        x = unit(sample.astype(np.float64))
        self.halves = [Half(part, k, self.reach) for part in self.parts(x)]
        residual = x - self.centre(self.places(x)[0])
        self.words = [k_means(residual[:, a:b], CODEWORDS, seed=6 + a) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        self.radius = self.reach if miss <= 0 else min(self.reach, self.learned_radius(x, threshold, miss))

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.split], x[:, self.split :]

    @property
    def width(self) -> int:
        """Centroids of the second half: list = first x width + second."""
        return len(self.halves[1].centres)

    def centre(self, home: np.ndarray) -> np.ndarray:
        """The centroid of each list."""
        return np.concatenate([h.centres[i] for h, i in zip(self.halves, np.divmod(home, self.width), strict=True)], axis=1)

    def places(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The list of each vector, and its squared borders in either half."""
        found = [h.borders(part) for h, part in zip(self.halves, self.parts(x), strict=True)]
        return found[0][0] * self.width + found[1][0], [b**2 for _, b in found]

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and their errors."""
        residual, codes, error = x - self.centre(home), [], np.zeros(len(x))
        for words, a, b in zip(self.words, self.cuts, self.cuts[1:], strict=False):
            d = (residual[:, a:b] ** 2).sum(1)[:, None] + (words**2).sum(1)[None] - 2 * residual[:, a:b] @ words.T
            codes.append(d.argmin(1).astype(np.uint8))
            error += np.maximum(d.min(1), 0)
        return np.stack(codes, 1), np.sqrt(error)

    def visits(self, borders: list[np.ndarray]) -> list[np.ndarray]:
        """The lists whose border lies within the radius of each vector, its own among them."""
        most, out = self.radius**2, []
        for a, b in zip(*borders, strict=True):
            i, j = np.flatnonzero(a <= most), np.flatnonzero(b <= most)
            p, q = np.nonzero(a[i][:, None] + b[j][None] <= most)
            out.append(i[p] * self.width + j[q])
        return out

    def needed(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The radius at which each pair of rows is found from either side."""
        (at_x, bx), (at_y, by) = self.places(x), self.places(y)
        rows, (ix, jx), (iy, jy) = np.arange(len(x)), np.divmod(at_x, self.width), np.divmod(at_y, self.width)
        return np.sqrt(np.minimum(bx[0][rows, iy] + bx[1][rows, jy], by[0][rows, ix] + by[1][rows, jx]))

    def learned_radius(self, x: np.ndarray, threshold: float, miss: float) -> float:
        """The radius that loses at most a share of miss, of neighbours made and of those in the sample."""
        rng, radius = np.random.default_rng(9), 0.0
        at, p, q = (rng.integers(0, len(x), PAIRS) for _ in range(3))
        way = x[p] - x[q]
        way -= (way * x[at]).sum(1, keepdims=True) * x[at]
        size = np.linalg.norm(way, axis=1)
        at, way, size = at[size > 1e-9], way[size > 1e-9], size[size > 1e-9]
        if len(at):
            made = threshold * x[at] + np.sqrt(1 - threshold**2) * way / size[:, None]
            radius = float(np.quantile(self.needed(x[at], made), 1 - miss, method="higher"))
        pairs = []
        for start in range(0, min(PAIRS, len(x)), 256):
            some = x[start : min(start + 256, PAIRS)]
            cosine = some @ x.T
            cosine[cosine < threshold] = 2
            least = cosine.argmin(1)
            pairs += [(start + i, j) for i, j in enumerate(least) if cosine[i, j] < 1 and start + i != j]
        if pairs:
            i, j = np.array(pairs).T
            radius = max(radius, float(np.quantile(self.needed(x[i], x[j]), 1 - miss, method="higher")))
        return radius

    def table_distances(self, queries: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances of queries to the coded vectors of a list."""
        residual, out = queries - self.centre(np.array([home])), np.zeros((len(queries), len(codes)), np.float32)
        for m, (words, a, b) in enumerate(zip(self.words, self.cuts, self.cuts[1:], strict=False)):
            table = (residual[:, a:b] ** 2).sum(1)[:, None] + (words**2).sum(1)[None] - 2 * residual[:, a:b] @ words.T
            out += table.astype(np.float32)[:, codes[:, m]]
        return np.maximum(out, 0)


def numbered(vectors: DataFrame) -> DataFrame:
    """row, vec_id, v of every row; v is null where the vector can't link.

    Vectors of floats stay floats, so that they travel in half the bytes; all work is in doubles.
    """
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    v = F.col("embedding").cast(f"array<{kind}>")
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    return vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.when(F.col("vec_id").isNotNull() & finite, v).alias("v"))


def reach_of(threshold: float) -> float:
    """The distance of unit vectors at the threshold."""
    return float(np.sqrt(2 - 2 * threshold) + 1e-9)


def fit(rows: DataFrame, count: int, threshold: float = THRESHOLD, miss: float = MISS) -> Index:
    """An index fitted on at most SAMPLE vectors, in the order of a hash of their ids."""
    sample = rows.select("v", F.xxhash64("vec_id").alias("o")).orderBy("o").limit(SAMPLE).select("v").toPandas()
    x = np.stack(sample["v"].to_numpy()).astype(np.float64)
    return Index(x, int(min(MOST_CENTROIDS, max(1, round((count / LIST_SIZE) ** 0.5)))), threshold, miss)


def links(rows: DataFrame, index: Index, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, links, root from every pair of blocks; rows: vec_id, v, w (copies of the vector)."""
    spark = rows.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(index)
    kind = np.float32 if rows.schema["v"].dataType.simpleString() == "array<float>" else np.float64

    def directions(raw: np.ndarray) -> np.ndarray:
        wide = raw.astype(np.float64)
        return unit(wide / np.abs(wide).max(axis=1, keepdims=True))

    def indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = shared.value
        for pdf in batches:
            raw = np.stack(pdf["v"].to_numpy()).astype(kind) if len(pdf) else np.zeros((0, ix.dim), kind)
            x = directions(raw)
            home, borders = ix.places(x)
            codes, error = ix.encode(x, home)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "w": pdf["w"], "home": home.astype(np.int32), "visits": ix.visits(borders), "x": [r.tobytes() for r in raw], "codes": [r.tobytes() for r in codes], "error": error})

    coded = common.write_shared(rows.mapInPandas(indexed, "vec_id long, w long, home int, visits array<int>, x binary, codes binary, error double"), "codes")
    stored = coded.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    visitors = coded.select(F.explode("visits").alias("home")).groupBy("home").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("visit_blocks"))
    plan = common.write_shared(stored.join(visitors, "home"), "blocks")
    kept = ["vec_id", "w", "home", "x", "visits", "codes", "error"]
    left = coded.join(plan, "home").withColumn("s", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    left = left.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("visit_blocks") - 1))).select(F.col("home").alias("list"), "s", "q", F.lit(True).alias("stored"), *kept)
    right = coded.withColumn("list", F.explode("visits")).join(plan.withColumnRenamed("home", "list"), "list").withColumn("q", F.pmod(F.xxhash64("vec_id", F.lit(1)), "visit_blocks").cast("int"))
    right = right.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = right.withColumns({c: F.lit(None).cast(right.schema[c].dataType) for c in ("visits", "codes", "error")}).select("list", "s", "q", F.lit(False).alias("stored"), *kept)

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        ix, at = shared.value, int(pdf["list"].iloc[0])
        held, asking = pdf[pdf["stored"]], pdf[~pdf["stored"]]
        empty = pd.DataFrame({"vec_id": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
        if not len(held) or not len(asking):
            return empty
        a, b = (directions(np.stack([np.frombuffer(v, kind) for v in side["x"]])) for side in (asking, held))
        codes = np.stack([np.frombuffer(c, np.uint8) for c in held["codes"]])
        near = np.sqrt(ix.table_distances(a, at, codes)) <= (ix.reach + held["error"].to_numpy()[None] + 1e-3).astype(np.float32)
        id_a, id_b, home_a = asking["vec_id"].to_numpy(), held["vec_id"].to_numpy(), asking["home"].to_numpy()
        near &= (id_a[:, None] < id_b[None]) | (home_a != at)[:, None]
        i, j = np.nonzero(near)
        exact = np.concatenate([np.einsum("nd,nd->n", a[i[k : k + 65536]], b[j[k : k + 65536]]) for k in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
        i, j = i[exact >= threshold], j[exact >= threshold]
        back = np.concatenate([k * len(ix.halves[0].centres) * ix.width + np.asarray(v, np.int64) for k, v in enumerate(held["visits"])])
        twice = (home_a[i] < at) | ~np.isin(j * len(ix.halves[0].centres) * ix.width + home_a[i], back) | (home_a[i] == at)
        i, j = i[twice], j[twice]
        if not len(i):
            return empty
        ids, first, place = np.unique(np.concatenate([id_a, id_b]), return_index=True, return_inverse=True)
        weight = np.concatenate([asking["w"].to_numpy(), held["w"].to_numpy()])[first]
        i, j = place[i], place[len(id_a) + j]
        n = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
        return pd.DataFrame({"vec_id": ids, "links": n.astype(np.int64), "root": ids[forest(len(ids), i, j)]})[n > 0]

    return left.unionByName(right).groupBy("list", "s", "q").applyInPandas(compared, "vec_id long, links long, root long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row, whose place is its identity; miss=0 visits every list that a link can lie in."""
    every = common.write_shared(numbered(vectors), "vectors")
    rows = every.where(F.col("v").isNotNull())
    distinct = common.write_shared(rows.groupBy("v").agg(F.min("row").alias("rep"), F.min("vec_id").alias("least"), F.count("*").alias("w")), "distinct")
    dims = distinct.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).where("n > 1").orderBy("d").collect()
    parts = [distinct.select(F.col("rep").alias("vec_id"), F.lit(0).cast("long").alias("links"), F.col("rep").alias("root"))]
    for d in dims:
        part = distinct.where(F.size("v") == d["d"]).select(F.col("rep").alias("vec_id"), "v", "w")
        parts.append(common.write_shared(links(part, fit(part, d["n"], threshold, miss), threshold), "links"))
    found = reduce(DataFrame.unionByName, parts)
    classes = common.components(found.where("vec_id <> root"), "vec_id", "root").withColumnRenamed("node", "rep")
    n = found.groupBy(F.col("vec_id").alias("rep")).agg(F.sum("links").alias("links"))
    lowest = distinct.select("rep", "least").join(classes, "rep").groupBy("component").agg(F.min("least").alias("lowest"))
    known = distinct.select("rep", "least", "w").join(n, "rep").join(classes, "rep", "left").join(lowest, "component", "left")
    known = common.write_shared(known.select("rep", F.coalesce("lowest", "least").alias("component_id"), (F.col("links") + F.col("w") - 1).alias("n_links")), "known")
    copies = rows.join(distinct.where("w > 1").select("v", "rep"), "v").select("row", "rep")
    owner = every.select("row", "vec_id", F.col("v").isNotNull().alias("links")).join(common.write_shared(copies, "copies"), "row", "left")
    out = owner.withColumn("rep", F.when(F.col("links"), F.coalesce("rep", "row"))).drop("links").join(known, "rep", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op8_pq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and survival of every vector."""
    return near_vectors(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
