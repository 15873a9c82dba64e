"""Periodic runs, exact search and whitening against plain restatements, and their edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import exact_top_k, periodic_runs, whitening


def plain_runs(w, copies=4, least=6):
    found = {}
    for q in range(1, len(w) // copies + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j > i and j - i + q >= max(least, copies * q):
                found.setdefault((i - q, j), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def some_words(rng):
    letters = "abcdefgh"[: rng.choice([1, 2, 3, 8])]
    w = [rng.choice(letters) for _ in range(rng.randrange(80))]
    for _ in range(rng.randrange(3)):
        at = rng.randrange(60)
        w[at:at] = [rng.choice(letters) for _ in range(rng.randrange(1, 9))] * rng.randrange(2, 7)
    return w


def test_runs_match_brute_force():
    rng = random.Random(3)
    texts = [some_words(rng) for _ in range(1500)]
    for w, (_, runs) in zip(texts, periodic_runs.runs_of_texts([" ".join(w).encode() for w in texts]), strict=True):
        assert [tuple(map(int, r)) for r in runs] == plain_runs(w)


def test_splitting_keeps_every_run_and_drops_prose():
    rng = random.Random(4)
    prose = [f"w{int(rng.paretovariate(1))}" for _ in range(20_000)]
    w = np.unique(np.array(prose), return_inverse=True)[1]
    left = periodic_runs.split_segments(w, np.zeros(len(w), np.int64))
    assert sum(b - a for a, b in left) < len(w) / 5
    for a, b in left:
        assert min(np.unique(w[a:b], return_counts=True)[1]) >= periodic_runs.COPIES
    for start, length, _ in plain_runs(w[:3000].tolist()):
        assert any(a <= start and start + length <= b for a, b in left)


def test_runs_of_very_long_texts():
    (_, one), (_, none), (_, wide) = periodic_runs.runs_of_texts([b"a " * 300_000, b" ".join(b"%d" % i for i in range(300_000)), b" ".join(b"%d" % i for i in range(60_000)) + b" " + b" ".join(b"x%d" % (i % 50_000) for i in range(210_000))])
    assert one.tolist() == [[0, 300_000, 1]] and none.tolist() == [] and wide.tolist() == [[60_000, 210_000, 50_000]]


def test_query_of_planted_runs(spark, tmp_path):
    rng = random.Random(5)
    texts = [(i, " \t".join(some_words(rng))) for i in range(300)] + [(300, None), (300, ""), (7, "a b " * 9), (7, "a b " * 9), (None, "c " * 8)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc, text in texts:
        w = (text or "").split()
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        g = h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        runs = plain_runs(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((doc, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(v for i, v in enumerate(w) if i not in gone))))
    got = [tuple(r) for r in periodic_runs.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_operator_keeps_columns_and_gives_texts(spark):
    docs = spark.createDataFrame([("x", "so so so so so so it is", 1)], "body string, start_text string, runs int")
    row = periodic_runs.periodic(docs, "start_text").first()
    assert row["runs"] == 1 and row["__periodic"]["collapsed"] == "so it is"
    assert [tuple(r) for r in row["__periodic"]["runs"]] == [(0, 6, 1)]
    with pytest.raises(ValueError):
        periodic_runs.periodic(docs, copies=2)


def plain_top(rows, asks, k):
    whole = [(i, v, None if v is None or any(e is None or not np.isfinite(e) for e in v) else [int(np.floor(256 * float(e))) for e in v]) for i, v in rows]
    out = []
    for n, (q, _, a) in enumerate(whole):
        if q is None or not asks(q) or not a:
            continue
        scores = [(-sum(x * y for x, y in zip(a, b, strict=True)), c is None, c or 0) for m, (c, _, b) in enumerate(whole) if m != n and b and len(b) == len(a)]
        out += [(q, r, None if none else c, -s) for r, (s, none, c) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def vectors_with_everything():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((400, 6)).round(3)
    x[100:160] = x[100]  # copies, ids among the queries
    x[160:220] = x[160] + rng.standard_normal((60, 6)) * 1e-3
    x[220] = 0
    x[221] *= 1e6
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    return rows + [(50, x[3].tolist()), (50, x[50].tolist()), (None, x[7].tolist()), (None, x[7].tolist()), (600, None), (650, [1.0, None]), (700, [float("nan")] * 6), (750, []), (800, [0.5, 0.25]), (801, [1.0, 2.0]), (850, [3.0])]


def test_search_matches_brute_force(spark, monkeypatch):
    rows = vectors_with_everything()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = plain_top(rows, lambda i: i % 50 == 0, 5)
    for block, queries, read in ((8192, 256, 16), (50, 4, 1)):
        monkeypatch.setattr(exact_top_k, "BLOCK", block)
        monkeypatch.setattr(exact_top_k, "QUERIES", queries)
        monkeypatch.setattr(exact_top_k, "READ", read)
        got = exact_top_k.exact_top_k(df, F.col("vec_id") % 50 == 0).collect()
        assert sorted(map(tuple, got), key=repr) == want


def test_cells_hold_their_entries_and_bounds_their_scores():
    rng = np.random.default_rng(9)
    x = (rng.standard_cauchy((3000, 12)) * 50).astype(np.int64)
    x[:, 3] = 7
    low, middle, high = np.percentile(x, [25, 50, 75], axis=0)
    grid = exact_top_k.Grid.laid(x.min(axis=0), x.max(axis=0), middle, high - low)
    codes, at = grid.codes(x), np.arange(12)
    assert (grid.low[at, codes] <= x).all() and (x <= grid.high[at, codes]).all()
    lower, upper = grid.bounds(x[:40], codes)
    score = x[:40] @ x.T
    assert (lower <= score).all() and (score <= upper).all()
    assert np.mean([len(exact_top_k.leading(a, b, at, at, 5)) for a, b in zip(lower, upper, strict=True) for at in [np.arange(3000)]]) < 100


def test_scores_beyond_64_bits_are_the_nearest_long(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [1.0, 1.0])]
    got = exact_top_k.exact_top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 2**63 - 1), (3, 2**63 - 1), (2, -(2**63))]


@pytest.mark.parametrize("values", [np.linspace(1, 1000, 40), np.r_[np.full(10, 1000.0), np.linspace(1, 5, 30)], np.r_[1000 + 1e-4 * np.arange(10), np.linspace(1, 5, 30)], np.r_[1000 + 1e-9 * np.arange(10), np.zeros(30)], np.full(16, 3.0), np.logspace(-12, 3, 40)], ids=["apart", "multiple", "near", "nearer", "same", "wide"])
def test_refined_eigenvectors(values):
    d = len(values)
    q, _ = np.linalg.qr(np.random.default_rng(2).standard_normal((d, d)))
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    value, x = whitening.refined(a)
    scale = values.max()
    assert np.abs(np.sort(values)[::-1] - value).max() < 1e-14 * scale * d
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-14 and np.abs(a @ x - x * value).max() < 1e-14 * scale
    rough = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    assert np.abs(rough.T @ rough - np.eye(d)).max() > 1e-9  # what the refinement starts from


def test_whitening_matches_a_plain_version(spark):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((300, 5)) @ rng.standard_normal((5, 5))
    v[40:90] = v[40]
    rows = [(i, r.tolist()) for i, r in enumerate(v)] + [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [float("inf")] * 5), (None, v[1].tolist()), (5, v[2].tolist()), (904, []), (905, [1.0, 2.0])]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    x = np.floor(256 * v).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = fit - s / n
    value, vector = np.linalg.eigh(y.T @ y / n)
    value, vector = value[::-1], vector[:, ::-1]
    vector *= np.where(vector[np.abs(vector).argmax(axis=0), np.arange(5)] < 0, -1, 1)
    white = (x - s / n) @ vector / np.sqrt(value)
    five = [r for r in got if r["vec_id"] != 905]
    assert len(five) == 302 * 4
    for r in five:
        at = {None: [1], 5: [5, 2]}.get(r["vec_id"], [r["vec_id"]])
        c = r["component"] - 1
        assert r["n"] == n and any(r["deviation"] == int(((n * x[a] - s) ** 2).sum()) and abs(r["whitened"] - white[a, c]) < 1e-9 for a in at)
        assert abs(r["explained"] - value[c] / value.sum()) < 1e-12 and r["identity_error"] < 1e-10
    alone = [r for r in got if r["vec_id"] == 905]
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in alone] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]


def test_whitening_of_flat_and_huge_vectors(spark):
    flat = whitening.whitened(spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(9)], "vec_id bigint, embedding array<double>")).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) and r["identity_error"] < 1e-10 for r in flat) and len(flat) == 27
    huge = whitening.whitened(spark.createDataFrame([(0, [1e300, 1.0]), (1, [-1e300, 0.0]), (2, [3.0, 4.0])], "vec_id bigint, embedding array<double>")).collect()
    assert len(huge) == 6 and any(r["deviation"] is None for r in huge)
