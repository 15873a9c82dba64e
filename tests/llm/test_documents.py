"""Operators on documents against brute force on small tables."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import labelled, line_dedup, mixing, ngram_join, packing, quality, toxicity

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def water_fill(sizes: dict, weights: dict) -> dict:
    """Targets by resharing the excess again and again."""
    total, capped = sum(sizes.values()), {}
    while True:
        left, open_w = total - sum(capped.values()), sum(w for s, w in weights.items() if s not in capped)
        over = [s for s in sizes if s not in capped and left * weights[s] / open_w > 3 * sizes[s]]
        if not over:
            return {s: capped.get(s, left * weights[s] / open_w if open_w else 0) for s in sizes}
        capped |= {s: 3 * sizes[s] for s in over}


def test_mixing_meets_targets(spark):
    rows = [(i, "w " * (i % 17 + 1) * (9 if i % 50 == 0 else 1), f"s{min(i % 40, 8)}", 1) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, x int")
    out = [r.asDict() for r in mixing.mix(docs).collect()]
    sizes = Counter()
    for i, t, s, _ in rows:
        sizes[s] += len(t.split())
    want = water_fill(sizes, {s: 1 + k % 3 for k, s in enumerate(sorted(sizes))})
    taken, docs_source = Counter(), {i: s for i, _, s, _ in rows}
    for r in out:
        assert 0 <= r["part"] <= r["size"] and r["epochs"] * r["size"] + r["part"] <= 3 * r["size"]
        taken[docs_source[r["doc_id"]]] += r["epochs"] * r["size"] + r["part"]
    for s in sizes:
        assert math.isclose(want[s], next(r["target"] for r in out if docs_source[r["doc_id"]] == s), rel_tol=1e-12)
        assert abs(taken[s] - want[s]) <= 1


def test_mixing_takes_smallest_keys_first(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 5 + 1), f"s{i % 4}") for i in range(900)], "doc_id long, text string, source string")
    keys = {r["doc_id"]: r["key"] for r in mixing.document_stats(docs).collect()}
    by_source = defaultdict(list)
    for r in mixing.mix(docs).collect():
        by_source[r["source"]].append((keys[r["doc_id"]], r["doc_id"], r["size"], r["part"]))
    for rows in by_source.values():
        rows.sort()
        parts = [p / s for _, _, s, p in rows]
        assert parts == sorted(parts, reverse=True) and sum(0 < p < 1 for p in parts) <= 1


def test_mixing_stage_of_repeated_ids(spark):
    """Rows of one id are documents of their own: the mix keeps to its budget."""
    rows = [(i % 7 if i % 3 else None, "w " * (i % 9 + 1) + str(i % 2), f"s{i % 4}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(c) for c in ("size", "key", "target", "epochs", "part", "s", "c1", "d1")})
    out = mixing.mixing_stage(spark, docs, "")
    assert out.columns == docs.columns
    sizes, taken = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    for r in out.collect():
        taken[r["source"]] += len(r["text"].split())
    want = water_fill(sizes, {s: 1 + k % 3 for k, s in enumerate(sorted(sizes))})
    assert all(abs(taken[s] - want[s]) <= 10 for s in sizes)


def test_mixing_without_broadcasts(spark, documents, monkeypatch):
    rows = lambda: sorted(tuple(r) for r in mixing.mix(documents).collect())
    want = rows()
    staged = lambda: sorted(r["doc_id"] for r in mixing.mixing_stage(spark, documents, "").collect())
    also = staged()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert rows() == want and staged() == also


def test_boundaries_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = rng.integers(0, 40, 25)
        cells = [(int(v), int(c), int(v * c), int(v)) for v, c in zip(*np.unique(lengths, return_counts=True), strict=True)]
        got = packing.boundaries(cells, 3)
        waste = lambda e: sum(min(x for x in e if x >= v) - v for v in lengths)  # noqa: E731, B023
        values = sorted({int(v) for v in lengths})
        best = min(waste([a, b, values[-1]]) for a in values for b in values)
        assert waste(got) == best


def test_packing_fills_batches(spark):
    rows = [(i, i % 97) for i in range(5000)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), buckets=4, budget=500).collect()
    assert len(out) == 5000
    sizes = Counter((r["bucket"], r["batch"]) for r in out)
    for bucket in {r["bucket"] for r in out}:
        own = [r for r in out if r["bucket"] == bucket]
        most = own[0]["batch_size"]
        full = [n for (b, _), n in sizes.items() if b == bucket]
        assert max(full) <= most and sum(n < most for n in full) <= 1
        assert all(r["n_tokens"] <= r["padded_len"] for r in own)
        assert most == 1 or most * own[0]["padded_len"] <= 500


def test_boundaries_of_many_lengths_are_optimal():
    """Against the plain programme that looks at all places."""
    rng = np.random.default_rng(4)
    lengths = np.unique(rng.geometric(0.002, 3000), return_counts=True)
    cells = [(int(v), int(c), int(v * c), int(v)) for v, c in zip(*lengths, strict=True)]
    n, (v, c) = len(cells), np.array([(x[0], x[1]) for x in cells]).T
    count, total = np.r_[0, np.cumsum(c)], np.r_[0, np.cumsum(v * c)]
    best = np.r_[0, np.full(n, np.inf)]
    for _ in range(12):
        best = np.array([0] + [min(best[:j] + v[j - 1] * (count[j] - count[:j]) - (total[j] - total[:j])) for j in range(1, n + 1)])
    edges = np.array(packing.boundaries(cells, 12))
    assert n > 800 and ((edges[np.searchsorted(edges, v)] - v) * c).sum() == best[n]


def test_packing_spreads_rows_without_ids(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLOT_ROWS", 100)
    out = packing.pack(spark.createDataFrame([(None, 5)] * 1000, "doc_id long, n_tokens long"), budget=50).collect()
    assert Counter(r["batch"] for r in out) == {k: 10 for k in range(100)}


def test_packing_cells_hold_their_lengths(spark):
    rows = [(n,) for n in [0, 1, 255, 256, 257, 300, 1023, 1024, 1025, 99_999, 131_072, 131_073, 10**7]]
    for n, c in spark.createDataFrame(rows, "n long").select("n", packing.cell(F.col("n"))).collect():
        assert n <= c <= n * (1 + 1 / 32) + 1


def plain_line_dedup(rows, min_sites):
    """doc_id to the text less its boilerplate lines; texts of nothing else stay."""
    sites, bare = defaultdict(set), lambda x: x.strip(" \t\r")
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            if r["source"] is not None:
                sites[bare(line)].add(r["source"])
    out = {}
    for r in rows:
        kept = [x for x in (r["text"] or "").split("\n") if not bare(x) or len(sites[bare(x)]) < min_sites]
        out[r["doc_id"]] = "\n".join(kept) if any(map(bare, kept)) else r["text"]
    return out


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_line_dedup_matches_brute_force(spark, documents, broadcast):
    """With Spark free to broadcast the hits, and with shuffled joins only."""
    docs = documents.select("doc_id", "source", "text")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        lines = line_dedup.line_table(docs)
        out = line_dedup.without_boilerplate(docs, lines, line_dedup.boilerplate(lines, min_sites=5)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r["doc_id"]: r["__text"] for r in out} == plain_line_dedup(docs.collect(), 5)


def test_line_dedup_of_short_documents_and_whole_copies(spark):
    """Boilerplate goes even where it is most of a document; a document of nothing else stays, marked."""
    rows = [(k, f"site{k}", f"a long notice that every site shows\nown {k}\n\n a long notice that every site shows\r") for k in range(12)]
    rows += [(20, "x", "a long notice that every site shows"), (21, None, "a long notice that every site shows\nmore"), (22, "x", None), (23, "x", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.lit(c) for c in ("key", "line", "site", "k")})
    lines = line_dedup.line_table(docs)
    done = line_dedup.without_boilerplate(docs, lines, line_dedup.boilerplate(lines))
    assert set(docs.columns) < set(done.columns)
    out = {r["doc_id"]: r for r in done.collect()}
    assert {i: r["__text"] for i, r in out.items()} == plain_line_dedup([dict(zip(("doc_id", "source", "text"), r, strict=True)) for r in rows], 10)
    assert (out[0]["__text"], out[0]["__n_lines"], out[0]["__n_removed"], out[0]["__whole_copy"]) == ("own 0\n", 4, 2, False)
    assert out[20]["__whole_copy"] and out[20]["__n_removed"] == 0 and out[21]["__text"] == "more"
    assert out[22]["__text"] is None and out[23]["__text"] == "" and not out[22]["__whole_copy"] and not out[23]["__whole_copy"]


def test_hll_band_gets_exact_counts(spark):
    """Lines on 9, 10 and 11 sites fall on the right sides of a threshold of 10."""
    rows = [(f"site{s}", f"line of {k}") for k in (1, 9, 10, 11, 300) for s in range(k)]
    docs = spark.createDataFrame(rows, "source string, text string")
    assert line_dedup.boilerplate(line_dedup.line_table(docs), min_sites=10).count() == 3


def jaccard_classes(rows):
    grams = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for i, t in rows}
    parent, links = {i: i for i in grams}, Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(grams)
    for a in ids:
        for b in ids:
            if a < b and grams[a] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                links[a] += 1
                links[b] += 1
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {i: (find(i), links[i]) for i in grams}


def test_ngram_join_matches_brute_force(spark, documents):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(documents).collect()}
    assert got == jaccard_classes([(r["doc_id"], r["text"]) for r in documents.collect()])


def test_ngram_join_of_a_large_group_of_near_copies(spark, monkeypatch):
    """Blocks of 8 texts: links inside and between blocks, found by pairs and by the matrix."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng, words = np.random.default_rng(1), [f"v{i}" for i in range(300)]
    rows = []
    for i in range(90):
        text = words[:120].copy()
        for k in rng.choice(120, 1 + i % 3, replace=False):
            text[k] = f"z{i}{k}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == jaccard_classes(rows)


def test_words_are_split_at_ascii_white_space_only(spark):
    """Both sides split alike: other spaces are parts of words; long and short blocks hold the same links."""
    base = [f"v{i}" for i in range(40)]
    rows = [(1, " ".join(base)), (2, "\t".join(base[:39]) + " x"), (3, "\u2003".join(base)), (4, "\u2003".join(base) + " "), (5, "\x1c".join(base)), (6, None), (7, " \n"), (8, "\u00a0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (3, 1), 5: (5, 0), 6: (6, 0), 7: (7, 0), 8: (8, 0)}


def test_rows_of_one_id_with_different_texts(spark):
    other = " ".join(f"o{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, other), (1, other), (2, other), (None, "z"), (None, "z"), (None, None)], "doc_id long, text string")
    out = sorted((r["doc_id"] or -1, r["text"] or "") for r in ngram_join.ngram_join_stage(spark, docs, "").collect())
    assert out == sorted([(1, "a b c d e f"), (1, other), (-1, "z"), (-1, "")])


def test_ngram_join_without_broadcasts(spark, documents, monkeypatch):
    rows = lambda: sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(documents).collect())
    want = rows()
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    assert rows() == want


def test_links_by_matrix_equal_links_by_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    grams = [np.unique(np.concatenate([base[rng.random(200) > 0.08], rng.integers(0, 2**63, 5, dtype=np.uint64)])) for _ in range(120)]
    sig = np.stack([ngram_join.signature(g) for g in grams])
    i, j = np.triu_indices(120, 1)
    a, b = ngram_join.links_between(sig, grams, i, j)
    want = {(x, y) for x, y in zip(i, j, strict=True) if len(np.intersect1d(grams[x], grams[y])) >= 0.8 * len(np.union1d(grams[x], grams[y]))}
    assert want and {*zip(a.tolist(), b.tolist(), strict=True)} == want


def test_least_matches_follow_the_posterior():
    """Against numeric integration of the Beta posterior."""
    grid = np.linspace(0, 1, 200_001)
    for seen in (20, 60, 140):
        m = ngram_join.least_matches(seen)
        for k, reaches in ((m, True), (m - 1, False)):
            density = grid**k * (1 - grid) ** (seen - k)
            assert (density[grid >= 0.8].sum() / density.sum() >= ngram_join.TOLERANCE) == reaches


def test_components_match_union_find(spark):
    from barloom.llm import common

    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 600, (400, 2))] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_toxicity_learns_planted_words():
    rng, words = np.random.default_rng(5), [f"n{i}" for i in range(300)]
    texts, y = [], []
    for i in range(600):
        sentences = [" ".join(rng.choice(words, 8)) for _ in range(1 + i % 9)]
        toxic = i % 4 == 0
        if toxic:
            sentences[rng.integers(len(sentences))] += f" badword{'' if i % 8 else 'ly'}"
        texts.append(". ".join(sentences))
        y.append(int(toxic))
    weights = toxicity.fit(texts[:400], y[:400])
    scorer = toxicity.Scorer(weights)
    assert [int(scorer.score(t) >= 0.7) for t in texts[400:]] == y[400:]
    (where, p), *rest = scorer.sentences("calm words. then badword here. calm again")
    assert where == 1 and p > 0.7 and not rest
    assert scorer.score("") == 0 and toxicity.fit(["a b"], [1]) == {}


def test_toxicity_sentences_and_noisy_or(spark):
    weights = {"bad": 6.0}
    docs = spark.createDataFrame([(1, "One. Bad two!\nbad bad"), (2, None)], "doc_id long, text string")
    found = toxicity.offending_sentences(docs, weights).collect()
    assert [(r["sentence_no"], r["sentence"]) for r in found] == [(1, "Bad two"), (2, "bad bad")]
    score = {r["doc_id"]: r["score"]["score"] for r in toxicity.with_score(docs, weights).collect()}
    p = found[0]["probability"]
    assert math.isclose(score[1], 1 - (1 - p) ** 2) and score[2] == 0


def test_quality_held_out(spark):
    data = "/root/testdata/sf0.01"
    out = quality.op7_quality(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in out)
    assert right / len(out) > 0.95 and all(0 <= r["score"] <= 1 for r in out)


def test_factorisation_identity():
    """The sum-of-squares form over active features equals the sum over pairs."""
    rng = np.random.default_rng(6)
    m = quality.Machine(np.zeros((quality.STATISTICS, quality.BINS - 1)))
    m.v, m.w, m.w0 = rng.normal(size=m.v.shape), rng.normal(size=m.w.shape), 0.3
    rows = [(rng.choice(m.size, n, replace=False), rng.normal(size=n)) for n in (9, 1, 20)]
    got = m.logits(*m.together(rows))[0]
    for (at, x), z in zip(rows, got, strict=True):
        pairs = sum(float(m.v[a] @ m.v[b]) * x[i] * x[j] for i, a in enumerate(at) for j, b in enumerate(at) if i < j)
        assert math.isclose(z, 0.3 + float(m.w[at] @ x) + pairs, rel_tol=1e-9, abs_tol=1e-9)


def plain_toxicity(text, weights):
    """Score and offending sentences of a text, restated."""
    import re

    rest, found, base = 1.0, [], 1 / (1 + math.exp(4))
    for no, sentence in enumerate(re.split(r"[.!?\n]+", text)):
        held = {w[:n] + ("*" if n < len(w) else "") for w in re.findall(r"\w+", sentence.lower()) for n in (3, 4, 5, 6, len(w)) if n <= len(w)} & weights.keys()
        p = (1 / (1 + math.exp(4 - sum(weights[f] for f in held))) - base) / (1 - base)
        rest *= 1 - p
        if p >= 0.5:
            found.append((no, sentence.strip()))
    return 1 - rest, found


def test_toxicity_query_matches_a_plain_rescoring(spark):
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    weights = toxicity.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    out = toxicity.op4_toxicity(spark, data).collect()
    assert len(out) == len(texts) and weights
    for r in out:
        score, found = plain_toxicity(texts[r["doc_id"]], weights)
        assert r["score"] == pytest.approx(score, abs=1e-9) and r["predicted"] == (r["score"] >= 0.7)
        assert [(f["sentence_no"], f["sentence"]) for f in r["offending"]] == found
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    held = [(labels[r["doc_id"]], r["predicted"]) for r in out if r["held_out"] and labels.get(r["doc_id"]) in (0, 1)]
    assert sum(y == p for y, p in held) / len(held) > 0.95


def test_quality_query_matches_a_plain_rescoring(spark):
    """Every score against a dense row and the sum over all pairs of a machine trained alike."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    m, out = quality.train(docs, labels), {r["doc_id"]: r for r in quality.op7_quality(spark, DATA).collect()}
    gram = m.v @ m.v.T
    for r in docs.collect():
        stats, words = quality.describe(r["text"] or "", {})
        x = np.zeros(m.size)
        x[words] = 1 / np.sqrt(len(words)) if len(words) else 0
        for j, s in enumerate(stats):
            x[quality.BUCKETS + j * quality.BINS + sum(s > e for e in m.edges[j])] = 0.5
        pairs = (np.outer(x, x) * gram).sum() / 2 - (x**2 * gram.diagonal()).sum() / 2
        assert out[r["doc_id"]]["score"] == pytest.approx(1 / (1 + math.exp(-(m.w0 + m.w @ x + pairs))), abs=1e-9)
        assert out[r["doc_id"]]["predicted"] == (out[r["doc_id"]]["score"] >= 0.3)


def test_samples_take_texts_of_any_length_within_their_budget(spark):
    docs = spark.createDataFrame([(i, "word " * (100_000 if i == 3 else 5)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, y int")
    none = F.lit(False)
    whole = labelled.labelled_sample(docs, labels, "y", none, 100, 10**7)
    assert len(whole) == 40 and whole["text"].str.len().max() == 500_000
    few = labelled.labelled_sample(docs, labels, "y", none, 100, 300)
    assert 0 < few[few["y"] == 0]["text"].str.len().sum() <= 300 and few["text"].str.len().max() < 500_000
    assert len(labelled.labelled_sample(docs, labels, "y", none, 7, 10**7)) == 14


def test_samples_skip_the_held_out_fold(spark, documents):
    import zlib

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    sample = labelled.labelled_sample(documents, labels, "quality", labelled.fold(5) == 0, 1000, 10**6)
    ids = [r["doc_id"] for r in labels.where("quality is not null").collect()]
    held = sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in ids)
    assert len(sample) == len(ids) - held and held


def test_a_text_over_the_budget_empties_no_class(spark):
    docs = spark.createDataFrame([(i, "word " * (200_000 if i < 3 else 5)) for i in range(40)], "doc_id long, text string")
    none = F.lit(False)
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(40)], "doc_id long, y int")
    for budget in (500_000, 400):
        few = labelled.labelled_sample(docs, labels, "y", none, 100, budget)
        assert {0, 1} == set(few["y"]) and few["text"].str.len().max() == 25
        assert len(few) == (37 if budget == 500_000 else 32)
    alone = spark.createDataFrame([(i, int(i < 3)) for i in range(40)], "doc_id long, y int")
    few = labelled.labelled_sample(docs, alone, "y", none, 100, 400)
    assert (few["y"] == 1).sum() == 1 and (few["y"] == 0).sum() == 16


def test_rows_without_ids_give_one_payload_a_text(spark, monkeypatch):
    from barloom.llm import common, ngram_join

    words = [f"w{i}" for i in range(60)]
    near = [*words[:30], "other", *words[31:]]
    rows = [(None, " ".join(words if i % 2 else near)) for i in range(400)] + [(7, " ".join(words))] * 30
    written = {}
    keep = common.write_shared
    monkeypatch.setattr(common, "write_shared", lambda df, name: written.setdefault(name, keep(df, name)))
    out = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert written["payload"].count() == 2
    assert {(r["class_id"], r["n_links"]) for r in out} == {(7, 429)}
