"""The pipeline against a plain version of each stage, on the smallest tables."""

from collections import Counter

import corpus_pipeline
from test_documents import DATA, jaccard_classes, plain_line_dedup, water_fill

from barloom.llm import line_dedup, mixing, toxicity


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    weights = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    scorer, now = toxicity.Scorer(weights), docs
    stages = dict(corpus_pipeline.STAGES)
    rows = {r["doc_id"]: r.asDict() for r in now.collect()}

    now = stages["toxicity"](spark, now, DATA).cache()
    clean = {r["doc_id"] for r in now.collect()}
    assert clean == {i for i, r in rows.items() if scorer.score(r["text"]) < toxicity.THRESHOLD}

    now = stages["line_dedup"](spark, now, DATA).cache()
    got = {r["doc_id"]: r.asDict() for r in now.collect()}
    assert {i: r["text"] for i, r in got.items()} == plain_line_dedup([rows[i] for i in clean], line_dedup.MIN_SITES)
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())

    now = stages["ngram_join"](spark, now, DATA).cache()
    kept = {r["doc_id"]: r.asDict() for r in now.collect()}
    assert set(kept) == {i for i, (c, _) in jaccard_classes([(i, r["text"]) for i, r in got.items()]).items() if i == c}
    assert all(kept[i] == got[i] for i in kept)

    keys = {r["doc_id"]: r["key"] for r in mixing.document_stats(now).collect()}
    size = {i: len(r["text"].split()) for i, r in kept.items()}
    sizes = Counter()
    for i, r in kept.items():
        sizes[r["source"]] += size[i]
    targets = water_fill(sizes, {s: 1 + k % 3 for k, s in enumerate(sorted(sizes))})
    want = Counter()
    for s in sizes:
        epochs = int(targets[s] // sizes[s])
        left = round(targets[s] - epochs * sizes[s])
        for i in sorted((i for i in kept if kept[i]["source"] == s), key=lambda i: (keys[i], i)):
            part = min(size[i], max(left, 0))
            left -= size[i]
            want[i] = epochs + (2 * part >= max(size[i], 1))
    now = stages["mixing"](spark, now, DATA).cache()
    assert Counter(r["doc_id"] for r in now.collect()) == +want

    packed = stages["packing"](spark, now, DATA).collect()
    assert Counter(r["doc_id"] for r in packed) == +want
    for r in packed:
        assert r["n_tokens"] == size[r["doc_id"]] <= r["padded_len"]
    assert max(Counter((r["bucket"], r["batch"]) for r in packed).values()) <= max(r["batch_size"] for r in packed)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "n_tokens", "bucket", "padded_len", "batch", "batch_size"] and out.count() > 100
