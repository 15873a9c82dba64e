"""Small tables with the cases that every operator must bear."""

import pytest

WORDS = [f"w{i}" for i in range(400)]
BASE = " ".join(WORDS[:60])
NEAR = " ".join([*WORDS[:30], "other", *WORDS[31:60]])
DOCS = [
    # doc_id, text, lang, source, n_chars
    (1, BASE, "en", "a", 100),
    (2, BASE, "en", "b", 100),
    (3, BASE + " tail", "en", "a", 100),
    (4, NEAR, "en", None, 100),
    (5, None, None, None, None),
    (6, "", "en", "a", 0),
    (7, "  \n\t ", "en", "c", 5),
    (8, "short text", "en", "c", 10),
    (9, "short text", "en", "c", 10),
    (9, "short text", "en", "c", 10),
    (10, " ".join(WORDS * 60), "en", "b", 9),
    (11, "x", "en", "c", 1),
    (None, " ".join(WORDS[100:180]), "en", "b", 9),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside; the tables carry them as extra columns.
CLASHES = ("size", "score", "key", "bucket", "tid", "kept", "line", "host", "rule", "y", "k", "n", "target", "words")


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHES})


@pytest.fixture(scope="session")
def docs(spark):
    return with_clashes(spark.createDataFrame(DOCS, SCHEMA))


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def tables(spark, docs, tmp_path_factory):
    """A folder of edge-case tables and one of empty tables."""
    from pyspark.sql import functions as F

    full, empty = (str(tmp_path_factory.mktemp(n)) for n in ("full", "empty"))
    html = '<html><body><nav><a href="/x">Menu</a></nav><article><h1>Title</h1><p>Some &amp; text.<p>More text here.</article><footer>End</footer></body></html>'
    pages = [(1, "https://A.example.com/en/7?x", html), (2, None, None), (3, "no scheme", ""), (3, "no scheme", ""), (4, "http://example.net/de/8#f", "<p>" * 3000 + "deep"), (5, "x://host://y/z", html * 3)]
    vectors = [(1, [1.0, 0.0, 0.0]), (2, [0.99, 0.01, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [float("nan"), 1.0, 0.0]), (6, [1.0, None, 0.0]), (7, [0.0, 1.0, 0.0]), (8, [0.0, 5.0, 0.1]), (9, [1.0, 0.0]), (2, [0.99, 0.01, 0.0])]
    made = {
        "documents": docs,
        "labels": spark.createDataFrame([(1, 1, 0), (3, 0, 1), (4, None, None), (8, 0, 1), (11, 1, 0), (None, 1, 1), (1, 1, 0)], "doc_id bigint, quality int, toxic int"),
        "pages": with_clashes(spark.createDataFrame(pages, "page_id bigint, url string, html string")),
        "embeddings": with_clashes(spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")).withColumn("label", F.lit(1)),
    }
    for name, df in made.items():
        df.write.parquet(f"{full}/{name}.parquet")
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
    return full, empty
