import os

import pytest

#: Documents with all that may come along: nulls, empty and long texts, ties, repeated rows, clashing names.
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, size int, pattern string, " \
    "fp bigint, place bigint, score double, _row bigint, copies int, part int, word bigint, rank int, failed bigint"
LONG = " ".join(f"word{i % 977} stone {i}" for i in range(60_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank", "en", "a"),
    (2, "the QUICK brown fox jumps over the lazy dog near the old river bank", "en", "a"),
    (3, "Le renard brun saute par-dessus le chien près de la vieille rivière", "fr", "b"),
    (4, "", "en", "b"),
    (5, None, None, None),
    (6, " \t\n", "fr", None),
    (7, LONG, "en", "a"),
    (8, "same same same same same same same same same same same same", None, "é"),
    (8, "same same same same same same same same same same same same", None, "é"),
    (None, "A row without an id still has words to count and to keep", "en", "a"),
    (9, "12345 67890 !!! ???", "en", "a"),
    (10, "one", "en", "b"),
    (11, "naïve café İstanbul 東京 \U0001f600 end", None, "b"),
]


@pytest.fixture(scope="session")
def edge_texts():
    return TEXTS


@pytest.fixture(scope="session")
def edge_docs(spark, edge_texts):
    rows = [(*t, None, 7, 7, "x", 7, 7, 0.5, 7, 7, 7, 7, 7, 7) for t in edge_texts]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.filter("false")


@pytest.fixture(scope="session")
def small_dir():
    return os.environ.get("TEST_LLM_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def docs(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return docs.toPandas()
