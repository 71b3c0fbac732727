import pytest

from helpers import awkward


@pytest.fixture(scope="session")
def docs(spark):
    schema = "doc_id long, text string, lang string, source string"
    return spark.createDataFrame(awkward(), schema).selectExpr("*", "length(text) AS n_chars", "1 AS size", "2 AS score", "3 AS n_words", "'x' AS shard", "4 AS hits")


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)


@pytest.fixture
def rows():
    return awkward()
