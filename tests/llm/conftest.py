import pytest
from corpus_helpers import frame, tricky_texts  # tests/llm


@pytest.fixture(scope="session")
def tricky(spark):
    return frame(spark, tricky_texts()).repartition(3).persist()


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])
