import pytest
from corpus_cases import ODD, odd_rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
