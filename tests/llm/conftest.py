import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """DataFrame from rows and a schema text."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
