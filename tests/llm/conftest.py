import pytest


@pytest.fixture()
def frame(spark):
    """A table from rows; a string names the columns' types."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make
