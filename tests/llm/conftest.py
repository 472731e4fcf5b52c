import pytest
from samples import SCHEMA, corpus


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ["g", "key", "row", "n", "start", "blob", "sig", "size", "target", "fp", "sha", "class", "component_id", "kept", "score", "taken", "bucket", "a", "b", "node", "hashes"]
    return docs.select("*", *[F.lit("x").alias(c) for c in names])
