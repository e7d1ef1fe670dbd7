import pytest
from llm_rows import CLASHING, SCHEMA, awkward_rows


@pytest.fixture(scope="session")
def awkward(spark):
    rows = awkward_rows()
    full = [(k, x, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, len(x) if x else None, *[f"{c}{i}" for c in CLASHING]) for i, (k, x) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
