import pytest
from cases import edge_rows, frame


@pytest.fixture(scope="session")
def edge(spark):
    rows = edge_rows()
    return frame(spark, rows).repartition(3), rows


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])
