"""Small tables with every odd case."""

import pytest

from tests.llm.tables import SCHEMA, corpus


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def llm(spark):
    from leadlens.llm.common import prepare

    prepare(spark)
    return spark


@pytest.fixture(scope="session")
def docs(llm, rows):
    return llm.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(llm):
    return llm.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def by_id(rows):
    """Text of each id that is not null."""
    return {r[0]: r[1] for r in rows if r[0] is not None}
