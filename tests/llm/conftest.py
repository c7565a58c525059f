import pytest


@pytest.fixture(scope="session", autouse=True)
def prepared(spark):
    from nestquery.llm.tables import prepare

    return prepare(spark)
