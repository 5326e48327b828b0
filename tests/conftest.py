from __future__ import annotations

import pytest

import compare
from skyvane.session import local_session
from skyvane.sources.tables import driver_tables

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    return driver_tables(spark, SMALL)


@pytest.fixture(scope="session")
def db():
    return compare.connection(SMALL)
