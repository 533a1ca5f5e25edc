import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from prefixloom.session import local

    session = local(4, "4g", "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from prefixloom.sources.fixtures import Tables

    return Tables(spark, DATA)
