import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fixtures import SCHEMA, awkward_documents, frame  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    return awkward_documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def schema():
    return SCHEMA
