"""The smallest tables; the Spark session comes from the suite's conftest."""

import pytest


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
