"""Every registered query against its SQL form on the smallest data folder."""

import pytest

import checks.all  # noqa: F401
from checks.compare import compare, connect
from checks.registry import CASES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(CASES))
def test_case(name, spark, con, sf_dir):
    line = compare(name, spark, con, sf_dir)
    assert line.startswith(("OK", "ROWS")), line
