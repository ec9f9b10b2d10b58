"""Every registered query agrees with its SQL."""

import pytest

from creatorlake.catalog import ORACLES, QUERIES
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    assert name in ORACLES
    assert compare(spark, con, sf_dir, QUERIES[name], ORACLES[name]) is None
