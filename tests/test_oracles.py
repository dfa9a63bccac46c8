"""Every query that SQL can express against DuckDB."""

import pytest

from envlattice.plans import registry
from tests.oracle import assert_same

#: What no text of the smallest table has.
EMPTY = {"fingerprinted_literals"}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, name):
    assert assert_same(spark, name, "/root/testdata/sf0.001") or name in EMPTY
