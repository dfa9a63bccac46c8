"""Queries that SQL expresses in full, against DuckDB."""

import pytest

from tests.llm.oracle import assert_same


@pytest.mark.parametrize("name", ["quality_counts", "op8_hnsw", "op9_substrings", "op10_warc"])
@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_same_as_sql(spark, name, scale):
    assert_same(spark, name, f"/root/testdata/{scale}")
