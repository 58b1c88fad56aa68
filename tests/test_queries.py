"""Every core query with oracle SQL gives DuckDB's rows; the entry gives rows."""

from __future__ import annotations

import os

import pytest

from specloom.plans import registry
from tests.util import oracle, rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_oracle(spark, name):
    assert rows(registry.QUERIES[name](spark, SF)) == oracle(SF, registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
