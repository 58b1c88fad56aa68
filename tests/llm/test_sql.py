"""Queries of the corpus operators against their oracle SQL."""

from __future__ import annotations

import os

import pytest

from specloom.llm import registry
from tests.llm.util import SF
from tests.util import oracle, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_oracle(spark, name):
    assert rows(registry.QUERIES[name](spark, SF)) == oracle(SF, registry.SQL[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
