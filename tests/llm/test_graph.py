"""Components of small graphs, in one task and in rounds, against a walk."""

from __future__ import annotations

import random

import pytest

from specloom.llm.graph import LOCAL_LINKS, connected_components
from tests.llm import util


@pytest.mark.parametrize("local", [LOCAL_LINKS, -1])
def test_components(spark, local):
    g = random.Random(4)
    links = [(0, i) for i in range(1, 300)]  # a hub
    links += [(1000 + i, 1001 + i) for i in range(60)]  # a chain
    links += [(g.randint(2000, 2400), g.randint(2000, 2400)) for _ in range(250)] + [(7, 7), (None, 3), (5, None)]
    df = spark.createDataFrame(links, "a long, b long")
    good = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    want = util.groups(sorted({x for p in good for x in p}), good)
    out = connected_components(df, local=local).collect()
    assert {r.node: r.component for r in out} == want and len(out) == len(want)
    assert connected_components(df.limit(0), local=local).count() == 0


def test_components_of_texts(spark):
    df = spark.createDataFrame([("b", "a"), ("é", "z"), ("c", "b"), ("z", "😀")], "a string, b string")
    out = {r.node: r.component for r in connected_components(df).collect()}
    assert out == {"a": "a", "b": "a", "c": "a", "z": "z", "é": "z", "😀": "z"}
