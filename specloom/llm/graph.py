"""Connected components: alternating large-star and small-star rounds on DataFrames; few links in one task.

Few means LOCAL_LINKS at most, counted before: a bound of 16 MB, not a share of the input. Either way gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.llm.common import discard, map_batches, materialize, observed, spread_join

#: Links that one task joins by itself; more are joined in rounds over all tasks.
LOCAL_LINKS = 1 << 19


def _smallest(rows: DataFrame) -> tuple[DataFrame, int]:
    """(v, m: the smallest u of v, n: rows of v) as a table, and the rows of all."""
    low, seen = observed(rows.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n")), "low", total=F.sum("n"))
    return low, seen["total"] or 0


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, component) of at most LOCAL_LINKS edges (v, u)."""
    kind = edges.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        n = sum(b.num_rows for b in held)
        ends = pa.concat_arrays([b.column(c) for c in ("v", "u") for b in held])
        names = pc.unique(ends)
        names = names.take(pc.sort_indices(names))
        at = pc.index_in(ends, names).to_numpy()
        v, u = at[:n], at[n:]
        label = np.arange(len(names))
        while len(v):
            a, b = label[v], label[u]
            low, high = np.minimum(a, b), np.maximum(a, b)
            apart = low != high
            v, u = v[apart], u[apart]
            np.minimum.at(label, high[apart], low[apart])
            while not np.array_equal(label, further := label[label]):
                label = further
        for a in range(0, len(names), 1 << 16):
            yield pa.RecordBatch.from_pydict({"node": names[a : a + (1 << 16)], "component": names.take(pa.array(label[a : a + (1 << 16)]))})

    return map_batches(edges.select("v", "u").coalesce(1), run, f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50, local: int = LOCAL_LINKS) -> DataFrame:
    """(node, component): component is the smallest node reachable. Nodes without a link are absent.

    Each round replaces every node's links by links to the smallest neighbour; the edge set shrinks to
    stars in O(log^2 n) rounds, and may become few enough for one task before. Minima are partial aggregates and come
    back by a join that deals a hub's rows over many tasks, so its neighbours are never gathered in one place. Self
    links and repeated links are dropped, null ends too.
    """
    e = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("v <> u").distinct()
    state = {"n": F.count(F.lit(1)), "s": F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))}
    now, new = observed(e, "edges", **state)
    old = None
    by = F.xxhash64("u")
    for _ in range(max_rounds):
        if new["n"] <= local:
            return _in_one_task(now)
        if old == new:
            break
        both = now.select("v", "u").unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low, total = _smallest(both)
        near = low.select("v", F.least("v", "m").alias("m"), "n")
        large = spread_join(both, near, ["v"], "n", by, total).where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        mid = materialize(large.select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")), "edges")
        low2, total = _smallest(mid)
        small = spread_join(mid, low2, ["v"], "n", by, total).where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(low2.select("v", F.col("m").alias("u")))
        small = small.select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")).where("v <> u").distinct()
        then, then_state = observed(small, "edges", **state)
        discard(now, mid, low, low2)
        now, old, new = then, new, then_state
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
