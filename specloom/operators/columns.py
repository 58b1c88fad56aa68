"""Assigns the k cells of a table row to its n model columns, merged cells covering several.

Columns are cut into k contiguous groups; the squared distances of cells from their groups' mean columns are summed in
the order of the cells, and the cut of the smallest sum wins, ties by the smallest group starts from the last group
backwards. A dynamic programme over cells and columns finds it within the row, for any number of columns; rows of equal
shape are worked on together in numpy. Sums are floating: two beginnings of unequal cost may be level at the end, as
adding rounds. Rows where that could be are searched again with all beginnings that can still win.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specloom.fixed import LONE_SPACING

# executors need not have this module: its functions travel with the plan
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Floats that the means of one step may take up.
_STEP = 1 << 21


def _means(c: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """The mean of columns a to j - 1 of each row, summed from the left."""
    out = {}
    for a in range(c.shape[1]):
        total = np.zeros(len(c))
        for j in range(a + 1, c.shape[1] + 1):
            total = total + c[:, j - 1]
            out[a, j] = total / (j - a)
    return out


def _slack(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """What rounding may make of the difference of two sums, generously: by a bound of all cuts' sums."""
    far = np.maximum(np.abs(x - c.min(axis=1)[:, None]), np.abs(x - c.max(axis=1)[:, None]))
    return (far * far).sum(axis=1) * (x.shape[1] + 2) * 2.0**-50


def _search(x: np.ndarray, means: dict[tuple[int, int], float], n: int, slack: float) -> list[int]:
    """Group starts of one row: of the beginnings over j columns all that no other beats in both cost and starts are kept."""
    best: dict[int, list] = {0: [(0.0, ())]}
    for i, v in enumerate(x):
        new = {}
        for j in range(i + 1, n - (len(x) - i - 1) + 1):
            each = sorted((cost + (v - means[a, j]) * (v - means[a, j]), (a, *starts)) for a in range(i, j) for cost, starts in best.get(a, ()))
            kept = []
            for cost, starts in each:
                if cost > each[0][0] + slack:
                    break
                if not kept or starts < kept[-1][1]:
                    kept.append((cost, starts))
            new[j] = kept
        best = new
    return list(best[n][0][1][::-1])


def _starts(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Group starts (from 0) of the best cut of each row: x has the rows' cells, c their columns, at least as many."""
    (m, k), n = x.shape, c.shape[1]
    means, slack = _means(c), _slack(x, c)
    cost, level = {0: np.zeros(m)}, np.zeros(m, dtype=bool)
    back = np.zeros((k, n + 1, m), dtype=np.int32)
    for i in range(k):
        new = {}
        for j in range(i + 1, n - (k - i - 1) + 1):
            best = second = np.full(m, np.inf)
            for a in range(i, j):
                if a in cost:
                    d = x[:, i] - means[a, j]
                    own = cost[a] + d * d
                    second = np.minimum(second, np.maximum(best, own))
                    back[i, j] = np.where(own < best, a, back[i, j])
                    best = np.minimum(best, own)
            level |= second <= best + slack
            new[j] = best
        cost = new
    out, at, rows = np.empty((m, k), dtype=np.int32), np.full(m, n), np.arange(m)
    for i in range(k - 1, -1, -1):
        out[:, i] = at = back[i, at, rows]
    for r in np.flatnonzero(level):
        out[r] = _search(x[r].tolist(), {at: v[r].item() for at, v in means.items()}, n, slack[r])
    return out


def _values(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes (0: null or empty), first places and values of an array of lists."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes, np.cumsum(sizes) - sizes, lists.flatten().to_numpy(zero_copy_only=False).astype(float)


@F.arrow_udf(T.StructType([T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("firsts", "lasts")]))
def _assigned(cells: pa.Array, centers: pa.Array) -> pa.Array:
    (ks, xs, x), (ns, cs, c) = _values(cells), _values(centers)
    size = np.where((ks > 0) & (ks <= ns), ks, 0)
    shape = size * (int(ns.max(initial=0)) + 1) + np.where(size > 0, ns, 0)
    found = []
    for s in np.unique(shape[size > 0]):
        every = np.flatnonzero(shape == s)
        k, n = int(size[every[0]]), int(ns[every[0]])
        step = max(1, _STEP // (n * n))
        for rows in (every[b : b + step] for b in range(0, len(every), step)):
            px, pc = x[xs[rows][:, None] + np.arange(k)], c[cs[rows][:, None] + np.arange(n)]
            sound = np.isfinite(px).all(axis=1) & np.isfinite(pc).all(axis=1)
            rows, px, pc = rows[sound], px[sound], pc[sound]
            firsts = _starts(px, pc) if len(rows) else np.empty((0, k), dtype=np.int32)
            lasts = np.concatenate([firsts[:, 1:] - 1, np.full((len(rows), 1), n - 1, dtype=np.int32)], axis=1)
            space = ((pc[:, -1] - pc[:, 0]) / (n - 1) if n > 1 else np.full(len(rows), LONE_SPACING))[:, None]
            near = ((px >= np.take_along_axis(pc, firsts, 1) - space) & (px <= np.take_along_axis(pc, lasts, 1) + space)).all(axis=1)
            found.append((rows[near], firsts[near], lasts[near]))
    got = np.zeros(len(size), dtype=np.int64)
    for rows, firsts, _ in found:
        got[rows] = firsts.shape[1]
    ends = np.concatenate([[0], np.cumsum(got)])
    flat = np.empty((2, ends[-1]), dtype=np.int32)
    for rows, *both in found:
        place = ends[rows][:, None] + np.arange(both[0].shape[1])
        for side, value in zip(flat, both, strict=True):
            side[place] = value
    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(side)) for side in flat]
    return pa.StructArray.from_arrays(lists, ["firsts", "lasts"], mask=pa.array(got == 0))


def assigned(cells: Column, centers: Column) -> Column:
    """struct(firsts, lasts): for each cell center of the array cells the first and last column (from 0) that it covers.

    Null without cells, with more cells than columns, with a cell further than one spacing outside its group, or with a
    number that is null or not finite.
    """
    return _assigned(cells.cast("array<double>"), centers.cast("array<double>"))


def assign_columns(df: DataFrame, key: list[str], cells: str, centers: str) -> DataFrame:
    """(key, firsts, lasts) of the rows that assigned() gives a value."""
    own = df.select(*key, assigned(F.col(cells), F.col(centers)).alias("g"))
    return own.where("g IS NOT NULL").select(*key, "g.firsts", "g.lasts")
