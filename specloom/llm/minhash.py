"""MinHash near-dedup by SetSketch registers: banded candidates, joint likelihood estimate, exact verification.

One pass over the texts makes each document's distinct shingle hashes, their number, a digest of the set and
SetSketch registers: K_i = floor(1 - log_b x_i), where x_i is the minimum of exponential variates over the set,
truncated to 0..q+1. Registers of a union are the maxima of registers, so sketches merge. Documents of equal
sets become one class. Bands of registers deal the classes' representatives into buckets.

Links: in each bucket everyone is compared with the bucket's smallest id, so a bucket of n ids gives n - 1 pairs.
Verified links give components. Where a bucket still holds several components, the pairs across them (never
those within its largest one) are estimated in blocks of bounded size. A member of the largest component goes to one
block, which meets the blocks of the other members; only those are copied. No pair leaves a block: only the members do
that have a likely partner, each pair in the first band that it shares. Their full sets meet once more in blocks of
bounded size, which count all intersections exactly and give the links of a spanning forest, at most one less than
members. Whatever the buckets hold, a pair that shares a band is therefore linked, already connected, or estimated
so low that it isn't a link but for the chance that MARGIN leaves.

A bucket, component or hub of very many members meets its counts in as many tasks (spread_join).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm.common import arrow_map, binary_slices, by_shuffle, discard, fresh_name, materialize, mix64, observed, partitions, shingle_sets, spread_join, text_bytes
from specloom.llm.graph import connected_components

WIDTH = 4
THRESHOLD = 80  # hundredths
BANDS = 32
ROWS = 4
#: SetSketch parameters: base, rate of the exponential variates, largest register less one.
BASE = 1.001
RATE = 20.0
LIMIT = (1 << 16) - 2
#: An estimate this far under the threshold rules a pair out: at 128 registers a pair at 0.8 has as few equal ones
#: (at most 73 of 128) with a chance of 3e-9.
MARGIN = 0.225
#: Members of a bucket that meet in one task, and shingles of theirs where full sets meet; bands are numbered by a byte.
BLOCK = 1024
BLOCK_SHINGLES = 1 << 20
MAX_BANDS = 256
#: Shingles that so many members share are counted by a matrix product, others pair by pair.
DENSE = 16

_MULTIPLIERS = [np.uint64(((0x9E3779B97F4A7C15 * (2 * k + 1)) ^ (0xC2B2AE3D27D4EB4F * (k + 7))) & ((1 << 64) - 1) | 1) for k in range(1024)]


def registers(sets: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """(texts, m) uint16 SetSketch registers; an empty set has all 0."""
    sizes = np.diff(first)
    some = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), m), np.uint16)
    if not len(some):
        return out
    starts = first[:-1][some]
    low = np.empty((m, len(some)), np.uint64)
    # blocks that stay in cache: whole sets where they are small, else one set at a time
    step = 1 << 15
    a = 0
    while a < len(some):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + step)))
        end = first[some[b - 1] + 1]
        x = sets[starts[a] : end]
        at = starts[a:b] - starts[a]
        for k in range(m):
            low[k, a:b] = np.minimum.reduceat(x * _MULTIPLIERS[k], at)
        a = b
    u = (low.astype(np.float64) + 0.5) * 2.0**-64
    x = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    k = np.floor(1.0 - np.log(x) / math.log(BASE))
    out[some] = np.clip(k, 0, LIMIT + 1).astype(np.uint16).T
    return out


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Likeliest Jaccard similarity of pairs given registers that are larger, smaller or equal, and set sizes."""
    m = ra.shape[1]
    up = (ra > rb).sum(1).astype(float)
    down = (ra < rb).sum(1).astype(float)
    same = m - up - down
    u = na / np.maximum(na + nb, 1)
    v = 1 - u
    c = (BASE - 1) / BASE
    log_b = math.log(BASE)

    def p(x):
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * c) / log_b, 1e-12, 1 - 1e-12)

    def value(j):
        pu, pd = p(u - v * j), p(v - u * j)
        return up * np.log(pu) + down * np.log(pd) + same * np.log(np.clip(1 - pu - pd, 1e-12, 1))

    lo, hi = np.zeros(len(u)), np.minimum(u / np.maximum(v, 1e-12), v / np.maximum(u, 1e-12))
    g = (math.sqrt(5) - 1) / 2
    for _ in range(30):  # golden section: the likelihood is unimodal
        x, y = hi - g * (hi - lo), lo + g * (hi - lo)
        left = value(x) > value(y)
        hi, lo = np.where(left, y, hi), np.where(left, lo, x)
    return (lo + hi) / 2


def _equal(ra: np.ndarray, rb: np.ndarray) -> np.ndarray:
    """How many registers of each row of ra equal those of rb; registers come in multiples of 64 or are padded."""
    bits = np.packbits(ra == rb, axis=1)
    if bits.shape[1] % 8:
        bits = np.pad(bits, ((0, 0), (0, 8 - bits.shape[1] % 8)))
    return np.bitwise_count(bits.view(np.uint64)).sum(1, dtype=np.int64)


def _sketches(base: DataFrame, kind: str, width: int, m: int) -> DataFrame:
    """(k, n, d1, d2, regs): id, set size, digest of the set, registers as bytes."""

    def fn(batch: pa.RecordBatch) -> dict:
        n, d1, d2, regs = [], [], [], []
        for _, _, data, off in binary_slices(batch.column("t")):
            sets, first = shingle_sets(data, off, width)
            n.append(np.diff(first))
            for out, x in ((d1, sets), (d2, mix64(sets + np.uint64(0x632BE59BD9B4E019)))):
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
                out.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
            regs.extend(r.tobytes() for r in registers(sets, first, m))
        return {"k": batch.column("k"), "n": pa.array(np.concatenate(n), pa.int64()), "d1": pa.array(np.concatenate(d1)), "d2": pa.array(np.concatenate(d2)), "regs": pa.array(regs, pa.binary())}

    return arrow_map(base, fn, f"k {kind}, n long, d1 long, d2 long, regs binary")


def _bands(reps: DataFrame, kind: str, bands: int, rows: int) -> DataFrame:
    """(bucket, k): a row for each band of each representative."""

    def fn(batch: pa.RecordBatch) -> dict:
        r = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(batch.num_rows, -1).astype(np.uint64)
        keys = np.empty((batch.num_rows, bands), np.uint64)
        for j in range(bands):
            h = np.full(len(r), j + 1, np.uint64)
            for c in range(j * rows, (j + 1) * rows):
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + r[:, c])
            keys[:, j] = (h >> np.uint64(8) << np.uint64(8)) | np.uint64(j)  # the low byte says which band
        return {"bucket": pa.array(keys.ravel().view(np.int64)), "k": batch.column("k").take(pa.array(np.repeat(np.arange(batch.num_rows), bands)))}

    return arrow_map(reps, fn, f"bucket long, k {kind}", 4096)


def _estimated(pairs: DataFrame, reps: DataFrame, kind: str, least: float) -> DataFrame:
    """Pairs (a, b) whose estimate reaches least; sketches come by joins."""
    a = reps.select(F.col("k").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    b = reps.select(F.col("k").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    # a pair whose sizes differ too much can't be a link
    both = pairs.join(a, "a").join(b, "b").where(F.least("na", "nb") >= F.greatest("na", "nb") * least)

    def fn(batch: pa.RecordBatch) -> dict:
        n = batch.num_rows
        ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(n, -1) for c in ("ra", "rb"))
        good = pa.array(estimate(ra, rb, *(batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))) >= least)
        return {c: batch.column(c).filter(good) for c in ("a", "b")}

    return arrow_map(both.select("a", "b", "na", "nb", "ra", "rb"), fn, f"a {kind}, b {kind}", 8192)


def _verified(pairs: DataFrame, sets: DataFrame, kind: str, threshold: int) -> DataFrame:
    """Pairs with 100 * intersection >= threshold * union on the full sets."""
    # the smaller id is often the hub of many pairs: its set comes last, so the shuffle that carries sets is dealt by the other end
    both = pairs.join(sets.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a")

    def fn(batch: pa.RecordBatch) -> dict:
        good = []
        for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            z = np.concatenate((x, y))
            z.sort(kind="stable")
            both = int((z[1:] == z[:-1]).sum())
            good.append(100 * both >= threshold * (len(x) + len(y) - both))
        good = pa.array(good, pa.bool_())
        return {c: batch.column(c).filter(good) for c in ("a", "b")}

    return arrow_map(both.select("a", "b", "sa", "sb"), fn, f"a {kind}, b {kind}", 256)


def _gathered(dealt: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (bucket, i, j, own, columns) of bounded blocks as arrays g."""
    # few bytes, much work: the number of partitions is fixed, so that they aren't merged
    return dealt.repartition(partitions(dealt.sparkSession), "bucket", "i", "j").groupBy("bucket", "i", "j").agg(F.collect_list(F.struct("own", *columns)).alias("g"))


def _dealt(rows: DataFrame, blocks, columns: list[str]) -> DataFrame:
    """rows (bucket, k, ...) gathered by pairs of blocks (i <= j) of their bucket, as arrays g of (own: the block, columns)."""
    own = F.pmod(F.xxhash64("k"), blocks.cast("long")).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *columns)
    return _gathered(dealt, columns)


def _dealt_apart(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The same for rows (bucket, n_most, n_rest, most, k, ...), but for pairs of two members of the largest component (most).

    The others fill blocks 0 to r - 1, the largest component blocks r to r + m - 1: a block of the former meets all
    blocks, a block of the latter those of the former alone.
    """
    r, m = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("n_rest", "n_most"))
    at = F.xxhash64("k")
    own = F.when(F.col("most"), r + F.pmod(at, m.cast("long")).cast("int")).otherwise(F.pmod(at, F.greatest(r, F.lit(1)).cast("long")).cast("int"))
    others = F.when(F.col("most"), F.sequence(F.lit(0), r - 1)).otherwise(F.sequence(F.lit(0), r + m - 1))
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(others)).select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *columns)
    return _gathered(dealt, columns)


def _across(mixed: DataFrame, kind: str, least: float, rows: int) -> DataFrame:
    """(bucket, k): members of a bucket with a likely partner of another component; mixed: (bucket, n_most, n_rest, most, k, c, n, regs).

    A pair counts in the first band that it shares, so in one bucket only.
    """
    groups = _dealt_apart(mixed, ["k", "c", "n", "regs"])

    def fn(batch: pa.RecordBatch) -> dict | None:
        ids = batch.schema.field("g").type.value_type.field("k").type
        waiting = 0
        held: list[tuple] = []  # pairs of several groups that wait for one estimate: registers, sizes, band, and where to note a hit

        def look():
            nonlocal waiting
            ra, rb, na, nb, band = (np.concatenate([x[i] for x in held]) for i in range(5))
            first = (ra == rb).reshape(len(ra), -1, rows).all(2).argmax(1) == band
            ok = first.copy()
            ok[first] = estimate(ra[first], rb[first], na[first], nb[first]) >= least
            at = 0
            for _, _, _, _, own, hit, p, q in held:
                good = ok[at : at + len(own)]
                hit[p[good]] = True
                hit[q[good]] = True
                at += len(own)
            held.clear()
            waiting = 0

        def keep(p, q):
            """Pairs p, q of the group at hand whose registers may reach the estimate; registers are equal a little more often than the sets' similarity."""
            nonlocal waiting
            near = _equal(r[q], r[p]) >= (least - 0.02) * r.shape[1]
            p, q = p[near], q[near]
            if len(p):
                held.append((r[p], r[q], n[p], n[q], np.full(len(p), band), hit, p, q))
                waiting += len(p)
            if waiting > 20_000:
                look()

        done = []
        for bucket, i, j, g in zip(batch.column("bucket").to_pylist(), batch.column("i").to_pylist(), batch.column("j").to_pylist(), batch.column("g"), strict=True):
            v = g.values
            r = np.frombuffer(b"".join(v.field("regs").to_pylist()), np.uint16).reshape(len(v), -1)
            own, n = v.field("own").to_numpy(), v.field("n").to_numpy().astype(float)
            c = v.field("c").dictionary_encode().indices.to_numpy()
            band, hit = bucket & 255, np.zeros(len(v), bool)
            done.append((bucket, v.field("k"), hit))
            may = lambda p, q: (c[q] != c[p]) & (np.minimum(n[q], n[p]) >= least * np.maximum(n[q], n[p])) & ((i == j) | (own[q] != own[p]))  # noqa: E731, B023
            if len(v) <= 64:
                p, q = np.triu_indices(len(v), 1)
                ok = may(p, q)
                if ok.any():
                    keep(p[ok], q[ok])
                continue
            for p in range(len(v) - 1):
                q = np.arange(p + 1, len(v))
                q = q[may(p, q)]
                if hit[p]:
                    q = q[~hit[q]]  # both are known to have a partner
                if len(q):
                    keep(np.full(len(q), p), q)
        if held:
            look()
        done = [(bucket, k, at) for bucket, k, hit in done if len(at := np.flatnonzero(hit))]
        if not done:
            return None
        return {"bucket": pa.array(np.repeat([x[0] for x in done], [len(x[2]) for x in done]), pa.int64()), "k": pa.concat_arrays([k.take(pa.array(at)) for _, k, at in done]).cast(ids)}

    return arrow_map(groups, fn, f"bucket long, k {kind}", 1024).distinct()


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """(n, n) sizes of the intersections of sorted distinct arrays; the diagonal counts shared elements only."""
    n = len(sets)
    doc = np.repeat(np.arange(n), [len(x) for x in sets])
    _, at, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(at, kind="stable")
    doc, first = doc[order], np.concatenate(([0], np.cumsum(df)[:-1]))
    out = np.zeros((n, n), np.int64)
    for d in range(2, DENSE):
        some = first[df == d]
        if len(some):
            m = doc[some[:, None] + np.arange(d)]
            a, b = np.triu_indices(d, 1)
            for x in range(0, len(m), 1 << 16):
                out += np.bincount((m[x : x + (1 << 16), a] * n + m[x : x + (1 << 16), b]).ravel(), minlength=n * n).reshape(n, n)
    out += out.T
    dense = np.flatnonzero(df >= DENSE)
    for x in range(0, len(dense), 2048):
        part = dense[x : x + 2048]
        has = np.zeros((n, len(part)), np.float32)
        for k, t in enumerate(part):
            has[doc[first[t] : first[t] + df[t]], k] = 1
        out += (has @ has.T).astype(np.int64)  # exact: counts are under 2 ** 24
    return out


def _forest_of(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> list[int]:
    """Which links (a, b) join components c that no link before has joined."""
    root = {x: x for x in set(c.tolist())}

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = []
    for i, (p, q) in enumerate(zip(c[a].tolist(), c[b].tolist(), strict=True)):
        p, q = top(p), top(q)
        if p != q:
            root[p] = q
            keep.append(i)
    return keep


def _met(members: DataFrame, kind: str, threshold: int) -> DataFrame:
    """Links (a, b) of a spanning forest over all links of each bucket; members: (bucket, k, c, n, s)."""
    sizes, seen = observed(members.groupBy("bucket").agg(F.count("*").alias("cnt"), F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "sizes", total=F.sum("cnt"))
    groups = _dealt(spread_join(members, sizes, ["bucket"], "cnt", F.xxhash64("k"), seen["total"] or 0), F.col("blocks"), ["k", "c", "s"])

    def fn(batch: pa.RecordBatch) -> dict:
        left, right = [], []
        for g in batch.column("g"):
            v = g.values
            sets = [np.frombuffer(x, np.uint64) for x in v.field("s").to_pylist()]
            if len(sets) < 2:
                continue
            c = v.field("c").dictionary_encode().indices.to_numpy()
            n = np.array([len(x) for x in sets])
            both = intersections(sets)
            a, b = np.nonzero(np.triu((100 * both >= threshold * (n[:, None] + n[None] - both)) & (c[:, None] != c[None]), 1))
            keep = pa.array(_forest_of(a, b, c), pa.int64())
            left.append(v.field("k").take(pa.array(a).take(keep)))
            right.append(v.field("k").take(pa.array(b).take(keep)))
        if not left:
            return None
        return {"a": pa.concat_arrays(left), "b": pa.concat_arrays(right)}

    return arrow_map(groups.select("g"), fn, f"a {kind}, b {kind}", 8)


def near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_shingles, component_id (smallest id reachable over links), kept (id = component_id).

    A document's set: hashes (64 bits) of its distinct width-word shingles, words lower-cased (A-Z) and split at
    [\\x20\\x09-\\x0D]; fewer words count as one shingle. Links: 100 * intersection >= threshold * union on full sets.
    Null, empty or blank texts have no shingles and link with nothing. Rows sharing an id give one row each; rows
    of equal text or equal sets are one class. A null id is its own document, never linked.
    Empty tables give an empty result. Two documents at similarity 0.8 share none of 32 bands of 4 registers with
    a chance of under 1e-7.
    """
    if bands > MAX_BANDS:
        raise ValueError(f"at most {MAX_BANDS} bands")
    least = threshold / 100 - MARGIN
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("k"), text_bytes(text_col).alias("t"))
    sk = materialize(_sketches(base, kind, width, bands * rows), "sketches")
    some = sk.where("n > 0 AND k IS NOT NULL")
    classes, copies = observed(some.groupBy("d1", "d2", "n").agg(F.min("k").alias("rep"), F.count("*").alias("cnt")), "classes", total=F.sum("cnt"))
    # repeated ids keep one sketch here: any of them when texts differ would do for its class only
    member = spread_join(some.select("k", "d1", "d2", "n"), classes, ["d1", "d2", "n"], "cnt", F.xxhash64("k"), copies["total"] or 0).select("k", "n", "rep", "d1", "d2")
    member = materialize(member, "members")
    reps = materialize(some.join(classes.select(F.col("rep").alias("k"), "d1", "d2", "n"), ["k", "d1", "d2", "n"]).dropDuplicates(["k", "d1", "d2", "n"]).select("k", "n", "regs"), "reps")

    band, n = observed(_bands(reps, kind, bands, rows), "bands", total=F.count(F.lit(1)))
    bucket, seen = observed(band.groupBy("bucket").agg(F.min("k").alias("a"), F.count("*").alias("cnt")).where("cnt > 1"), "buckets", total=F.sum("cnt"))
    shared = materialize(spread_join(band, bucket, ["bucket"], "cnt", F.xxhash64("k"), n["total"] or 0).select("bucket", "a", F.col("k").alias("b"), "cnt"), "shared")
    discard(band, bucket)
    star = shared.where("a <> b").select("a", "b").distinct()
    likely = materialize(_estimated(star, reps, kind, least), "likely")

    wanted = shared.select("b").distinct().withColumnRenamed("b", "k")
    texts = docs.select(F.col(id_col).alias("k"), text_bytes(text_col).alias("t")).join(by_shuffle(wanted), "k", "left_semi")

    def sets_of(batch: pa.RecordBatch) -> dict:
        out = []
        for _, _, data, off in binary_slices(batch.column("t")):
            s, first = shingle_sets(data, off, width)
            out.extend(s[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True))
        return {"k": batch.column("k"), "s": pa.array(out, pa.binary())}

    sets = materialize(arrow_map(texts, sets_of, f"k {kind}, s binary"), "sets")
    links = materialize(_verified(likely, sets, kind, threshold), "links")
    comp = materialize(connected_components(links), "comp")

    named = shared.select("bucket", "cnt", F.col("b").alias("k")).join(comp.select(F.col("node").alias("k"), "component"), "k", "left").withColumn("c", F.coalesce("component", "k")).drop("component")
    # of the buckets that hold several components: the largest one, of equal ones that of the largest id
    parts = named.groupBy("bucket", "c").agg(F.count("*").alias("own"))
    several = parts.groupBy("bucket").agg(F.max(F.struct("own", "c")).alias("top"), F.sum("own").alias("cnt"), F.count("*").alias("kinds")).where("kinds > 1")
    several = materialize(several.select("bucket", "cnt", F.col("top.c").alias("top"), F.col("top.own").alias("n_most"), (F.col("cnt") - F.col("top.own")).alias("n_rest")), "several")
    mixed = spread_join(named.drop("cnt"), several, ["bucket"], "cnt", F.xxhash64("k"), seen["total"] or 0)
    mixed = mixed.withColumn("most", F.col("c") == F.col("top")).join(reps, "k").select("bucket", "n_most", "n_rest", "most", "k", "c", "n", "regs")
    likely2 = materialize(_across(mixed, kind, least, rows), "likely")
    member2 = likely2.join(reps.select("k", "n"), "k").join(comp.select(F.col("node").alias("k"), "component"), "k", "left").join(sets, "k")
    member2 = materialize(member2.select("bucket", "k", F.coalesce("component", "k").alias("c"), "n", "s"), "met")
    more = materialize(_met(member2, kind, threshold), "more")
    if more.take(1):
        comp = materialize(connected_components(links.unionByName(more)), "comp2")
    discard(likely, likely2, shared, several, member2, sets)

    named = member.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").select("k", "n", F.coalesce("component", "rep").alias("c"))
    rest = sk.where("NOT (n > 0 AND k IS NOT NULL)").select("k", "n", F.col("k").alias("c"))
    out = named.unionByName(rest)
    return out.select(F.col("k").alias(id_col), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.col("k").eqNullSafe(F.col("c")).alias("kept"))


def keep_one_each(docs: DataFrame, width: int = 5, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each near-duplicate group: the one of the smallest id. Other rows and columns stay.

    An id stays with all its rows if one of them is its group's; null ids stay.
    """
    found = near_duplicates(docs, width, threshold, id_col=id_col, text_col=text_col)
    name = fresh_name(docs, "_gone_")
    gone = found.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(name)).agg(F.max("kept").alias("stays")).where("NOT stays").select(name)
    return docs.join(by_shuffle(gone), docs[id_col] == F.col(name), "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(generate_series(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS s FROM d),
sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * i >= 80 * (na + nb - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a WHERE r.root < e.b),
c AS (SELECT node, min(root) AS root FROM r GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.root AS component_id, s.doc_id = c.root AS kept FROM s JOIN c ON c.node = s.doc_id
"""
