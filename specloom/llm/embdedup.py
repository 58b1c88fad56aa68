"""Embedding near-dedup by NN-descent, with enlarged lists where they saturate and an audited recall.

Equal unit vectors are one class; its smallest id stands for it. A neighbour graph starts from forests of random
hyperplanes (as many as make a pair at the threshold share a bucket with a chance of 1 - MISS), whose buckets are
cut into blocks of bounded size. It is refined by neighbours-of-neighbours joins: the vectors that list a hub, or
that it lists, meet in blocks, and each takes the best of them into its own list. Lists hold K neighbours of
cosine CLOSE or more, as rows, so a popular vector is never gathered in one place.

A list that is full of links may lack some: it is saturated. Lists of components with a saturated vector are enlarged
to all members of such components, as a link that no list holds has two saturated ends: the members meet block by
block, but for blocks that lie too far apart for a link. Only their numbers of links and the components that links
join come out, never the pairs. Recall is audited, by link and by vector: a bounded sample of vectors is compared with
all vectors, and further forests are grown while it is below RECALL. A result under LEAST_RECALL is an error.

A bucket, hub or component of very many members meets its counts in as many tasks (spread_join) and is cut into blocks
before its vectors come to it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specloom.llm.common import arrow_map, discard, has_repeated_ids, materialize, observed, partitions, spread_join
from specloom.llm.graph import connected_components

THRESHOLD = 0.95
CLOSE = 0.75
K = 16
BUCKET = 256
BLOCK = 512
WIDE_BLOCK = 2048
CENTRES = 4096
MISS = 0.002
ROUNDS = 4
AUDIT = 256
RECALL = 0.98
LEAST_RECALL = 0.9


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float64).reshape(len(col), -1)


def unit_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(k, v): unit vectors as bytes of doubles; null where the vector is null, empty, zero, or has a null or non-finite component."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def fn(batch: pa.RecordBatch) -> dict:
        out = []
        for x in batch.column("e").to_pylist():
            v = None
            if x and None not in x:
                a = np.array(x, np.float64)
                top = np.abs(a).max()
                if np.isfinite(a).all() and top > 0:
                    a = a / top
                    v = (a / np.sqrt((a * a).sum())).tobytes()
            out.append(v)
        return {"k": batch.column("k"), "v": pa.array(out, pa.binary())}

    return arrow_map(vectors.select(F.col(id_col).alias("k"), F.col(vec_col).cast("array<double>").alias("e")), fn, f"k {kind}, v binary", 4096)


def _bits(n: int) -> int:
    return max(0, math.ceil(math.log2(max(n, 1) / BUCKET)))


def _trees(n: int, threshold: float) -> int:
    """Forests until a pair at the threshold has shared no bucket with a chance of MISS."""
    stay = (1 - math.acos(threshold) / math.pi) ** _bits(n)
    return 1 if stay >= 1 else math.ceil(math.log(MISS) / math.log(1 - stay))


def _best(groups: DataFrame, kind: str, k: int, close: float) -> DataFrame:
    """(id, nbr, sim): in each group g of (k, v), every vector's k nearest of cosine close or more."""

    def fn(batch: pa.RecordBatch) -> dict:
        ids, nbrs, sims = [], [], []
        for g in batch.column("g"):
            own, v = g.values.field("k"), g.values.field("v")
            raw = v.to_pylist()
            by_size: dict[int, list[int]] = {}
            for i, x in enumerate(raw):
                by_size.setdefault(len(x), []).append(i)
            for at in by_size.values():  # vectors of other lengths have no cosine
                if len(at) < 2:
                    continue
                x = np.frombuffer(b"".join([raw[i] for i in at]), np.float64).reshape(len(at), -1)
                s = x @ x.T
                np.fill_diagonal(s, -2)
                if len(at) > k:
                    part = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    sim = np.take_along_axis(s, part, 1)
                else:
                    part = np.broadcast_to(np.arange(len(at)), s.shape)
                    sim = s
                r, c = np.nonzero(sim >= close)
                if len(r):
                    at = np.array(at)
                    ids.append(own.take(pa.array(at[r])))
                    nbrs.append(own.take(pa.array(at[part[r, c]])))
                    sims.append(sim[r, c])
        if not ids:
            return None
        return {"id": pa.concat_arrays(ids), "nbr": pa.concat_arrays(nbrs), "sim": pa.array(np.minimum(np.concatenate(sims), 1.0))}

    return arrow_map(groups.select("g"), fn, f"id {kind}, nbr {kind}, sim double", 32)


def _top(rows: DataFrame, k: int) -> DataFrame:
    """Each id's k best rows; Spark cuts the lists before the shuffle too."""
    best = rows.where("id <> nbr").groupBy("id", "nbr").agg(F.max("sim").alias("sim"))
    w = Window.partitionBy("id").orderBy(F.desc("sim"), "nbr")
    return best.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def _in_blocks(rows: DataFrame, reps: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Members k of the groups of keys with their vectors of reps, in arrays g of about limit: larger groups are cut by a hash of the id."""
    sizes, seen = observed(rows.groupBy(*keys).agg(F.count("*").alias("cnt")).where("cnt > 1"), "sizes", total=F.sum("cnt"))
    met = spread_join(rows, sizes, keys, "cnt", F.xxhash64("k"), seen["total"] or 0)
    cut = met.select(*keys, "k", F.pmod(F.xxhash64("k", *keys), F.ceil(F.col("cnt") / limit).cast("long")).cast("int").alias("blk"))
    return cut.join(reps, "k").repartition(partitions(rows.sparkSession), *keys, "blk").groupBy(*keys, "blk").agg(F.collect_list(F.struct("k", "v")).alias("g"))


def _forest(reps: DataFrame, kind: str, n: int, first: int, trees: int) -> DataFrame:
    """(tree, code, k): buckets by the signs of random projections."""
    bits = _bits(n)

    def fn(batch: pa.RecordBatch) -> dict:
        raw = batch.column("v").to_pylist()
        dims = np.array([len(x) // 8 for x in raw])
        code = np.zeros((len(raw), trees), np.int64)
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            x = np.frombuffer(b"".join([raw[i] for i in at]), np.float64).reshape(len(at), d)
            for t in range(trees):
                c = np.full(len(at), d, np.int64)
                if bits:
                    planes = np.random.default_rng([first + t, int(d)]).normal(size=(int(d), bits))
                    c = c * (1 << bits) + ((x @ planes > 0) @ (1 << np.arange(bits)))
                code[at, t] = c
        rows = pa.array(np.repeat(np.arange(len(raw)), trees))
        return {"tree": pa.array(np.tile(np.arange(first, first + trees, dtype=np.int32), len(raw))), "code": pa.array(code.ravel()), "k": batch.column("k").take(rows)}

    return arrow_map(reps, fn, f"tree int, code long, k {kind}", 2048)


def _descend(lists: DataFrame, reps: DataFrame, kind: str, k: int, close: float) -> DataFrame:
    """One round of NN-descent: members of a hub's neighbourhood meet."""
    pairs = lists.select(F.col("id").alias("hub"), F.col("nbr").alias("k")).unionByName(lists.select(F.col("nbr").alias("hub"), F.col("id").alias("k")))
    pairs = pairs.unionByName(lists.select(F.col("id").alias("hub"), F.col("id").alias("k"))).distinct()
    return _top(lists.unionByName(_best(_in_blocks(pairs, reps, ["hub"], BLOCK), kind, k, close)), k)


def _near_blocks(blocks: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(ci, i, cj, j): pairs of blocks (component, blk, g), each once, that may hold a link: their centres are no further
    apart than both radii and the threshold's angle, so no other pair of blocks has one."""

    def centre(batch: pa.RecordBatch) -> dict:
        mid, wide = [], []
        for g in batch.column("g"):
            x = _matrix(g.values.field("v"))
            c = x.mean(0)
            size = np.sqrt((c * c).sum())
            c = c / size if size > 1e-9 else x[0]
            mid.append(c.tobytes())
            wide.append(float(np.arccos(np.clip(x @ c, -1, 1)).max()))
        return {"component": batch.column("component"), "blk": batch.column("blk"), "mid": pa.array(mid, pa.binary()), "wide": pa.array(wide)}

    centres = materialize(arrow_map(blocks, centre, f"component {kind}, blk int, mid binary, wide double", 64), "centres")
    parts = math.ceil(centres.count() / CENTRES) or 1
    # a cell of centres goes to each pair of cells that it is part of: one centre stands for WIDE_BLOCK vectors
    cells = centres.groupBy(F.pmod(F.xxhash64("component", "blk"), F.lit(parts)).cast("int").alias("own")).agg(F.collect_list(F.struct("component", "blk", "mid", "wide")).alias("x"))
    dealt = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(F.least("own", "other").alias("p"), F.greatest("own", "other").alias("o"), "own", "x")
    met = dealt.repartition(partitions(blocks.sparkSession), "p", "o").groupBy("p", "o").agg(F.max(F.when(F.col("own") == F.col("p"), F.col("x"))).alias("x"), F.max(F.when(F.col("own") == F.col("o"), F.col("x"))).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    reach = math.acos(threshold) + 1e-6

    def fn(batch: pa.RecordBatch) -> dict | None:
        out = [[], [], [], []]
        for p, o, x, y in zip(batch.column("p").to_pylist(), batch.column("o").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
            u, w = x.values, y.values
            lu, lw = (np.array([len(v) for v in t.field("mid").to_pylist()]) for t in (u, w))
            for d in np.intersect1d(lu, lw):  # vectors of other lengths have no cosine
                at, to = np.flatnonzero(lu == d), np.flatnonzero(lw == d)
                a, b = _matrix(u.field("mid").take(pa.array(at))), _matrix(w.field("mid").take(pa.array(to)))
                ra, rb = u.field("wide").to_numpy()[at], w.field("wide").to_numpy()[to]
                for s in range(0, len(at), 1024):
                    near = np.arccos(np.clip(a[s : s + 1024] @ b.T, -1, 1)) <= ra[s : s + 1024, None] + rb + reach
                    r, c = np.nonzero(near)
                    r += s
                    if p == o:
                        r, c = r[r <= c], c[r <= c]
                    for k, (t, i) in enumerate(((u, at[r]), (u, at[r]), (w, to[c]), (w, to[c]))):
                        out[k].append(t.field(("component", "blk")[k % 2]).take(pa.array(i)))
        if not out[0]:
            return None
        return {n: pa.concat_arrays(x) for n, x in zip(("ci", "i", "cj", "j"), out, strict=True)}

    return arrow_map(met, fn, f"ci {kind}, i int, cj {kind}, j int", 1)


def _enlarged(members: DataFrame, kind: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(k, n): links of each member (component, k, v, m) with all members, each weighed by the class size m; and (a, b): components that links join."""
    sizes, seen = observed(members.groupBy("component").agg(F.count("*").alias("cnt")), "sizes", total=F.sum("cnt"))
    cut = spread_join(members, sizes, ["component"], "cnt", F.xxhash64("k"), seen["total"] or 0).withColumn("blk", F.pmod(F.xxhash64("k"), F.ceil(F.col("cnt") / WIDE_BLOCK).cast("long")).cast("int"))
    blocks = materialize(cut.groupBy("component", "blk").agg(F.collect_list(F.struct("k", "v", "m")).alias("g")), "blocks")
    left, right = blocks.toDF("ci", "i", "x"), blocks.toDF("cj", "j", "y")
    met = _near_blocks(blocks, kind, threshold).join(left, ["ci", "i"]).join(right, ["cj", "j"]).repartition(partitions(members.sparkSession), "ci", "i", "cj", "j")

    def fn(batch: pa.RecordBatch) -> dict:
        ids, counts, joins = [], [], []
        for row, (ci, i, cj, j, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("ci", "i", "cj", "j")), batch.column("x"), batch.column("y"), strict=True)):
            a, b = _matrix(x.values.field("v")), _matrix(y.values.field("v"))
            ma, mb = x.values.field("m").to_numpy(), y.values.field("m").to_numpy()
            linked = a @ b.T >= threshold
            if (ci, i) == (cj, j):
                np.fill_diagonal(linked, False)
            else:
                ids.append(y.values.field("k"))
                counts.append(ma @ linked)
                if ci != cj and linked.any():
                    joins.append(row)
            ids.append(x.values.field("k"))
            counts.append(linked @ mb)
        ids, joins = pa.concat_arrays(ids), pa.array(joins, pa.int64())
        own, none = pa.nulls(len(ids), ids.type), pa.nulls(len(joins), ids.type)
        n = np.concatenate([*counts, np.zeros(len(joins), np.int64)]).astype(np.int64)
        return {"k": pa.concat_arrays([ids, none]), "n": pa.array(n), "a": pa.concat_arrays([own, batch.column("ci").take(joins)]), "b": pa.concat_arrays([own, batch.column("cj").take(joins)])}

    out = materialize(arrow_map(met, fn, f"k {kind}, n long, a {kind}, b {kind}", 4).groupBy("k", "a", "b").agg(F.sum("n").alias("n")), "wide")
    return out.where("k IS NOT NULL").select("k", "n"), out.where("k IS NULL").select("a", "b")


def _joined(comp: DataFrame, joins: DataFrame) -> DataFrame:
    """comp (k, component) with the components united that joins (a, b) name."""
    new = connected_components(joins).select(F.col("node").alias("component"), F.col("component").alias("to"))
    return materialize(comp.join(new, "component", "left").select("k", F.coalesce("to", "component").alias("component")), "comp")


def audit(reps: DataFrame, found: DataFrame, threshold: float, n: int, sample: int = AUDIT) -> float:
    """Recall of found (k, n: links) on a bounded sample of the n reps (k, v, m), compared with all reps by brute force.

    The lower one of the share of all the sample's links and of the mean share of a vector's links, so that a large
    group doesn't hide what small ones lack.
    """
    # a hash of the id picks about half more than the sample: a top-k of all would send `sample` rows of every partition to the driver
    share = min(1.0, 1.5 * sample / max(n, 1))
    picked = reps.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("k"), "k").limit(sample).collect()
    if not picked:
        return 1.0
    spark = reps.sparkSession
    queries = spark.sparkContext.broadcast([(i, bytes(r.v)) for i, r in enumerate(picked)])

    def fn(batch: pa.RecordBatch) -> dict:
        raw, m = batch.column("v").to_pylist(), batch.column("m").to_numpy()
        total = np.zeros(len(queries.value), np.int64)
        sizes = np.array([len(x) for x in raw])
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            q = [(i, v) for i, v in queries.value if len(v) == d]
            if q:
                x = np.frombuffer(b"".join([raw[i] for i in at]), np.float64).reshape(len(at), -1)
                y = np.frombuffer(b"".join([v for _, v in q]), np.float64).reshape(len(q), -1)
                total[[i for i, _ in q]] += m[at] @ (x @ y.T >= threshold)
        return {"q": pa.array(np.arange(len(total))), "n": pa.array(total)}

    true = {r.q: r.n for r in arrow_map(reps, fn, "q long, n long", 4096).groupBy("q").agg(F.sum("n").alias("n")).collect()}
    ids = spark.createDataFrame([(i, r.k) for i, r in enumerate(picked)], f"q long, k {reps.schema['k'].dataType.simpleString()}")
    got = {r.q: r.n for r in found.join(F.broadcast(ids), "k").select("q", "n").collect()}  # sample rows at most
    want = {i: w for i, r in enumerate(picked) if (w := true.get(i, 0) - r.m) > 0}
    if not want:
        return 1.0
    have = {i: min(got.get(i, 0), w) for i, w in want.items()}
    return min(sum(have.values()) / sum(want.values()), sum(have[i] / w for i, w in want.items()) / len(want))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", rounds: int = ROUNDS) -> DataFrame:
    """Per vector: id, n_links, component_id (smallest id reachable), kept (id = component_id).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    other lengths or null ids. Rows that share an id are one vector (of equal ids, the valid one of the largest
    bytes). Copies are counted, not paired. An empty table gives no rows. Where the audit finds a recall under
    LEAST_RECALL after the last forest, a RuntimeError names it instead of a result that lacks links.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    base = unit_vectors(vectors, id_col, vec_col)
    if has_repeated_ids(vectors, id_col):
        base = base.groupBy("k").agg(F.max("v").alias("v"))
    base = materialize(base.withColumn("h", F.unhex(F.md5("v"))), "units")
    good = base.where("v IS NOT NULL AND k IS NOT NULL")
    classes = good.groupBy("h").agg(F.min("k").alias("rep"), F.count("*").alias("m"))
    member = materialize(good.select("k", "h").join(classes, "h").select("k", "rep", "m"), "members")
    reps = materialize(good.join(classes.select("h", F.col("rep").alias("k"), "m"), ["h", "k"]).select("k", "v", "m"), "reps")
    n = reps.count()
    plain = reps.select("k", "v")
    close = min(CLOSE, threshold)

    lists, grown, trees = None, 0, _trees(n, threshold)
    for _ in range(rounds):
        new = _top(_best(_in_blocks(materialize(_forest(plain, kind, n, grown, trees), "forest"), plain, ["tree", "code"], BLOCK), kind, k, close), k)
        lists = materialize(new if lists is None else _top(lists.unionByName(new), k), "lists")
        grown += trees
        links_before = -1
        for _ in range(rounds):
            lists, old = materialize(_descend(lists, plain, kind, k, close), "lists"), lists
            discard(old)
            now = lists.where(F.col("sim") >= threshold).count()
            if now - links_before <= 0.001 * now:
                break
            links_before = now
        links = lists.where(F.col("sim") >= threshold).select(F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b")).distinct()
        comp = materialize(connected_components(links).select(F.col("node").alias("k"), "component"), "comp")
        full = lists.groupBy("id").agg(F.count("*").alias("c"), F.min("sim").alias("low")).where((F.col("c") >= k) & (F.col("low") >= threshold)).select(F.col("id").alias("k"))
        wide = comp.join(full, "k").select("component").distinct()
        counted, joins = _enlarged(comp.join(wide, "component").join(reps, "k").select("component", "k", "v", "m"), kind, threshold)
        both = links.select(F.col("a").alias("k"), F.col("b").alias("o")).unionByName(links.select(F.col("b").alias("k"), F.col("a").alias("o")))
        narrow = both.join(comp.join(wide, "component", "left_anti"), "k").join(reps.select(F.col("k").alias("o"), "m"), "o").groupBy("k").agg(F.sum("m").alias("n"))
        found = materialize(counted.unionByName(narrow), "found")
        comp = _joined(comp, joins)
        recall = audit(reps, found, threshold, n)
        if recall >= RECALL:
            break
    if recall < LEAST_RECALL:
        raise RuntimeError(f"{grown} trees find {recall:.3f} of the sample's links, under {LEAST_RECALL}")

    own = found.select(F.col("k").alias("rep"), "n").join(comp.select(F.col("k").alias("rep"), "component"), "rep")
    out = member.join(own, "rep", "left").select("k", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    rest = base.where("v IS NULL OR k IS NULL").select("k", F.lit(0).cast("long").alias("n"), F.col("k").alias("c"))
    return out.unionByName(rest).select(F.col("k").alias(id_col), F.col("n").alias("n_links"), F.col("c").alias("component_id"), F.col("k").eqNullSafe(F.col("c")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = r"""
WITH RECURSIVE u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(node, root) AS (SELECT vec_id, vec_id FROM u UNION SELECT l.b, r.root FROM r JOIN l ON r.node = l.a WHERE r.root < l.b),
c AS (SELECT node, min(root) AS root FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT u.vec_id, coalesce(n.n, 0) AS n_links, c.root AS component_id, u.vec_id = c.root AS kept FROM u JOIN c ON c.node = u.vec_id LEFT JOIN n ON n.a = u.vec_id
"""
