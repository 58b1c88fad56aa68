"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals give document scores and spans.

Tags are O and T. Labels exist for documents only, so tokens are labelled first: over the training documents each
spelling feature of a word (the word, its first 3 to 8 letters, its last 3 to 6) is counted by documents; where
the likelihood ratio test and the precision say it marks toxic documents, tokens of toxic documents that carry it
are T, all others O. The chain is fitted to these labelled tokens by maximum likelihood with an L2 penalty, in
numpy. A chain is a window of 64 tokens; texts are windowed whole. The score is a logistic function of the
largest marginal and of the expected number of T, fitted on training documents that the chain hasn't seen.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm.common import arrow_map, fold_of, map_batches, text_bytes

#: The bounded sample that the model is fitted on: documents of each class, and bytes of all of them.
MAX_TOXIC = 2000
MAX_CLEAN = 6000
MAX_SAMPLE_BYTES = 16 << 20
WINDOW = 64
#: One in so many windows without a used feature is fitted on, with that weight.
THIN = 8
MIN_G2 = 18.0
MIN_PRECISION = 0.9
PREDICT_AT = 0.7
SPAN_AT = 0.5

_KEEP = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 0x80 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_CACHE_WORDS = 200_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


def features(word: bytes) -> list[str]:
    """Spelling features of a lower-cased word."""
    w = word.decode("utf-8", "replace")
    n = len(w)
    return ["=" + w, *("^" + w[:k] for k in range(3, min(n, 9))), *("$" + w[-k:] for k in range(3, min(n, 7)))]


def _cues(docs: list[tuple[set[bytes], int]]) -> tuple[dict[str, int], set[str]]:
    """Feature ids that the chain uses (those that lean to toxic documents) and the features that make a token T."""
    n1 = sum(y for _, y in docs)
    share = n1 / len(docs)
    memo: dict[bytes, list[str]] = {}
    t, c = Counter(), Counter()
    for words, y in docs:
        if y:
            own = set()
            for w in words:
                own.update(memo.get(w) or memo.setdefault(w, features(w)))
            t.update(own)
    wanted = {f for f, a in t.items() if a >= 3}
    few: dict[bytes, list[str]] = {}
    for words, y in docs:
        if not y:
            own = set()
            for w in words:
                got = few.get(w)
                if got is None:
                    few[w] = got = [f for f in features(w) if f in wanted]
                own.update(got)
            c.update(own)
    used, strong = [], set()
    for f in wanted:
        a, b = t[f], c[f]
        if a / (a + b) <= share:
            continue
        g = 2 * (a * math.log(a / ((a + b) * share)) + (b * math.log(b / ((a + b) * (1 - share))) if b else 0))
        if g >= MIN_G2 / 2:
            used.append(f)
        if g >= MIN_G2 and a / (a + b) >= MIN_PRECISION:
            strong.add(f)
    return {f: i for i, f in enumerate(sorted(used))}, strong


def _expand(e: np.ndarray, pad: np.ndarray) -> np.ndarray:
    e = e.copy()
    e[pad] = 0
    return e


def marginals(e: np.ndarray, size: np.ndarray, trans: np.ndarray, start: float, with_pairs: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over rows of e (rows, length): log odds of T against O by token, size: tokens of a row.

    trans: 2x2 log potentials, start: log odds of T at the first token. Returns P(T) by token, pair marginals
    summed over the row's steps as (rows, 2, 2) (0 unless asked for), and the rows' log partition functions.
    """
    rows, length = e.shape
    m = np.exp(trans)
    em = np.exp(np.clip(e.T, -40, 40))
    live = np.arange(length)[:, None] < size
    # a message over two tags is the odds of T alone
    ahead = np.empty((length, rows))
    z = np.zeros(rows)
    o = np.full(rows, math.exp(start))
    for t in range(length):
        if t:
            low = m[0, 0] + m[1, 0] * o
            o = (m[0, 1] + m[1, 1] * o) / low
            if with_pairs:
                z += np.where(live[t], np.log(low), 0)
        o = o * em[t]
        ahead[t] = o
    if with_pairs:
        z += np.log1p(ahead[size - 1, np.arange(rows)])
    p = np.empty((length, rows))
    pairs = np.zeros((4, rows))
    back = np.ones(rows)
    for t in range(length - 1, -1, -1):
        odds = ahead[t] * back
        p[t] = odds / (1 + odds)
        if t:
            v = em[t] * back
            if with_pairs:
                u = ahead[t - 1]
                joint = np.stack((np.full(rows, m[0, 0]), m[0, 1] * v, m[1, 0] * u, m[1, 1] * u * v))
                joint *= live[t] / joint.sum(0)
                pairs += joint
            back = np.where(live[t], (m[1, 0] + m[1, 1] * v) / (m[0, 0] + m[0, 1] * v), 1.0)
    p *= live
    return p.T, pairs.T.reshape(rows, 2, 2), z


class ChainModel:
    """Weights of the fitted chain, and the logistic function of its marginals."""

    def __init__(self, weights: dict[str, float], bias: float, trans: np.ndarray, start: float, head: tuple[float, float, float]):
        self.weights, self.bias, self.trans, self.start, self.head = weights, bias, trans, start, head
        self._memo: dict[bytes, float] = {}
        # of windows without any feature, by their number of tokens: the largest marginal and the sum
        p, _, _ = marginals(np.full((WINDOW + 1, WINDOW), bias), np.maximum(np.arange(WINDOW + 1), 1), trans, start, False)
        self.bare_top, self.bare_sum = p.max(1), p.sum(1)

    def __reduce__(self):
        return ChainModel, (self.weights, self.bias, self.trans, self.start, self.head)

    def emission(self, word: bytes) -> float:
        got = self.weights.get
        x = self.bias + sum(map(got, features(word), repeat(0.0)))
        if len(self._memo) >= _CACHE_WORDS:
            self._memo.clear()
        self._memo[word] = x
        return x

    def tag(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """Per text: the largest marginal, the expected number of T, and the tokens over SPAN_AT."""
        memo, emission = self._memo, self.emission
        rows: list[list[float]] = []
        for t in texts:
            ws = words_of(t)
            x = list(map(memo.get, ws))
            if None in x:
                x = [v if v is not None else memo.get(w) or emission(w) for v, w in zip(x, ws, strict=True)]
            rows.append(x)
        count = np.array([len(r) for r in rows], np.int64)
        windows = -(-count // WINDOW)
        first = np.concatenate(([0], np.cumsum(windows)))
        e = np.full(first[-1] * WINDOW, self.bias)
        size = np.full(first[-1], WINDOW, np.int64)
        for r, at, n in zip(rows, first, windows, strict=False):
            if r:
                e[at * WINDOW : at * WINDOW + len(r)] = r
                size[at + n - 1] = len(r) - (n - 1) * WINDOW
        e = e.reshape(-1, WINDOW)
        # windows without any feature differ in length only; all others go through the chain
        busy = (e != self.bias).any(1)
        owner = np.repeat(np.arange(len(rows)), windows)
        top, total = np.zeros(len(rows)), np.zeros(len(rows))
        bare = ~busy
        np.maximum.at(top, owner[bare], self.bare_top[size[bare]])
        np.add.at(total, owner[bare], self.bare_sum[size[bare]])
        spans: list[list[int]] = [[] for _ in rows]
        # a run of windows at a time: a very long text is many
        for busy in np.array_split(at := np.flatnonzero(busy), -(-len(at) // 8192) or 1):
            if not len(busy):
                continue
            p, _, _ = marginals(e[busy], size[busy], self.trans, self.start, False)
            owner = np.searchsorted(first, busy, side="right") - 1
            np.maximum.at(top, owner, p.max(1))
            np.add.at(total, owner, p.sum(1))
            for r, t in zip(*np.nonzero(p > SPAN_AT), strict=True):
                d = int(owner[r])
                spans[d].append(int((busy[r] - first[d]) * WINDOW + t))
        return top, total, spans

    def score(self, top: np.ndarray, total: np.ndarray) -> np.ndarray:
        a, b, c = self.head
        z = a * _logit(top) + b * np.log1p(total) + c
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit_chain(docs: list[tuple[bytes, int]], prior: float, steps: int = 60, l2: float = 0.02) -> ChainModel:
    """Fit the chain and its head to (text, label) documents; prior: the share of toxic documents among all labelled ones."""
    zero = ChainModel({}, -8.0, np.zeros((2, 2)), 0.0, (0.0, 0.0, math.log(max(prior, 1e-4) / max(1 - prior, 1e-4))))
    if not docs or len({y for _, y in docs}) < 2:
        return zero
    rows = [words_of(t) for t, _ in docs]
    ys = np.array([y for _, y in docs])
    learn = np.arange(len(docs)) % 3 != 2
    index, strong = _cues([(set(rows[i]), int(ys[i])) for i in np.flatnonzero(learn)])
    if not strong:
        return zero
    memo: dict[bytes, tuple[list[int], bool]] = {}

    def look(w: bytes):
        f = features(w)
        memo[w] = got = ([index[x] for x in f if x in index], any(x in strong for x in f))
        return got

    feats, toks, tags, size, weight, at = [], [], [], [], [], 0
    for i in np.flatnonzero(learn):
        r = rows[i]
        for a in range(0, len(r), WINDOW):
            part = r[a : a + WINDOW]
            found = [memo.get(w) or look(w) for w in part]
            bare = not any(x[0] for x in found)
            if bare and (a // WINDOW + int(i)) % THIN:
                continue  # windows without a used feature differ in length only: one in THIN stands for all
            for k, (ids, s) in enumerate(found):
                feats.extend(ids)
                toks.extend([at * WINDOW + k] * len(ids))
                if s and ys[i]:
                    tags.append(at * WINDOW + k)
            size.append(len(part))
            weight.append(THIN if bare else 1)
            at += 1
    feats, toks, size, weight = np.array(feats, np.int64), np.array(toks, np.int64), np.array(size), np.array(weight, float)
    y = np.zeros(at * WINDOW)
    y[tags] = 1
    y = y.reshape(at, WINDOW)
    live = np.arange(WINDOW)[None] < size[:, None]
    # observed counts
    pair = np.zeros((2, 2))
    for i in range(2):
        for j in range(2):
            pair[i, j] = (((y[:, :-1] == i) & (y[:, 1:] == j) & live[:, 1:]).sum(1) * weight).sum()
    obs = np.concatenate((np.bincount(feats, y.ravel()[toks], len(index)), [y.sum(), y[:, 0].sum()], pair.ravel()))
    theta = np.zeros(len(index) + 6)
    theta[len(index)] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n = max(1, (live.sum(1) * weight).sum())
    for step in range(1, steps + 1):
        w, bias, start, trans = theta[: len(index)], theta[len(index)], theta[len(index) + 1], theta[len(index) + 2 :].reshape(2, 2)
        e = (np.bincount(toks, w[feats], at * WINDOW) + bias).reshape(at, WINDOW)
        p, pairs, _ = marginals(e, size, trans, start)
        exp = np.concatenate((np.bincount(feats, p.ravel()[toks], len(index)), [p.sum(1) @ weight, p[:, 0] @ weight], np.tensordot(weight, pairs, 1).ravel()))
        # feature counts differ by orders: each gradient is scaled by Adam
        g = (exp - obs) / n + l2 / n * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-12)
    model = ChainModel({f: float(theta[i]) for f, i in index.items() if abs(theta[i]) > 1e-3}, float(theta[len(index)]), theta[len(index) + 2 :].reshape(2, 2).copy(), float(theta[len(index) + 1]), (1.0, 0.0, 0.0))
    held = np.flatnonzero(~learn) if len({*ys[~learn]}) == 2 else np.arange(len(docs))
    top, total, _ = model.tag([docs[i][0] for i in held])
    model.head = _head(np.stack((_logit(top), np.log1p(total), np.ones(len(held))), 1), ys[held], prior)
    return model


def _head(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float, float]:
    """Weighted logistic regression by Newton steps: classes weigh as among all labelled documents."""
    w = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    b = np.zeros(3)
    ridge = np.diag([0.02, 0.02, 0.005])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (w * (p - y)) + ridge @ b
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge
        b = b - np.clip(np.linalg.solve(h, g), -3, 3)
    return float(max(b[0], 0)), float(max(b[1], 0)), float(b[2])


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ChainModel:
    """Fit on a bounded sample of the labelled rows of docs: at most MAX_TOXIC and MAX_CLEAN by a hash of the id.

    Where their texts, whole and of any length, hold more than MAX_SAMPLE_BYTES, the hash picks that share of them.
    train: a condition on the id column `k`. Null ids, labels and texts don't count.
    """
    known = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).where("k IS NOT NULL AND y IN (0, 1)")
    if train is not None:
        known = known.where(train)
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return fit_chain([], n.get(1, 0) / max(1, sum(n.values())))
    # a hash of the id picks nine tenths of the bound; a plain top-k would send as many rows of every partition to one task
    order = F.xxhash64("k")
    share = lambda y, most: F.pmod(order, F.lit(1 << 30)) < int(min(1.0, 0.9 * most / n[y]) * (1 << 30))
    picked = known.where((F.col("y") == 1) & share(1, MAX_TOXIC)).limit(MAX_TOXIC).unionByName(known.where((F.col("y") == 0) & share(0, MAX_CLEAN)).limit(MAX_CLEAN))
    rows = docs.select(F.col(id_col).alias("k"), text_bytes(text_col).alias("t")).where(F.length("t") > 0).join(F.broadcast(picked), "k")  # MAX_TOXIC + MAX_CLEAN rows at most
    size = rows.agg(F.sum(F.length("t").cast("long"))).first()[0] or 0
    if size > MAX_SAMPLE_BYTES:
        rows = rows.where(F.pmod(F.xxhash64(order, F.lit("bytes")), F.lit(1 << 30)) < int(MAX_SAMPLE_BYTES / size * (1 << 30)))
    sample = sorted(((r.k, r.y, bytes(r.t)) for r in rows.toLocalIterator()), key=lambda x: (hash_order(x[0]), x[2]))
    return fit_chain([(t, y) for _, y, t in sample], n[1] / (n[0] + n[1]))


def hash_order(k) -> int:
    import zlib

    return zlib.crc32(f"order {k}".encode())


def score(docs: DataFrame, model: ChainModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, score, predicted, n_toxic (tokens), spans (start and end of toxic tokens, in code points).

    Texts are scored whole. A null or empty text has no token: its score is the model's lowest. Repeated rows and
    null ids each get their row; equal texts have equal scores. Without labels of both classes the score is the prior.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def fn(batch: pa.RecordBatch) -> dict:
        texts = batch.column("t").to_pylist()
        m = shared.value
        top, total, hits = m.tag(texts)
        s = m.score(top, total)
        spans = []
        for text, own in zip(texts, hits, strict=True):
            if own:
                at = [x.span() for x in _WORD.finditer(text)]
                out, byte, point = [], 0, 0
                for k in sorted(own):
                    a, b = at[k]
                    point += len(text[byte:a].decode("utf-8", "replace"))
                    n = len(text[a:b].decode("utf-8", "replace"))
                    out.append({"start": point, "end": point + n})
                    byte, point = b, point + n
                spans.append(out)
            else:
                spans.append([])
        return {"k": batch.column("k"), "score": pa.array(s, pa.float64()), "predicted": pa.array((s >= PREDICT_AT).astype(np.int32)), "n_toxic": pa.array([len(x) for x in spans], pa.int64()), "spans": pa.array(spans, pa.list_(span))}

    base = docs.select(F.col(id_col).alias("k"), text_bytes(text_col).alias("t"))
    return arrow_map(base, fn, f"k {kind}, score double, predicted int, n_toxic long, spans array<struct<start:long,end:long>>", 512).withColumnRenamed("k", id_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows predicted toxic; one pass, no shuffle. The model is fitted on labelled rows outside fold 1 of 3."""
    model = fit(docs, labels, fold_of("k", 3) != 1, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                texts = b.column(b.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()
                top, total, _ = shared.value.tag([x or b"" for x in texts])
                yield b.filter(pa.array(shared.value.score(top, total) < PREDICT_AT))

    return map_batches(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, fold_of("k", 3) != 1)
    out = score(docs, model)
    text = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "n_toxic", text.alias("spans"))
