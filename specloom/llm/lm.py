"""LM scoring: a log-bilinear neural model, trained with noise-contrastive estimation in numpy, scores whole texts.

Words of all training texts are counted (one shuffle of partial counts). The LBL_WORDS most frequent words, the end
and REST classes of all other words (by their last two bytes) are the model's outputs; its context is the two tokens
before, each read by position-dependent weights. Outputs stand in groups of neighbouring frequency: a token has the
probability of its group times that within the group, both log-bilinear in the same context, so normalising takes two
short batched matrix products instead of one over all outputs. A word outside the model's own has its class's
probability times its share in that class, with one added to each count and one word unseen.

Training doesn't depend on how Spark has cut the table. A hash of text and id (so copies part) deals it to one of ROUNDS
rounds and of as many shards of about SHARD_TOKENS tokens as the corpus has. In a round each shard starts from the same parameters and
runs noise-contrastive estimation over its texts in the order of their hashes, on every position; the shards' parameters
are averaged, weighted by positions, in a Spark aggregate, and start the next round. Every token of every training text
is learnt from in one of the rounds, and nothing of the corpus reaches the driver but counts of the frequent words and
the averages.

Counts of frequent words (FREQUENT at most) travel as a broadcast; those of the others come by a join on the word. A
word of over WORD_BYTES bytes stands there by its digest, so a long address in every text is a frequent word like any
other, and what is left to the join is in few rows: one in FREQUENT of all tokens at most.

Words are cut, counted and looked up as Arrow arrays of a few MB of text at a time, not one by one.
"""

from __future__ import annotations

import functools
import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm.common import BATCH_BYTES, SPACES, binary_slices, discard, fold_of, map_batches, materialize, partitions, text_bytes

FREQUENT = 65_536
WORD_BYTES = 64
LBL_WORDS = 8192
REST = 32
DIM = 16
GROUP = 128
NOISE = 64
GROUP_NOISE = 16
ROUNDS = 3
SHARD_TOKENS = 1_000_000
#: Positions of a step: the first steps are short, so that little text gives many of them; each size lasts GROW steps.
BATCH_FIRST, BATCH_LAST, GROW = 256, 4096, 24
RATE = 0.08
#: Positions whose contexts are in memory at once when texts are scored.
BLOCK = 1 << 17
_LN10 = math.log(10)
_LOWER = bytes(range(256)).lower()


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased (A-Z) words [^\\x20\\x09-\\x0D]+ of texts one after another, and each text's first (one more entry than texts).

    data, off: the texts' bytes and where they start in them. A word of over WORD_BYTES bytes is a blank and its digest,
    which is no word. No word is a Python object, but for those.
    """
    n = len(data)
    solid = (data != 0x20) & (data - np.uint8(9) > 4)
    start, end = solid.copy(), solid.copy()
    np.greater(solid[1:], solid[:-1], out=start[1:])
    np.greater(solid[:-1], solid[1:], out=end[:-1])
    inner = off[(off > 0) & (off < n)]  # a word ends with its text
    start[inner], end[inner - 1] = solid[inner], solid[inner - 1]
    starts = np.flatnonzero(start)
    sizes = np.flatnonzero(end) + 1 - starts
    at = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(sizes, out=at[1:])
    raw = data.tobytes().translate(_LOWER, SPACES)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(raw)])
    long = sizes > WORD_BYTES
    if long.any():
        digests = [b" " + hashlib.sha256(raw[at[i] : at[i + 1]]).digest() for i in np.flatnonzero(long)]
        words = pc.replace_with_mask(words, pa.array(long), pa.array(digests, pa.binary()))
    return words, np.searchsorted(starts, off)


class LogBilinear:
    """s(w | w1, w2) = h . q[w] + b[w] with h = c1 * r[w1] + c2 * r[w2]; groups of outputs have the like with qg, bg.

    Ids: model words by frequency, then the end, the classes of other words, and (context only) the start.
    """

    def __init__(self, unigram: np.ndarray, dim: int = DIM, group: int = GROUP, seed: int = 7):
        g = np.random.default_rng(seed)
        self.n, self.group = len(unigram), group
        self.p = unigram / unigram.sum()
        self.groups = -(-self.n // group)
        self.pg = np.bincount(np.arange(self.n) // group, self.p)
        self.r = g.normal(0, 0.1, (self.n + 1, dim)).astype(np.float32)
        self.q = self.r[:-1].copy()  # a word starts out as its own likeliest successor
        self.b = np.log(self.p).astype(np.float32)
        self.c = np.full((2, dim), 0.5, np.float32)
        self.qg = np.zeros((self.groups, dim), np.float32)
        self.bg = np.log(self.pg).astype(np.float32)
        #: Squared gradients so far, one number a row: they go on from round to round.
        self.sq = {k: np.full(len(getattr(self, k)), 1e-2, np.float32) for k in ("r", "q", "b", "c", "qg", "bg")}

    _PARTS = ("r", "q", "b", "c", "qg", "bg")

    def pack(self) -> np.ndarray:
        """Parameters and squared gradients as rows (of dim + 1 numbers), part after part."""
        d = self.r.shape[1]
        rows = [np.hstack((x.reshape(len(x), -1), np.zeros((len(x), d - (x.size // len(x)))), self.sq[k][:, None])) for k in self._PARTS for x in (getattr(self, k),)]
        return np.concatenate(rows).astype(float)

    def unpack(self, a: np.ndarray) -> LogBilinear:
        at = 0
        for k in self._PARTS:
            x = getattr(self, k)
            rows = a[at : at + len(x)].astype(np.float32)
            setattr(self, k, rows[:, : x.size // len(x)].reshape(x.shape).copy())
            self.sq[k] = rows[:, -1].copy()
            at += len(x)
        return self

    def log_probs(self, w1: np.ndarray, w2: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Normalised natural log probabilities of w after (w2, w1)."""
        if len(w) > BLOCK:
            return np.concatenate([self.log_probs(*(x[a : a + BLOCK] for x in (w1, w2, w))) for a in range(0, len(w), BLOCK)])
        out = np.empty(len(w))
        h = np.ones((len(w), self.r.shape[1] + 1), np.float32)  # the last column takes the biases
        np.multiply(self.c[0], self.r[w1], out=h[:, :-1])
        h[:, :-1] += self.c[1] * self.r[w2]
        q, qg = np.column_stack((self.q, self.b)).T, np.column_stack((self.qg, self.bg)).T
        of = (w // self.group).astype(np.int16)  # 16-bit keys are sorted by their digits
        order = np.argsort(of, kind="stable")
        ends = np.searchsorted(of[order], np.arange(self.groups + 1))
        for g in range(self.groups):
            for a in range(ends[g], ends[g + 1], 1024):
                at = order[a : min(a + 1024, ends[g + 1])]
                x = h[at]
                out[at] = _softmax(x @ qg, g) + _softmax(x @ q[:, g * self.group : (g + 1) * self.group], w[at] - g * self.group)
        return out


def _softmax(s: np.ndarray, of) -> np.ndarray:
    """Log probabilities of the columns `of` of rows of scores."""
    own = s[np.arange(len(s)), of].astype(float)
    ones = np.ones(s.shape[1], s.dtype)
    with np.errstate(over="ignore"):
        total = np.exp(s) @ ones
    if 1e-30 < total.min() and total.max() < 1e30:
        return own - np.log(total)
    top = s.max(1)  # scores too far from 0 for their exponentials
    s -= top[:, None]
    np.exp(s, out=s)
    return own - top - np.log(s @ ones)


class Trainer:
    """Noise-contrastive estimation with AdaGrad over rows; a step shares NOISE samples of the unigram distribution, and GROUP_NOISE groups."""

    def __init__(self, model: LogBilinear, seed: int):
        self.m = model
        self.g = np.random.default_rng(seed)
        self.cdf, self.cdf_g = np.cumsum(model.p), np.cumsum(model.pg)
        self.ln = np.log(NOISE * model.p).astype(np.float32)
        self.ln_g = np.log(GROUP_NOISE * model.pg).astype(np.float32)
        self.steps = self.seen = 0
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_held = 0

    def _update(self, k: str, at, grad: np.ndarray) -> None:
        x, sq = getattr(self.m, k), self.m.sq[k]
        sq[at] += np.einsum("ij,ij->i", grad, grad) / grad.shape[1] if grad.ndim == 2 else grad * grad
        rate = RATE / np.sqrt(sq[at])
        x[at] -= grad * (rate[:, None] if grad.ndim == 2 else rate)

    @staticmethod
    def _sums(ids: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(ids.astype(np.int16), kind="stable")  # ids are 16-bit numbers: sorted by their digits
        s = ids[order]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        return s[first], np.add.reduceat(g[order], first, axis=0)

    @staticmethod
    def _contrast(h: np.ndarray, q: np.ndarray, b: np.ndarray, ln: np.ndarray, y: np.ndarray, noise: np.ndarray):
        """Gradients (of the data's scores, of the noise's scores): the data against the noise samples, each score less the log of the expected number of noise samples."""
        dp = 1 / (1 + np.exp(-(np.einsum("ij,ij->i", h, q[y]) + b[y] - ln[y]))) - 1
        s = h @ q[noise].T
        s += b[noise] - ln[noise]
        np.negative(s, out=s)
        np.exp(s, out=s)
        s += 1
        return dp, np.reciprocal(s, out=s)

    def add(self, w1: np.ndarray, w2: np.ndarray, w: np.ndarray) -> None:
        """Positions to learn from; steps are made as soon as they are full."""
        self.held.append((w1, w2, w))
        self.n_held += len(w)
        while self.n_held >= (size := self.size()):
            x = [np.concatenate(c) for c in zip(*self.held, strict=True)]
            self.step(*(c[:size] for c in x))
            self.held, self.n_held = [tuple(c[size:] for c in x)], self.n_held - size

    def size(self) -> int:
        return min(BATCH_LAST, BATCH_FIRST << min(self.steps // GROW, 20))

    def finish(self) -> LogBilinear:
        if self.n_held:
            self.step(*(np.concatenate(c) for c in zip(*self.held, strict=True)))
            self.held, self.n_held = [], 0
        return self.m

    def train(self, w1: np.ndarray, w2: np.ndarray, w: np.ndarray) -> None:
        self.add(w1, w2, w)
        self.finish()

    def step(self, x1: np.ndarray, x2: np.ndarray, y: np.ndarray) -> None:
        m = self.m
        noise = np.minimum(np.searchsorted(self.cdf, self.g.random(NOISE)), m.n - 1)
        few = np.minimum(np.searchsorted(self.cdf_g, self.g.random(GROUP_NOISE)), m.groups - 1)
        r1, r2 = m.r[x1], m.r[x2]
        h = m.c[0] * r1 + m.c[1] * r2
        dp, dn = self._contrast(h, m.q, m.b, self.ln, y, noise)
        of = y // m.group
        ep, en = self._contrast(h, m.qg, m.bg, self.ln_g, of, few)
        gh = dp[:, None] * m.q[y] + dn @ m.q[noise] + ep[:, None] * m.qg[of] + en @ m.qg[few]
        at, gq = self._sums(np.concatenate((y, noise)), np.concatenate((np.column_stack((dp[:, None] * h, dp)), np.column_stack((dn.T @ h, dn.sum(0))))))
        ag, gg = self._sums(np.concatenate((of, few)), np.concatenate((np.column_stack((ep[:, None] * h, ep)), np.column_stack((en.T @ h, en.sum(0))))))
        ar, gr = self._sums(np.concatenate((x1, x2)), np.concatenate((gh * m.c[0], gh * m.c[1])))
        gc = np.stack((np.einsum("ij,ij->j", gh, r1), np.einsum("ij,ij->j", gh, r2)))
        scale = np.float32(1 / math.sqrt(len(y)))
        for k, i, g in (("q", at, gq[:, :-1]), ("b", at, gq[:, -1]), ("qg", ag, gg[:, :-1]), ("bg", ag, gg[:, -1]), ("r", ar, gr), ("c", slice(None), gc)):
            self._update(k, i, g * scale)
        self.steps += 1
        self.seen += len(y)


@functools.cache
def _suffix_classes() -> np.ndarray:
    """Classes of all pairs of last bytes (the first one times 256, and the second), then of all single bytes."""
    return np.array([zlib.crc32(bytes((x, y))) % REST for x in range(256) for y in range(256)] + [zlib.crc32(bytes((x,))) % REST for x in range(256)], np.int64)


def rest_classes(words: pa.Array, some=slice(None)) -> np.ndarray:
    """The classes of some of the words as words outside the model's own, by their last two bytes."""
    if not len(words):
        return np.zeros(0, np.int64)
    off = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2], np.uint8)
    begin, end = off[:-1][some], off[1:][some]
    last = raw[end - 1].astype(np.int64)
    return _suffix_classes()[np.where(end - begin > 1, raw[end - 2].astype(np.int64) << 8, 1 << 16) + last]


class Lexicon:
    """Ids, counts and classes of the frequent words, and the sums that the smoothed shares need."""

    def __init__(self, words: list[tuple[bytes, int]], n: int, v: int, train_docs: int, lbl_words: int, by_class: dict[int, tuple[int, int]]):
        """by_class: tokens and distinct words of all words by their class."""
        self.k = min(lbl_words, len(words))
        self.ids = {w: i for i, (w, _) in enumerate(words)}
        self.counts = np.array([c for _, c in words], np.int64)
        self.n, self.v, self.train_docs = n, v, train_docs
        self.end, self.first_rest, self.start = self.k, self.k + 1, self.k + 1 + REST
        own = rest_classes(pa.array([w for w, _ in words[: self.k]], pa.binary()))
        total = np.array([by_class.get(i, (0, 0)) for i in range(REST)], float).reshape(REST, 2)
        self.rest_n = total[:, 0] - np.bincount(own, self.counts[: self.k], REST)[:REST]
        self.rest_log = np.log10(self.rest_n + total[:, 1] - np.bincount(own, minlength=REST)[:REST] + 1)
        self.base_log = math.log10(n + v + 1)
        self.words = pa.array(list(self.ids), pa.binary())

    def unigram(self) -> np.ndarray:
        return np.concatenate((self.counts[: self.k], [self.train_docs], self.rest_n)).astype(float) + 1.0

    def sequences(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Of texts one after another (see words_of): frequent-word ids (-1: none, -2: the end), their output classes, the texts' firsts; the words without an id, and their texts' numbers."""
        words, at = words_of(data, off)
        found = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        out = found.copy()
        rest = np.flatnonzero((found < 0) | (found >= self.k))
        out[rest] = self.first_rest + rest_classes(words, rest)
        first = at + np.arange(len(at))
        of = np.repeat(np.arange(len(at) - 1), np.diff(at))
        place = np.arange(len(words)) + of
        ids, classes = np.full(first[-1], -2, np.int64), np.full(first[-1], self.end, np.int64)
        ids[place], classes[place] = found, out
        lost = np.flatnonzero(found < 0)
        return ids, classes, first, words.take(pa.array(lost)), of[lost]

    def contexts(self, w: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two tokens before each."""
        w1 = np.concatenate(([self.start], w[:-1]))
        w1[first[:-1]] = self.start
        w2 = np.concatenate(([self.start], w1[:-1]))
        w2[first[:-1]] = self.start
        return w1, w2


def word_counts(texts: DataFrame) -> DataFrame:
    """(w, k: its class, c) of the column t; a task sends what it has counted whenever that is half a million words or more."""

    def run(batches):
        held, n = [], 0

        def sums():
            t = pa.concat_tables(held).group_by("w", use_threads=False).aggregate([("c", "sum")]).combine_chunks()
            return pa.table({"w": t["w"], "c": t["c_sum"]})

        def out(t):
            for b in t.to_batches(max_chunksize=1 << 17):
                yield pa.RecordBatch.from_pydict({"w": b.column("w"), "k": pa.array(rest_classes(b.column("w")), pa.int32()), "c": b.column("c")})

        for batch in batches:
            for _, _, data, off in binary_slices(batch.column("t"), BATCH_BYTES):
                c = pc.value_counts(words_of(data, off)[0])
                held.append(pa.table({"w": c.field(0), "c": c.field(1)}))
                n += len(c)
                if n >= 1_000_000:
                    held = [sums()]
                    n = len(held[0])
                    if n >= 500_000:
                        yield from out(held[0])
                        held, n = [], 0
        if n:
            yield from out(sums())

    return map_batches(texts, run, "w binary, k int, c long").groupBy("w", "k").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, most: int) -> DataFrame:
    """Rows of counts for the most frequent words, `most` at most: those over a count that a histogram of binned counts gives.

    A top-k would send k rows of every partition to one place.
    """
    binned = counts.withColumn("bin", F.floor(F.log2("c") * 16).cast("int"))
    left, least = most, None
    for r in sorted(binned.groupBy("bin").agg(F.count("*").alias("n")).collect(), reverse=True):  # 16 bins an octave: a thousand rows at most
        if r.n > left:
            break
        left, least = left - r.n, r.bin
    return binned.where(F.col("bin") >= (least if least is not None else 1 << 30)).select("w", "c")


def train(texts: DataFrame, lexicon, start: LogBilinear, tokens: int) -> LogBilinear:
    """ROUNDS averages of the shards' passes over texts (k, t), each weighted by its positions; tokens: of all texts."""
    spark = texts.sparkSession
    shards = max(1, math.ceil(tokens / SHARD_TOKENS))

    def encode(batches):
        lex = lexicon.value
        for batch in batches:
            for a, b, data, off in binary_slices(batch.column("t"), BATCH_BYTES):
                _, out, first, _, _ = lex.sequences(data, off)
                w = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((2 * first).astype(np.int32)), pa.py_buffer(out.astype("<i2"))])
                yield pa.RecordBatch.from_pydict({"h": batch.column("h").slice(a, b - a), "w": w})

    seqs = map_batches(texts.select(F.xxhash64("t", "k").alias("h"), "t"), encode, "h long, w binary")
    dealt = seqs.select(F.pmod("h", F.lit(ROUNDS)).cast("int").alias("round"), F.pmod(F.floor(F.col("h") / ROUNDS), F.lit(shards)).cast("long").alias("shard"), "h", "w")
    dealt = materialize(dealt, "sequences")
    width = start.pack().shape[1]
    for k in range(ROUNDS):
        model = spark.sparkContext.broadcast(start)

        def run(batches, model=model, k=k):
            import copy

            t, now, lex, total, seen = None, None, lexicon.value, 0.0, 0

            def done():
                nonlocal total, seen
                if t is not None:
                    m = t.finish()
                    total, seen = total + m.pack() * t.seen, seen + t.seen

            for batch in batches:
                for shard, w in zip(batch.column("shard").to_pylist(), batch.column("w"), strict=True):
                    if shard != now:
                        done()
                        t, now = Trainer(copy.deepcopy(model.value), [k, shard]), shard
                    w = np.frombuffer(w.as_buffer(), "<i2").astype(np.int64)
                    w1, w2 = lex.contexts(w, np.array([0, len(w)]))
                    t.add(w1, w2, w)
            done()
            if seen:
                yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(total)), pa.int64()), "n": pa.array(np.full(len(total), float(seen))), "v": pa.array(total.tolist(), pa.list_(pa.float64()))})

        own = dealt.where(F.col("round") == k).select("shard", "h", "w").repartition(min(shards, partitions(spark)), "shard").sortWithinPartitions("shard", "h", "w")
        sums = map_batches(own, run, "i long, n double, v array<double>").groupBy("i").agg(F.sum("n").alias("n"), *[F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(width)])
        got = sums.collect()  # a row for each row of the parameters: bounded by the vocabulary of the model
        if got:
            out = start.pack()
            for r in got:
                out[r.i] = np.array(r[2:]) / r.n
            start.unpack(out)
    discard(dealt)
    return start


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = 2, folds: int = 7, frequent: int = FREQUENT, lbl_words: int = LBL_WORDS):
    """(lexicon, model, counts table) from the texts outside fold held_out of the ids.

    Null texts are empty. Without training texts every count is 0 and the model is that of no text at all.
    """
    if lbl_words + 1 + REST > 32_767:
        raise ValueError("ids are 16-bit numbers")
    spark = docs.sparkSession
    texts = docs.where(fold_of(id_col, folds) != held_out).select(F.col(id_col).alias("k"), text_bytes(text_col).alias("t"))
    counts = materialize(word_counts(texts.select("t")), "counts")
    n_docs = docs.where(fold_of(id_col, folds) != held_out).count()
    by_class = {r.k: (r.c, r.v) for r in counts.groupBy("k").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}  # REST rows at most
    total, distinct = (sum(x[i] for x in by_class.values()) for i in (0, 1))
    words = sorted(((bytes(r.w), r.c) for r in frequent_words(counts, frequent).collect()), key=lambda x: (-x[1], x[0]))
    lex = Lexicon(words, total + n_docs, distinct + (1 if n_docs else 0), n_docs, lbl_words, by_class)
    shared = spark.sparkContext.broadcast(lex)
    model = train(texts, shared, LogBilinear(lex.unigram()), lex.n)
    return shared, model, counts


def score(docs: DataFrame, fitted, id_col: str = "doc_id", text_col: str = "text", held_out: int = 2, folds: int = 7) -> DataFrame:
    """Per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null texts are empty: one token, the end. Rows that share an id each get their row. Without training texts every
    count is 0. Texts are scored whole; equal texts have equal scores.
    """
    lexicon, model, counts = fitted
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)
    base = docs.select(F.monotonically_increasing_id().alias("r"), F.col(id_col).alias("k"), text_bytes(text_col).alias("t"))
    lex0 = lexicon.value
    base_log = lex0.base_log

    def run(batches):
        lex, m = lexicon.value, shared.value
        logs = np.log10(lex.counts + 1.0)
        end_log = math.log10((lex.train_docs if lex.train_docs else 0) + 1.0)
        for batch in batches:
            for a, b, data, off in binary_slices(batch.column("t"), BATCH_BYTES):
                ids, w, first, lost, of = lex.sequences(data, off)
                lp = m.log_probs(*lex.contexts(w, first), w) / _LN10
                other = w >= lex.first_rest
                lp[other] -= lex.rest_log[w[other] - lex.first_rest]
                known = ids >= 0
                own = np.zeros(len(ids))
                own[known] = logs[ids[known]]
                own[ids == -2] = end_log
                lp += np.where(known & other, own, 0)
                basis = np.where(ids != -1, own - base_log, 0)
                seen = known | ((ids == -2) & (lex.train_docs > 0))
                at = first[:-1]
                sums = [np.add.reduceat(x, at) for x in (lp, basis, seen.astype(np.int64))]
                r = batch.column("r").slice(a, b - a)
                whole = pa.StructArray.from_arrays([batch.column("k").slice(a, b - a), pa.array(np.diff(first)), pa.array(sums[2]), pa.array(sums[1]), pa.array(sums[0])], ["k", "tokens", "known", "base", "lp"])
                # the texts' own rows: no word holds a space, so these words meet no count
                yield pa.RecordBatch.from_pydict({"r": r, "w": pa.array([b" %d" % x for x in r.to_pylist()], pa.binary()), "n": pa.array(np.zeros(b - a, np.int64)), "own": whole})
                if len(lost):
                    t = pa.table({"of": of, "w": lost}).group_by(["of", "w"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
                    for x in t.to_batches():
                        yield pa.RecordBatch.from_pydict({"r": r.take(x.column("of")), "w": x.column("w"), "n": x.column("count_all"), "own": pa.nulls(x.num_rows, whole.type)})

    parts = map_batches(base, run, f"r long, w binary, n long, own struct<k: {kind}, tokens: long, known: long, base: double, lp: double>")
    # words that many rows hold are in the broadcast; what texts outside the training have alone, Spark's own skew join deals
    joined = parts.join(counts.select("w", "c"), "w", "left")
    own = F.log10(F.coalesce("c", F.lit(0)) + 1)
    out = joined.groupBy("r").agg(
        F.max("own.k").alias("k"),
        F.sum("own.tokens").alias("n_tokens"),
        (F.sum("own.known") + F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0))).alias("n_known"),
        (F.sum("own.base") + F.sum(F.col("n") * (own - base_log))).alias("base_score"),
        (F.sum("own.lp") + F.sum(F.col("n") * own)).alias("score"),
    )
    return out.select(F.col("k").alias(id_col), (fold_of("k", folds) == held_out).alias("held_out"), "n_tokens", "n_known", F.lit(lex0.n).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs))
