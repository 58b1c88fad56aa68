"""Packing by minimum bin slack: token counts of whole texts are laid into windows of 2048 with hardly any padding.

One pass tokenizes each text and cuts it into full windows and one remainder; only lengths and digests (and ids, if
asked for) leave it. Full windows are sequences of their own. The remainders' lengths form a histogram of at most
2047 numbers; on it the driver plans: the largest length left is laid down, a subset-sum over the bits of one integer
finds the multiset of lengths left that fills the window closest to its capacity, backtracking gives how often each
length occurs in it, and the pattern is used as often as the counts allow. Each remainder's rank among those of its
length then names its sequence and offset. Ranks are counted in salted groups, so a length of a third of all
documents (empty texts, say) is dealt over all partitions.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specloom.llm.common import arrow_map, materialize, partitions, text_bytes

CAPACITY = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker keeps; then it starts afresh.
CACHE_WORDS = 400_000

_loaded: dict[str, WordEncoder] = {}


def tokenizer_path(name: str) -> str:
    """A file's path as it is, a bare name as one of the public tokenizers."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others for the letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space, word by word through a cache.

    White space ends every token of this tokenizer, so the ids of a text are those of its words. Words of letters
    of Latin blocks go straight to the model after the pre-tokenizer's pattern; any other word, and any text that
    may hold a special token's string, goes through the library as it is.
    """

    def __init__(self, name: str):
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(tokenizer_path(name))
        self.model = self.tok.model
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.simple = re.compile("[\x21-\x7e\xa1-\xac\xae-įı-ſ]+").fullmatch
        self.letters = _byte_letters()
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, p: str) -> bytes:
        u = p if p.isascii() else p.encode().decode("latin-1").translate(self.letters)
        got = np.array([t.id for t in self.model.tokenize(u)], "<u4").tobytes()
        if len(self.parts) >= CACHE_WORDS:
            self.parts.clear()
        self.parts[p] = got
        return got

    def word(self, word: bytes) -> bytes:
        w = word.decode("utf-8", "replace")
        if self.simple(w):
            get = self.parts.get
            got = b"".join([get(p) or self._part(p) for p in self.pieces(w.lower())])
        else:
            got = np.array(self.tok.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.words) >= CACHE_WORDS:
            self.words.clear()
        self.words[word] = got
        return got

    def encode(self, text: bytes) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if b"<|" in text:
            return np.array(self.tok.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        ws = text.split()
        x = list(map(self.words.get, ws))
        if None in x:
            word, get = self.word, self.words.get
            x = [v if v is not None else (get(w) or word(w)) for v, w in zip(x, ws, strict=True)]
        return b"".join(x)


def encoder(name: str) -> WordEncoder:
    """One encoder for each worker process."""
    if name not in _loaded:
        _loaded[name] = WordEncoder(name)
    return _loaded[name]


# --- the plan -----------------------------------------------------------------------------------


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, at most counts[length] of each, with the largest sum up to capacity; larger lengths first."""
    reach, steps = 1, []
    mask = (1 << (capacity + 1)) - 1
    full = 1 << capacity
    for length in sorted(counts, reverse=True):
        left = min(counts[length], capacity // length)
        k = 1
        while left > 0 and not reach & full:
            take = min(k, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left -= take
            k *= 2
        if reach & full:
            break
    at, used = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> how often in a window) and how many windows get each; every counted length is laid once."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    out = []
    while counts:
        top = max(counts)
        rest = dict(counts)
        rest[top] -= 1
        if not rest[top]:
            del rest[top]
        used = closest_fill(rest, capacity - top) if capacity > top else {}
        used[top] = used.get(top, 0) + 1
        times = min(counts[k] // n for k, n in used.items())
        for k, n in used.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        out.append((used, times))
    return out


class Layout:
    """Where the remainder of a length and rank goes: sorted arrays over (length, first rank) of each pattern."""

    def __init__(self, patterns: list[tuple[dict[int, int], int]]):
        rows, seen, base = [], {}, 0
        for used, times in patterns:
            offset = 0
            for length in sorted(used, reverse=True):
                n = used[length]
                first = seen.get(length, 0)
                rows.append((length, first, n, base, offset))
                seen[length] = first + n * times
                offset += n * length
            base += times
        rows.sort()
        self.sequences = base
        a = np.array(rows, np.int64).reshape(-1, 5)
        self.key = (a[:, 0] << 48) + a[:, 1]
        self.first, self.n, self.base, self.offset = a[:, 1], a[:, 2], a[:, 3], a[:, 4]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 48) + rank, side="right") - 1
        q = rank - self.first[at]
        return self.base[at] + q // self.n[at], self.offset[at] + q % self.n[at] * length


# --- the operator -------------------------------------------------------------------------------


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(k, start, length, ids_crc32, doc_tokens[, ids]): full windows and the remainder of each text's ids and end_id."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def fn(batch: pa.RecordBatch) -> dict:
        encode = encoder(tokenizer).encode
        at, start, length, crc, total, ids = [], [], [], [], [], []
        for i, text in enumerate(batch.column("t").to_pylist()):
            own = encode(text) + end
            n = len(own) // 4
            for a in range(0, n, capacity):
                part = own[4 * a : 4 * (a + capacity)]
                at.append(i)
                start.append(a)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                total.append(n)
                if with_ids:
                    ids.append(part)
        out = {"k": batch.column("k").take(pa.array(at, pa.int64()))} | {c: pa.array(v, pa.int64()) for c, v in (("start", start), ("length", length), ("ids_crc32", crc), ("doc_tokens", total))}
        return out | ({"ids": pa.array(ids, pa.binary())} if with_ids else {})

    base = docs.select(F.col(id_col).alias("k"), text_bytes(text_col).alias("t"))
    return arrow_map(base, fn, f"k {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids, 256)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids: little-endian 32-bit numbers).

    Null or empty texts are the end id alone. Each id of each row lies in one piece; rows that share an id are packed
    each. Offsets of a sequence have no gaps from 0. sequence_id is unique, not dense. An empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    cut = materialize(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids), "pieces")
    rest = cut.where(F.col("length") < capacity)
    histogram = {r.length: r.n for r in rest.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity - 1 rows
    layout = Layout(plan(histogram, capacity))
    shared = spark.sparkContext.broadcast(layout)

    salts = partitions(spark)
    rest = rest.withColumn("salt", F.pmod(F.xxhash64("k", "ids_crc32", "doc_tokens"), F.lit(salts)).cast("int"))
    before = rest.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = before.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = rest.withColumn("r", F.row_number().over(Window.partitionBy("length", "salt").orderBy("k", "start", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("r") + F.col("before"))
    own = ["k", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]

    def fn(batch: pa.RecordBatch) -> dict:
        seq, off = shared.value.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
        return {c: batch.column(c) for c in own} | {"sequence_id": pa.array(seq), "offset": pa.array(off)}

    placed = arrow_map(ranked.select(*own, F.col("rank").cast("long").alias("rank")), fn, f"k {kind}, start long, length long, ids_crc32 long, doc_tokens long, " + "ids binary, " * with_ids + "sequence_id long, offset long", 8192)
    whole = cut.where(F.col("length") == capacity).select(*own, (F.monotonically_increasing_id() + F.lit(layout.sequences)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(whole).withColumnRenamed("k", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
