"""Benchmark decontamination: word windows of test items, broadcast as a hash set, found in whole training texts.

One index is in memory at a time. A benchmark of more than BROADCAST_CHARS characters is cut into parts; each part's
index is broadcast, looked for in all texts and dropped again, and only the hits of its pass are kept. Spans and texts
are cut once, from the hits of all passes together, so the number of parts never shows in a result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm.common import arrow_map, discard, fresh_name, map_batches, materialize, text_bytes

WINDOW = 10
#: Characters of benchmark text in one broadcast index; more text is looked for in several passes. An index takes at most
#: 35 bytes a character (measured with hardly a word twice, 5 letters each), so 2 Mi characters stay under 75 MB a process.
BROADCAST_CHARS = 2 << 20

_KEEP = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 0x80 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_MULT = [np.uint64(pow(0x9FB21C651E98DF25, k, 1 << 64) | 1) for k in range(256)]


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+; all bytes of other characters are over 0x7F."""
    return text.translate(_KEEP).split()


class WindowIndex:
    """Windows of benchmark items in flat arrays.

    Word ids of all items stand one after another; each distinct window is a row of a table sorted by its hash, with
    the place where it first stands and its items (a run of the array owners).
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.items = [item for item, _ in items]
        rows = [np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)], np.int32) for _, text in items]
        first = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
        self.flat = np.concatenate([*rows, np.zeros(0, np.int32)])
        by_size: dict[int, list[int]] = {}
        for k, r in enumerate(rows):
            if len(r):
                by_size.setdefault(min(window, len(r)), []).append(k)
        #: size of window -> (hashes, places, firsts of owners, owners)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, own in by_size.items():
            at = np.concatenate([np.arange(first[k], first[k + 1] - size + 1) for k in own])
            of = np.concatenate([np.full(len(rows[k]) - size + 1, k, np.int32) for k in own])
            h = self._hash([self.flat[at + k] for k in range(size)])
            order = np.argsort(h, kind="stable")
            h, at, of = h[order], at[order], of[order]
            # rows of equal hashes are of one window but for collisions, which a hash of their first words can't tell: words do
            words = self.flat[at[:, None] + np.arange(size)]
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (words[1:] != words[:-1]).any(1)))
            start = np.flatnonzero(new)
            pair = np.unique(np.stack((np.cumsum(new) - 1, of), 1), axis=0)
            self.tables[size] = (h[start], at[start], np.searchsorted(pair[:, 0], np.arange(len(start) + 1)), pair[:, 1].astype(np.int32))

    @staticmethod
    def _hash(columns) -> np.ndarray:
        h = np.uint64(0)
        for k, c in enumerate(columns):
            h = h + c.astype(np.uint64) * _MULT[k + 1]
        return h

    def find(self, rows: list[list[bytes]]) -> tuple[list[list[tuple[int, int]]], list[list[str]]]:
        """Per text: hit windows (start, end; in words) and items. Hash hits are confirmed on the words themselves."""
        sizes = np.array([len(r) for r in rows], np.int64)
        first = np.concatenate(([0], np.cumsum(sizes + 1)))  # a 0 ends each text
        ids = np.zeros(first[-1], np.int32)
        get = self.ids.get
        for r, at in zip(rows, first, strict=False):
            if r:
                ids[at : at + len(r)] = np.fromiter(map(get, r, repeat(0)), np.int32, len(r))
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        hits: list[list[tuple[int, int]]] = [[] for _ in rows]
        items: list[set[str]] = [set() for _ in rows]
        for size, (hashes, places, starts, owners) in self.tables.items():
            if len(ids) < size:
                continue
            p = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(p):
                continue
            h = self._hash([ids[p + k] for k in range(size)])
            low, high = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
            steps = np.arange(size)
            while len(more := np.flatnonzero(low < high)):  # once, but for colliding hashes
                p, low, high = p[more], low[more], high[more]
                same = (ids[p[:, None] + steps] == self.flat[places[low][:, None] + steps]).all(1)
                q, w = p[same], low[same]
                docs = np.searchsorted(first, q, side="right") - 1
                for d, a in zip(docs.tolist(), (q - first[docs]).tolist(), strict=True):
                    hits[d].append((a, a + size))
                for d, x in np.unique(np.stack((docs, w), 1), axis=0).tolist():
                    items[d].update(self.items[o] for o in owners[starts[x] : starts[x + 1]].tolist())
                low = low + 1
        return hits, [sorted(x) for x in items]


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _indexes(spark: SparkSession, bench: DataFrame, item_col: str, text_col: str, window: int, limit: int) -> tuple[int, Iterator[Broadcast]]:
    """How many indexes of about `limit` characters the items need, and one broadcast after another; each goes before the next is made."""
    items = bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), text_bytes(text_col).alias("t"))
    total = items.agg(F.sum(F.length("t").cast("long"))).first()[0] or 0
    n = max(1, -(-total // limit))

    def each() -> Iterator[Broadcast]:
        for k in range(n):
            part = items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
            index = spark.sparkContext.broadcast(WindowIndex([(r.i, bytes(r.t)) for r in part.toLocalIterator()], window))
            yield index
            if n > 1:
                index.destroy()

    return n, each()


_SPANS = "array<struct<start:long,end:long>>"
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _spans(hits: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in merged(x)] for x in hits], _SPANS_ARROW)


def _all_hits(held: DataFrame, row: str, text_col: str, indexes: Iterator[Broadcast]) -> DataFrame:
    """(r, spans, items) of the rows with hits, over all indexes: a pass a table, put together by the rows' own key."""
    kind = held.schema[row].dataType.simpleString()
    base = held.select(F.col(row).alias("r"), text_bytes(text_col).alias("t"))
    passes = []
    for index in indexes:

        def fn(batch: pa.RecordBatch, index=index) -> dict | None:
            hits, items = index.value.find([words_of(x) for x in batch.column("t").to_pylist()])
            some = [i for i, x in enumerate(hits) if x]
            if not some:
                return None
            return {"r": batch.column("r").take(pa.array(some)), "spans": _spans([hits[i] for i in some]), "items": pa.array([items[i] for i in some], pa.list_(pa.string()))}

        passes.append(materialize(arrow_map(base, fn, f"r {kind}, spans {_SPANS}, items array<string>", 256), "hits"))
    both = passes[0]
    for one in passes[1:]:
        both = both.unionByName(one)
    out = both.groupBy("r").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def fold(batch: pa.RecordBatch) -> dict:
        return {"r": batch.column("r"), "spans": _spans([[(y["start"], y["end"]) for y in x] for x in batch.column("s").to_pylist()]), "items": batch.column("items")}

    out = materialize(arrow_map(out.select("r", "s", "items"), fold, f"r {kind}, spans {_SPANS}, items array<string>"), "hits")
    discard(*passes)
    return out


def scan(docs: DataFrame, bench: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", limit: int = BROADCAST_CHARS, keep_text: bool = False) -> DataFrame:
    """Per row of docs: id, n_words, spans (hit windows in words, overlaps merged), items (sorted as strings), n_hit.

    The index is broadcast only up to `limit` characters of benchmark text; a larger benchmark is cut into
    several indexes, each looked for in a pass of its own, and the passes' spans are put together.
    Null or empty texts have no words. A null id is kept; repeated rows each get their result. Items without
    words are never found; equal items are all named.
    """
    spark = docs.sparkSession
    n, indexes = _indexes(spark, bench, item_col, item_text, window, limit)
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("k"), text_bytes(text_col).alias("t"))
    text = ["t"] * keep_text
    schema = f"k {kind}, " + "t binary, " * keep_text + f"n_words long, spans {_SPANS}, items array<string>"
    if n == 1:
        index = next(indexes)

        def fn(batch: pa.RecordBatch) -> dict:
            rows = [words_of(x) for x in batch.column("t").to_pylist()]
            hits, items = index.value.find(rows)
            return {c: batch.column(c) for c in ("k", *text)} | {"n_words": pa.array([len(x) for x in rows], pa.int64()), "spans": _spans(hits), "items": pa.array(items, pa.list_(pa.string()))}

        out = arrow_map(base, fn, schema, 256)
    else:
        held = materialize(base.withColumn("r", F.expr("uuid()")), "decontam")
        met = held.join(_all_hits(held, "r", "t", indexes), "r", "left")

        def count(batch: pa.RecordBatch) -> dict:
            words = pa.array([len(words_of(x)) for x in batch.column("t").to_pylist()], pa.int64())
            return {c: batch.column(c) for c in ("k", *text)} | {"n_words": words, "spans": batch.column("spans"), "items": batch.column("items")}

        none = F.expr(f"cast(array() as {_SPANS})")
        out = arrow_map(met.select("k", "t", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items")), count, schema, 256)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select(F.col("k").alias(id_col), *([F.col("t").alias("text_bytes")] * keep_text), "n_words", "spans", "items", n_hit.alias("n_hit"))


def contamination(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """The digest columns of scan(): doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    s = scan(docs, bench, **options)
    return s.select(options.get("id_col", "doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without the words of the spans and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


def decontaminate(docs: DataFrame, bench: DataFrame, mode: str = "document", min_share: float = 0.0, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, limit: int = BROADCAST_CHARS) -> DataFrame:
    """docs without contaminated rows (mode "document": hit words over min_share of all words) or without the hit spans (mode "span").

    Columns and clean rows stay as they are. One broadcast index needs no shuffle at all; of several, the hits of all
    come first and each text is judged or cut once, so results don't depend on `limit`. Null or empty texts, null ids
    and repeated rows stay, each row judged by itself.
    """
    names = docs.columns
    n, indexes = _indexes(docs.sparkSession, bench, "item_id", "text", window, limit)
    index, spans = (next(indexes), None) if n == 1 else (None, fresh_name(docs, "_spans_"))
    if spans is None:
        joined = docs
    else:
        row = fresh_name(docs, "_row_")
        held = materialize(docs.withColumn(row, F.expr("uuid()")), "decontam")
        hits = _all_hits(held, row, text_col, indexes).select(F.col("r").alias(row), F.col("spans").alias(spans))
        joined = held.join(hits, row, "left").select(*names, spans)

    def found(b: pa.RecordBatch, texts: list[bytes]) -> list[list[tuple[int, int]]]:
        if spans is None:
            return [merged(x) for x in index.value.find([words_of(x) for x in texts])[0]]
        return [[(y["start"], y["end"]) for y in x or ()] for x in b.column(b.schema.get_field_index(spans)).to_pylist()]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                col = b.schema.get_field_index(text_col)
                old = b.column(col).cast(pa.binary()).to_pylist()
                texts = [x or b"" for x in old]
                hits = found(b, texts)
                b = b.select(names)
                if mode == "document":
                    over = [bool(h) and sum(y - x for x, y in h) > min_share * (len(words_of(t)) if min_share else 0) for t, h in zip(texts, hits, strict=True)]
                    yield b.filter(pa.array([not x for x in over], pa.bool_()))
                elif any(hits):
                    col = b.schema.get_field_index(text_col)
                    new = [cut_spans(x, h) if h else y for x, y, h in zip(texts, old, hits, strict=True)]
                    yield b.set_column(col, b.schema.field(col), pa.array(new, pa.binary()).cast(b.schema.field(col).type))
                else:
                    yield b

    return map_batches(joined, run, docs.schema).select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS k
  FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, p, dw.n, item FROM dw JOIN bw USING (n, k)),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
