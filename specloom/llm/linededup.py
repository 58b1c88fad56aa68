"""Line dedup: normalised lines are hashed, hashes held by many documents lose their lines, texts come back in line order."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm.common import SPACES, arrow_map, by_shuffle, discard, fresh_name, has_repeated_ids, map_batches, materialize, observed, spread_join, text_bytes

MIN_CHARS = 20
MIN_DOCS = 3


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """128-bit hash of the line with [\\x20\\x09-\\x0D] stripped and A-Z lower-cased; None under min_chars code points."""
    key = line.strip(SPACES)
    if len(key) < min_chars:
        return None
    if len(key) < 4 * min_chars and not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _keys(docs: DataFrame, kind: str, min_chars: int) -> DataFrame:
    """(h, k): each eligible line hash of a row once."""

    def fn(batch: pa.RecordBatch) -> dict:
        keys, at = [], []
        for i, text in enumerate(batch.column("t").to_pylist()):
            own = {line_key(x, min_chars) for x in text.lower().split(b"\n")}
            own.discard(None)
            keys.extend(own)
            at.extend([i] * len(own))
        return {"h": pa.array(keys, pa.binary()), "k": batch.column("k").take(pa.array(at, pa.int64()))}

    return arrow_map(docs, fn, f"h binary, k {kind}")


def dropped_keys(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """From docs (k, t): (k, drops: hashes whose lines this document loses), a written table.

    Counting ships one partial count a task and hash, and a line in a third of all rows meets its count in many
    tasks: it is pre-aggregated, and dealt on the way back. A document's own lost hashes are its only array.
    """
    kind = docs.schema["k"].dataType.simpleString()
    keys, n = observed(_keys(docs, kind, min_chars), "keys", total=F.count(F.lit(1)))
    held = keys.distinct() if has_repeated_ids(docs, "k") else keys
    often = materialize(held.groupBy("h").agg(F.count("*").alias("n"), F.max("k").alias("last")).where(F.col("n") >= min_docs), "lines")
    lost = spread_join(keys, often, ["h"], "n", F.xxhash64("k"), n["total"] or 0).where(~F.col("k").eqNullSafe(F.col("last")))
    drops = materialize(lost.groupBy("k").agg(F.collect_set("h").alias("drops")), "drops")
    discard(keys, often)
    return drops


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Per row of docs: id, n_lines, n_dropped, kept_sha256 and, if asked for, kept (the text that stays, as bytes).

    Keys of at least min_chars code points in at least min_docs documents lose all their lines except in the
    largest id holding it. Null or empty texts are one empty line, which stays. A text whose lines all go is ''.
    Rows that share an id are one document when documents are counted, and each gets its result; a null id is
    a document smaller than any other.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("k"), text_bytes(text_col).alias("t"))
    drops = dropped_keys(base, min_docs, min_chars)
    joined = base.withColumnRenamed("k", "k0").join(by_shuffle(drops), F.col("k0").eqNullSafe(F.col("k")), "left").select(F.col("k0").alias("k"), "t", "drops")

    def fn(batch: pa.RecordBatch) -> dict:
        n, gone, sha, kept = [], [], [], []
        for text, drop in zip(batch.column("t").to_pylist(), batch.column("drops").to_pylist(), strict=True):
            lines = text.split(b"\n")
            n.append(len(lines))
            if drop:
                drop = set(drop)
                text = b"\n".join(stay := [x for x in lines if line_key(x.lower(), min_chars) not in drop])
                gone.append(len(lines) - len(stay))
            else:
                gone.append(0)
            sha.append(hashlib.sha256(text).hexdigest())
            if with_text:
                kept.append(text)
        return {"k": batch.column("k"), "n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string())} | ({"kept": pa.array(kept, pa.binary())} if with_text else {})

    out = arrow_map(joined, fn, f"k {kind}, n_lines long, n_dropped long, kept_sha256 string" + ", kept binary" * with_text)
    return out.withColumnRenamed("k", id_col)


def drop_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated lines taken out of the texts; a null text stays null, other columns stay as they are."""
    names = docs.columns
    base = docs.select(F.col(id_col).alias("k"), text_bytes(text_col).alias("t"))
    drops = dropped_keys(base, min_docs, min_chars)
    key, lines = fresh_name(docs, "_k_"), fresh_name(docs, "_drops_")
    drops = drops.select(F.col("k").alias(key), F.col("drops").alias(lines))
    joined = docs.join(by_shuffle(drops), docs[id_col].eqNullSafe(F.col(key)), "left").drop(key)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                col = b.schema.get_field_index(text_col)
                lost = b.column(b.schema.get_field_index(lines)).to_pylist()
                if any(lost):
                    texts = b.column(col).cast(pa.binary()).to_pylist()
                    for i, drop in enumerate(lost):
                        if drop and texts[i] is not None:
                            drop = set(drop)
                            texts[i] = b"\n".join(x for x in texts[i].split(b"\n") if line_key(x.lower(), min_chars) not in drop)
                    b = b.set_column(col, b.schema.field(col), pa.array(texts, pa.binary()).cast(b.schema.field(col).type))
                yield b.select(names)

    return map_batches(joined, run, docs.schema).select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, pos, line, r.key IS NOT NULL AND k.doc_id <> r.last AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
