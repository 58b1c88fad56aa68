"""Token counts through a digest cache: only texts whose digest has no stored count are encoded.

The cache is a table (digest, version, n_tokens) of Parquet files that calls append to. A text's digest is the
sha256 of its bytes, the version that of the tokenizer's file, so another tokenizer never meets its counts. Of the
digests without a stored count, the smallest id stands for all its copies: it alone is encoded. Copies are counted by
partial aggregates, and a digest of very many copies meets its count in as many tasks; texts move once, dealt by id.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm.common import arrow_map, discard, has_repeated_ids, materialize, observed, scratch_dir, spread_join, text_bytes
from specloom.llm.packing import tokenizer_path

TOKENIZER = "piece_bpe_32k.model"
LIMIT = 4096
CACHE_SCHEMA = "digest binary, version string, n_tokens long"

_loaded: dict[str, object] = {}


def counter(name: str):
    """texts (bytes) -> token counts, by the library of the file's kind; one for each worker process."""
    if name not in _loaded:
        path = tokenizer_path(name)
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[name] = lambda texts: [len(x) for x in sp.encode([t.decode("utf-8", "replace") for t in texts], num_threads=1)]
        else:
            from specloom.llm.packing import WordEncoder

            if path.endswith("word_bpe_49k.json"):
                enc = WordEncoder(name)
                _loaded[name] = lambda texts: [len(enc.encode(t)) // 4 for t in texts]
            else:
                from tokenizers import Tokenizer

                tok = Tokenizer.from_file(path)
                _loaded[name] = lambda texts: [len(x.ids) for x in tok.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
    return _loaded[name]


def tokenizer_version(name: str) -> str:
    with open(tokenizer_path(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts; a cache that nobody has written yet is empty."""
    at = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.read.schema(CACHE_SCHEMA).parquet(cache)
    return spark.createDataFrame([], CACHE_SCHEMA)


def token_counts(docs: DataFrame, cache: str, tokenizer: str = TOKENIZER, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). New counts are appended to cache.

    Null texts count as empty, which have what the library says (0). Rows of equal texts share one encoding, also
    when they share an id; a null id is an id like any other. cache: a folder that all executors share.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    base = docs.select(F.col(id_col).alias("k"), text_bytes(text_col).alias("t"))
    # sha2 of a binary is computed by Spark; its text form is kept as 32 bytes
    digests = materialize(base.select("k", F.unhex(F.sha2("t", 256)).alias("digest"), F.length("t").cast("long").alias("n_bytes")), "digests")
    stored = read_cache(spark, cache).where(F.col("version") == version).select("digest", "n_tokens")
    # two writers may have stored the same digest: one count a digest
    stored = stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    copies, seen = observed(digests.groupBy("digest").agg(F.min("k").alias("k"), F.count("*").alias("n")), "copies", total=F.sum("n"))
    keyed = copies.join(stored.select("digest"), "digest", "left_anti").select(F.col("k").alias("rk"), F.col("digest").alias("want"))
    texts = base.withColumn("digest", F.unhex(F.sha2("t", 256)))
    # rows of one id may hold several texts: the digest says which one is wanted
    misses = texts.join(keyed, F.col("k").eqNullSafe(F.col("rk")) & (F.col("digest") == F.col("want")), "left_semi").select("digest", "t")
    if has_repeated_ids(docs, id_col):  # else each digest has one row
        misses = misses.dropDuplicates(["digest"])

    def fn(batch: pa.RecordBatch) -> dict:
        texts = batch.column("t").to_pylist()
        return {"digest": batch.column("digest"), "version": pa.array([version] * len(texts)), "n_tokens": pa.array(counter(tokenizer)(texts), pa.int64())}

    arrow_map(misses, fn, CACHE_SCHEMA, 64).write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    known = materialize(copies.select("digest", "n").join(counts, "digest"), "known")
    discard(copies)
    met = spread_join(digests, known, ["digest"], "n", F.xxhash64("k"), seen["total"] or 0)
    return met.select(F.col("k").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, empty at first: each run counts all it says."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{scratch_dir(spark)}/specloom/counts-{uuid.uuid4().hex}")
