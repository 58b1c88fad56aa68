"""Shared pieces of the corpus operators: scratch tables, byte-level words, vectorised word hashes.

Every operator selects the columns it needs under names of its own, so further columns of a
table, whatever they are called, never meet its own ones. Texts travel as binary columns: Python
sees UTF-8 bytes without decoding them.
"""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of text that the vectorised code handles at once.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch between Spark and a Python worker: Spark's own default of 64 MB, held several times over on
#: either side and in each running task, is most of what an executor has beside its heap.
BATCH_BYTES = 4 << 20
#: Keys that may hold more than one in so many rows are fewer than this number, whatever the data.
HEAVY = 1000

_M64 = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a session whose executors run in the driver's own process gets a temporary folder; on any other
    one a folder of one machine would lose the data, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        found = os.path.join(tempfile.gettempdir(), f"specloom-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/specloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._specloom_path = path
    return out


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """materialize(), and aggregates of the rows that are taken while they are written."""
    seen = Observation()
    out = materialize(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), name)
    return out, seen.get


def discard(*tables: DataFrame) -> None:
    """Remove tables of materialize() that no later plan reads."""
    for df in tables:
        path = getattr(df, "_specloom_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_bytes(col: str | Column = "text") -> Column:
    """UTF-8 bytes of a text; null counts as the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string").cast("binary"), F.lit(b""))


def fold_of(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text modulo folds; a null id has the text ''."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def has_repeated_ids(df: DataFrame, id_col: str) -> bool:
    """Whether two rows share an id: reads one column, shuffles partial counts."""
    return bool(df.groupBy(F.col(id_col)).count().where("count > 1").take(1))


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name like base that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, unless they are bounded lower: rows vary from none to many MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def trim() -> None:
    """Give what a worker process no longer uses back to the system: workers stay for the executor's next tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow in batches of bounded bytes; a worker gives its memory back at the end of a task."""
    small_batches(df.sparkSession)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return df.mapInArrow(whole, schema)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, rows: int = 1024) -> DataFrame:
    """map_batches over slices of at most `rows` rows; fn gives the columns of the output in schema's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                if out is not None and len(next(iter(out.values()))):
                    yield pa.RecordBatch.from_pydict(out)

    return map_batches(df, run, schema)


def by_shuffle(table: DataFrame) -> DataFrame:
    """table for a join with texts: both sides are sorted by the key at every size, so the plan of a small input is that of a large one.

    Spark estimates a written table by the bytes of its file; compressed digests or ids are many times that in memory, where
    a broadcast holds them whole.
    """
    return table.hint("merge")


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], count: str, deal: Column, total: int) -> DataFrame:
    """rows joined with table, which has one row a key; its column count says how many of all `total` rows hold the key.

    Keys of more than one in HEAVY rows would each bring their rows to one task. There are fewer than HEAVY of them, so
    their hashes go into the plan, which deals their rows over as many numbered parts (by `deal`, a hash of the row) as it
    takes to stay under that share; the table's row of such a key is copied to each part. The plan is the same whether
    or not there are heavy keys.
    """
    most = max(total // HEAVY, 64)
    key = F.xxhash64(*keys)
    heavy = table.where(F.col(count) > most).select(key.alias("h"), F.ceil(F.col(count) / most).cast("int").alias("n")).collect()  # fewer than HEAVY rows
    # by hash on either side alike, so a key that shares one with a heavy key is dealt as that is
    most_parts = {r.h: r.n for r in sorted(heavy, key=lambda r: r.n)}
    parts = F.lit(1)
    if most_parts:
        known = F.create_map(*[F.lit(x) for h, n in most_parts.items() for x in (h, n)])
        parts = F.when(key.isin(*most_parts), F.try_element_at(known, key)).otherwise(F.lit(1))
    dealt = rows.withColumn("_part_", F.pmod(deal, parts.cast("long")).cast("int"))
    copied = table.withColumn("_part_", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.join(copied, [*keys, "_part_"]).drop("_part_")


# --- vectorised words -------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint64) + 1
_LOWER[65:91] += 32
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _tables.get("p")
    if have is None or len(have) < n + 1:
        size = max(1 << 18, 1 << n.bit_length())
        for key, base in (("p", _P), ("i", _P_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            np.multiply.accumulate(a, out=a)
            _tables[key] = a
    return _tables["p"], _tables["i"]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place of a fresh array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def binary_slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about `limit` bytes; a longer row is a run of its own."""
    if pa.types.is_large_binary(col.type):
        col = col.cast(pa.binary())
    if not len(col):
        return
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
    a, n = 0, len(col)
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def _words_of_run(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of a run of bytes; off: where texts start in it."""
    n = len(data)
    solid = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[off] = True
    first[n] = True
    starts = np.flatnonzero(solid & (first[:n] | np.concatenate(([True], ~solid[:-1]))))
    ends = np.flatnonzero(solid & (first[1:] | np.concatenate((~solid[1:], [True])))) + 1
    p, inv = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOWER[data] * p[:n], out=total[1:])
    h = (total[ends] - total[starts]) * inv[starts]
    h += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix64(h), starts


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words [^\\x20\\x09-\\x0D]+ of several texts, and each text's first word (one more entry than texts).

    A very long text is read in runs of about SLICE_BYTES that end before a space.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    hashes, starts, a = [], [], 0
    while a < n:
        b = min(n, a + 2 * SLICE_BYTES)
        while b < n and not _SPACE[data[b]]:
            ahead = np.flatnonzero(_SPACE[data[b : b + SLICE_BYTES]])
            b = b + int(ahead[0]) if len(ahead) else min(n, b + SLICE_BYTES)
        own = off[np.searchsorted(off, a) : np.searchsorted(off, b, side="right")] - a
        h, at = _words_of_run(data[a:b], own)
        hashes.append(h)
        starts.append(at + a)
        a = b
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), off)


_SH = [np.uint64(pow(0xA0761D6478BD642F, k + 1, 1 << 64) | 1) for k in range(64)]


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's width-word shingles (fewer words: of the whole sequence), and each text's first one."""
    h, at = word_hashes(data, off)
    n = len(at) - 1
    count = np.diff(at)
    full = np.zeros(0, np.uint64)
    if len(h) >= width:
        full = h[: len(h) - width + 1] * _SH[0]
        for k in range(1, width):
            full += h[k : len(h) - width + 1 + k] * _SH[k]
        full = mix64(full)
    parts, sizes = [], np.zeros(n, np.int64)
    for i in range(n):
        a, c = int(at[i]), int(count[i])
        if c >= width:
            x = np.sort(full[a : a + c - width + 1])
            if len(x) > 1:
                keep = np.empty(len(x), bool)
                keep[0] = True
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                x = x[keep]
        elif c:
            v = c
            for k in range(c):
                v = (v + int(h[a + k]) * int(_SH[k])) & _M64
            x = mix64(np.array([v ^ 0x5851F42D4C957F2D], np.uint64))
        else:
            continue
        parts.append(x)
        sizes[i] = len(x)
    first = np.zeros(n + 1, np.int64)
    np.cumsum(sizes, out=first[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), first
