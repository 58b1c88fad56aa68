"""The catalog's tables as JSON documents or Parquet: a missing table is empty, a write never leaves half a table."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.operators.relational import newest
from specloom.schemas import OWNED, TABLES


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def read_json(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A JSON array (or object) as rows of the table's schema; empty if the file is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], TABLES[table])
    return spark.read.schema(TABLES[table]).option("multiLine", True).json(path)


def load(spark: SparkSession, root: str, folder: str = "data") -> dict[str, DataFrame]:
    """All tables of a catalog, lazily: Parquet where it exists, else JSON. fields have ord, their place in the file."""
    out = {}
    for name in TABLES:
        own = read(spark, f"{root}/{folder}/{name}.parquet")
        out[name] = own if own is not None else read_json(spark, f"{root}/{folder}/{name}.json", name)
    for name in ("fields", "documents"):
        if "ord" not in out[name].columns:  # a multi-line file is one partition: ids follow its order
            out[name] = out[name].withColumn("ord", F.monotonically_increasing_id())
    return out


def swap_in(df: DataFrame, path: str) -> None:
    """Write df as the next version of the table at path; read() gives the newest version that is whole.

    A version is a folder of its own, whole when the writer has put its mark there, which is its last act: a reader
    sees the version before or this one, a crash leaves the one before. Older versions but one go, as a reader may
    still be at it.
    """
    spark = df.sparkSession
    old = versions(spark, path)
    df.write.parquet(f"{path}/{VERSION}{old[-1] + 1 if old else 1:012d}")
    fs, _ = _fs(spark, path)
    for n in old[:-1]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{VERSION}{n:012d}"), True)


VERSION = "version-"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the table's whole versions."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n.removeprefix(VERSION)) for n in names if n.startswith(VERSION) and exists(spark, f"{path}/{n}/_SUCCESS"))


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest whole version of a table of swap_in(), or plain Parquet at path; None if there is neither."""
    found = versions(spark, path)
    if found:
        return spark.read.parquet(f"{path}/{VERSION}{found[-1]:012d}")
    return spark.read.parquet(path) if exists(spark, f"{path}/_SUCCESS") else None


def save(tables: dict[str, DataFrame], root: str, folder: str = "data", include_status: bool = True) -> None:
    """Write the tables that the engine owns; suppliers and fields are never written. The change log keeps its newest rows."""
    for name in OWNED:
        if name in tables and (include_status or name != "status"):
            df = tables[name]
            if name == "changes":
                df = newest(df, "at")
            swap_in(df, f"{root}/{folder}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared scratch folder and read again: later plans start from there, lost executors cost nothing."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        # only where driver and executors are one process may the folder be one machine's
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), f"specloom-{os.getpid()}")
    path = f"{root}/specloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def append_changes(log: DataFrame, new: DataFrame) -> DataFrame:
    """The log with new entries; details that an entry doesn't have are null."""
    return log.unionByName(new, allowMissingColumns=True)
