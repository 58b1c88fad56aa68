"""Archived files by content: a table (sha256, path, content) that holds each content once, and listings of folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.functions.text import safe_filename
from specloom.sources.tables import exists

SCHEMA = "sha256 string, path string, content binary"


def archive_path(sha256: Column, filename: Column) -> Column:
    return F.concat(F.lit("datasheets/"), F.substring(sha256, 1, 12), F.lit("/"), safe_filename(filename))


def is_pdf(content: Column) -> Column:
    """The content starts like a PDF, white space before it aside."""
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    return F.startswith(F.regexp_replace(head, r"^\s+", ""), F.lit("%PDF-"))


def store(new: DataFrame, archive: str) -> DataFrame:
    """Append what the archive lacks of new (content, filename) and return (sha256, path) of all of it.

    The first file name of a content is its path for good; storing again changes nothing.
    """
    spark = new.sparkSession
    keyed = new.select(F.sha2("content", 256).alias("sha256"), "content", "filename")
    have = spark.read.schema(SCHEMA).parquet(archive) if exists(spark, archive) else spark.createDataFrame([], SCHEMA)
    names = keyed.groupBy("sha256").agg(F.min("filename").alias("filename")).join(have.select("sha256"), "sha256", "left_anti")
    fresh = keyed.select("sha256", "content").dropDuplicates(["sha256"]).join(names, "sha256")
    fresh.select("sha256", archive_path(F.col("sha256"), F.col("filename")).alias("path"), "content").write.mode("append").parquet(archive)
    return spark.read.schema(SCHEMA).parquet(archive).select("sha256", "path").join(keyed.select("sha256").distinct(), "sha256", "left_semi")


def stored(spark: SparkSession, archive: str, digests: bool = False) -> DataFrame:
    """(path, sha256 or null) of the archive table; a content's digest is computed again where digests are asked for."""
    if not exists(spark, archive):
        return spark.createDataFrame([], "path string, sha256 string")
    have = spark.read.schema(SCHEMA).parquet(archive)
    return have.select("path", F.sha2("content", 256).alias("sha256") if digests else F.lit(None).cast("string").alias("sha256"))


def listing(spark: SparkSession, root: str, digests: bool = False) -> DataFrame:
    """(path relative to root, sha256 or null) of the files under root/datasheets; contents are read only for digests. No folder has none."""
    if not exists(spark, f"{root}/datasheets"):
        return spark.createDataFrame([], "path string, sha256 string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/datasheets")
    at = F.concat(F.lit("datasheets"), F.element_at(F.split("path", "/datasheets"), -1))
    return files.select(at.alias("path"), F.sha2("content", 256).alias("sha256") if digests else F.lit(None).cast("string").alias("sha256"))
