"""Passes as a stream: each micro-batch of files goes through gates, so a repeated batch changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.fixed import EXTRACTOR_VERSION
from specloom.sources import archive


def file_stream(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """New files of a folder as (path, content, filename)."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select("path", "content", F.element_at(F.split("path", "/"), -1).alias("filename"))


def unseen(batch: DataFrame, known: DataFrame, key: str = "sha256") -> DataFrame:
    """Rows whose content isn't known, once each."""
    return batch.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def unread(revisions: DataFrame, version: str = EXTRACTOR_VERSION) -> DataFrame:
    """Revisions that this version of the extractor hasn't read."""
    return revisions.where(~F.col("extracted").eqNullSafe(F.lit(version)))


def archive_stream(files: DataFrame, store: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, interval: str | None = None):
    """Archive a stream of (content, filename); `then` gets the (sha256, path) of each batch and its number.

    Contents are keyed by their digest: a batch that comes again after a failure appends nothing. Without an interval
    the stream takes what there is and ends.
    """

    def batch(df: DataFrame, number: int) -> None:
        got = archive.store(df.select("content", "filename"), store)
        if then:
            then(got, number)

    w = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()


def windowed_changes(changes: DataFrame, at: str = "at", delay: str = "1 day", window: str = "1 day") -> DataFrame:
    """(window, type, n) of a stream of change entries; entries later than the delay are left out."""
    return changes.withWatermark(at, delay).groupBy(F.window(at, window).alias("window"), "type").agg(F.count("*").alias("n"))
