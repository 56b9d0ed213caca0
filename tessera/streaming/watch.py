"""Watching a folder: new files as a stream, changed and deleted ones by listings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest
from ..sources import store

REMEMBERED = "30 days"
FILE = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """A stream of files with their bytes; each path comes once."""
    return spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def keyed(files: DataFrame) -> DataFrame:
    """path, size and digest of a stream of files, each content once. What was seen is forgotten after REMEMBERED of file time, so state has an end."""
    timed = files.withWatermark("modificationTime", REMEMBERED)
    rows = timed.select("modificationTime", "path", F.col("length").alias("size"), F.sha1(F.substring("content", 1, 1 << 20)).alias("digest"))
    return rows.dropDuplicatesWithinWatermark(["path", "size", "digest"]).select("path", "size", "digest")


def watch(spark: SparkSession, path: str, handle: Callable[[DataFrame], None], failed: str, checkpoint: str, every: str = "5 seconds") -> StreamingQuery:
    """Hands every batch of new files to `handle`; batches that it fails on are listed in the table `failed` for a later try."""

    def run(batch: DataFrame, number: int) -> None:
        try:
            handle(batch)
        except Exception as e:  # one bad batch must not end the watch; it is listed and the error kept
            batch.select("path", F.lit(number).alias("batch"), F.lit(str(e)[:500]).alias("error")).write.mode("append").parquet(failed)

    return new_files(spark, path).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def changes(spark: SparkSession, path: str, before: DataFrame) -> DataFrame:
    """path, change against an earlier listing; a file source does not see rewritten files, a listing does."""
    return ingest.changed_files(before, store.listing(store.read_files(spark, path)))
