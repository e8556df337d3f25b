"""Streams of documents. The formats have no streaming of their own; this is an extension over file sources.

A file is a whole document, so order-dependent state never spans micro-batches: each batch opens its files with the
batch operators. Counts over time use event-time windows with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.packages import open_documents

BINARY = "path string, modificationTime timestamp, length long, content binary"


def watch_documents(spark: SparkSession, folder: str, most_files: int = 1000, wanted: list[str] | None = None) -> DataFrame:
    """Records of documents as they arrive in a folder, at most `most_files` a batch; files of other formats are error records."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", most_files).option("recursiveFileLookup", "true").load(folder)
    return open_documents(files, wanted)


def arrivals(events: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """How many events of each kind fall in each window of event time; what is later than the watermark is dropped by
    the engine once its window is closed, and windows are final when they appear in append mode."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), kind, "n")


def append_to(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Appends a stream to Parquet, exactly once by its checkpoint; once=True stops when all that is there is done."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
