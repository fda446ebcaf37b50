"""Extraction over arriving PDF files. Every stage is per page, so no state and no watermark are needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import PDF_GLOB
from ..sources.pdf import pages_of


def watch(spark: SparkSession, folder: str, checkpoint: str, each: Callable[[DataFrame, int], None], once: bool = False, max_files: int = 1000) -> StreamingQuery:
    """Hands the pages of newly arrived files to ``each`` (pages, batch number).

    ``each`` should write idempotently by batch number; then every file counts exactly once.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", PDF_GLOB).option("maxFilesPerTrigger", max_files).load(folder)
    writer = files.select("path", "content").writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: each(pages_of(df), n))
    return (writer.trigger(availableNow=True) if once else writer).start()


def progress(query: StreamingQuery) -> dict:
    """What a client polls: state, batches, rows of the last batch and its seconds."""
    last = query.lastProgress or {}
    return {"active": query.isActive, "batch": last.get("batchId", -1), "rows": last.get("numInputRows", 0), "seconds": sum((last.get("durationMs") or {}).values()) / 1000, "error": str(query.exception() or "") or None}


def running_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Windowed counts of a stream of outcomes (ts, kind); rows later than ``late`` are not waited for."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "kind").agg(F.count(F.lit(1)).alias("n"))
