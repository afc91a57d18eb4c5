"""Arrival streams: blocks of arriving files, each content once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.operators import blocks as B


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """Arriving files below a folder, as (path, size, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.col("length").alias("size"), "content")


def new_contents(files: DataFrame, block_size: int, ts: str | None = None, within: str = "1 day") -> DataFrame:
    """Blocks whose content has not arrived before.

    Without ``ts`` the state keeps every distinct fingerprint.  With it, the column of arrival times, a fingerprint is forgotten
    once the watermark is ``within`` past it, so the state is bounded by what arrives in that time; later repeats count as new.
    """
    prints = B.split_blocks(files, block_size).withColumn("content_sha256", F.sha2("data", 256))
    if ts is None:
        return prints.dropDuplicates(["content_sha256"])
    return _timed(prints, ts).withWatermark(ts, within).dropDuplicatesWithinWatermark(["content_sha256"])


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process all that has arrived, append it to a Parquet table, and stop; restarts go on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _timed(stream: DataFrame, ts: str) -> DataFrame:
    """A stream whose time column can carry a watermark: Spark takes none on times without a zone, so these are read in the session's."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed_arrivals(events: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Arrivals per window and type, with late data up to the watermark; works on streams and on tables.

    ``window_start`` has the type of ``ts``.
    """
    e = _timed(events, ts).withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast(events.schema[ts].dataType).alias("window_start"), "event_type", "n")
