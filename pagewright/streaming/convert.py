"""Conversion of files as they arrive, and session windows over transcript segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.sources.convert import convert


def watch_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """A stream of doc_key, path, content of new files below a folder."""
    r = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true")
    df = (r.option("pathGlobFilter", glob) if glob else r).load(path)
    return df.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("doc_key"), "path", "content")


def convert_stream(documents: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes the converted pages as Parquet. The checkpoint makes each file count once."""
    w = convert(documents).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()


def windowed_counts(events: DataFrame, time: str, by: list[str], window: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts by time window; events later than late behind the newest are dropped once their window has been given."""
    span = F.window(time, window, slide) if slide else F.window(time, window)
    g = events.withWatermark(time, late).groupBy(span.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def sessions(events: DataFrame, time: str, by: list[str], gap: str, late: str) -> DataFrame:
    """Counts by session: events of a key less than gap apart."""
    g = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")
