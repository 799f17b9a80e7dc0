"""Streaming forms over event tables: file source, watermark, deduplication, windows, claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they arrive; the checkpoint remembers which were claimed."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(events: DataFrame, key: list[str], at: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark: state is dropped when its time has passed."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def windowed_counts(events: DataFrame, at: str, by: list[str], length: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    w = F.window(at, length, slide) if slide else F.window(at, length)
    counts = events.withWatermark(at, late).groupBy(w, *by).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), *by, "n")


def sessions(events: DataFrame, key: str, at: str, gap: str, late: str = "1 day") -> DataFrame:
    counts = events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))
    return counts.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Work off what has arrived, then stop; a second run takes up only new files."""
    spark = stream.sparkSession
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def upsert_batches(stream: DataFrame, path: str, checkpoint: str, key: str, at: str) -> None:
    """foreachBatch sink that may see a batch twice: each batch is one folder, overwritten when
    repeated, and readers take the newest row of a key."""

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), at).alias("r")).select("r.*")
        newest.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def new_since(incoming: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not known yet: an incremental load that can be repeated."""
    return incoming.join(known.select(*key), key, "left_anti").dropDuplicates(key)


def requeued(jobs: DataFrame, now, minutes: int = 15, attempts: int = 3) -> DataFrame:
    """Jobs with ``next``: queued again when stuck, failed after so many attempts."""
    stuck = (F.col("status") == "running") & (F.col("started_at") < now - F.expr(f"INTERVAL {minutes} MINUTES"))
    return jobs.withColumn("next", F.when(stuck & (F.col("attempts") >= attempts), "failed").when(stuck, "queued").otherwise(F.col("status")))


def replayed(requests: DataFrame) -> DataFrame:
    """request_id, receipt of the first delivery, and whether a later one had another body."""
    return requests.groupBy("request_id").agg(F.min_by("receipt", "at").alias("receipt"), (F.count_distinct("body") > 1).alias("refused"))
