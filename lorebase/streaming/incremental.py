"""Stages on streams of newly landed files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorebase.tables import schema


def landed(spark: SparkSession, folder: str, table: str, files_per_batch: int = 100) -> DataFrame:
    """Rows of Parquet files as they appear in a folder."""
    return spark.readStream.schema(schema(table)).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def first_seen(stream: DataFrame, key: str = "arxiv_id", moment: str = "created_at", late: str = "7 days") -> DataFrame:
    """The first row of each key; state older than the watermark is forgotten, so the state stays
    as large as what may still come late."""
    timed = stream.withColumn(moment, F.col(moment).cast("timestamp"))
    return timed.withWatermark(moment, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, moment: str, key: str, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Rows per key and time window, in windows that close once the watermark has passed."""
    timed = stream.withColumn(moment, F.col(moment).cast("timestamp")).withWatermark(moment, late)
    return timed.groupBy(F.window(moment, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def run_stage(stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Calls a stage with each micro-batch. A batch may come again after a failure, with the same
    number: the stage must be an upsert, or use the number as its run."""
    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def orphans_on_arrival(spark: SparkSession, folder: str, table: str, parents: Callable[[], DataFrame], removed: Callable[[], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Reports references of each batch that name no known paper, against the tables as they are
    when the batch runs; a batch that is repeated overwrites its own report."""
    from lorebase.operators.references import orphan_references

    def process(batch: DataFrame, number: int) -> None:
        cases = orphan_references({table: batch}, parents(), removed())
        cases.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return run_stage(landed(spark, folder, table), process, checkpoint)
