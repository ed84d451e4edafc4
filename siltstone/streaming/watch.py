"""Watch a folder of packages: each micro-batch of new files becomes one committed batch of findings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.sources.packages import from_table


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, scan: Callable[[DataFrame], DataFrame], once: bool = True) -> StreamingQuery:
    """Scan the skill_file rows of parquet files as they arrive.

    A micro-batch writes under its own id and overwrites what a lost attempt
    left there, so restarts neither skip nor repeat rows.
    """
    schema = "file_id long, skill_name string, path string, content string"

    def batch(df: DataFrame, number: int) -> None:
        scan(from_table(df)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    w = spark.readStream.schema(schema).parquet(folder).writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (w.trigger(availableNow=True) if once else w).start()


def event_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts in event-time windows with a watermark; runs on streams and on tables."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
