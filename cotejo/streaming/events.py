"""Per-signature totals over a growing event log, kept up to date as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.operators.usage import EVENT_COLUMNS, event_table


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    schema = ", ".join(f"{c} string" for c in EVENT_COLUMNS)
    return event_table(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("mode", "DROPMALFORMED").json(path))


def running_totals(events: DataFrame) -> DataFrame:
    """signature, used, corrected: for an update-mode sink."""
    return events.groupBy(F.col("firma_archivos").alias("signature")).agg(F.count(F.lit(1)).alias("used"), F.count_if(F.coalesce(F.col("corregida").cast("boolean"), F.lit(False))).alias("corrected"))


def windowed_totals(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """origin totals by event-time window; rows later than `late` are left out and their state is dropped."""
    at = events.withColumn("at", F.col("created_at").cast("timestamp")).withWatermark("at", late)
    return at.groupBy(F.window("at", width), F.col("origen").alias("origin")).agg(F.count(F.lit(1)).alias("runs"), F.sum("tokens_ia").alias("tokens"))
