"""Text files as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def numbered(df: DataFrame, name: str = "line") -> DataFrame:
    """df with consecutive numbers from 1 in file order. Only one count per partition is gathered; the rows stay where they are."""
    at = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    counts = at.groupBy("_part").agg((F.max("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("n")).orderBy("_part").collect()
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts or [(0, 0)], "_part long, _start long"))
    return at.join(offsets, "_part").withColumn(name, F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_id", "_start")


def read_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(line, value): line ends LF or CRLF; one empty last line is no line, others are."""
    text = spark.read.option("lineSep", "\n").option("encoding", encoding).text(path)
    return numbered(text.select(F.regexp_replace("value", "\r$", "").alias("value"))).select("line", "value")
