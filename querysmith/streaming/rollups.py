"""Roll-ups over streams of rewards and responses: the batch aggregations with event time and late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, schema: str, per_trigger: int = 64) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def windowed(stream: DataFrame, time: str, by: str, value: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Count, non-null count, exact sum, mean and deviation of a value in each window and group; windows close after the lateness.

    n, filled and total (a decimal) of windows add up, so means of longer spans come from merged, not from
    means of means. The same plan serves a batch frame, for which the watermark has no effect.
    """
    timed = stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    out = timed.groupBy(F.window("__t", width).alias("w"), F.col(by)).agg(
        F.count(F.lit(1)).alias("n"), F.count(value).alias("filled"), F.sum(F.col(value).cast("decimal(28,6)")).alias("total"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation")
    )
    return out.select(F.col("w.start").alias("start"), by, "n", "filled", "total", "mean", "deviation")


def merged(windows: DataFrame, by: str, digits: int = 4) -> DataFrame:
    """One row a group over all its windows: n and the mean of the non-null values, divided once."""
    out = windows.groupBy(by).agg(F.sum("n").alias("n"), F.sum("filled").alias("filled"), F.sum("total").alias("total"))
    return out.select(by, "n", F.round(F.col("total") / F.col("filled"), digits).cast("double").alias("mean"))


def drained(stream: DataFrame, out: str, state: str) -> None:
    """Run what has arrived, append closed windows to Parquet, and stop; the next call goes on from state."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
