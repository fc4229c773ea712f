"""Hourly totals of events, kept up by a stream with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.sources.lake import is_file, scratch


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Totals by type and hour; an hour closes when the watermark passes it."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def hourly_rollup(spark: SparkSession, path: str) -> DataFrame:
    """Reads what is at the path as a stream, upserts each batch's totals in a table, and returns the last of each hour."""
    # a table may be one file, read from its folder by name, or a folder of files
    folder, name = path.rstrip("/").rsplit("/", 1)
    one = is_file(spark, path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", name if one else "*.parquet").parquet(folder if one else path)
    out, state = scratch(spark, "rollup"), scratch(spark, "rollup-state")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    query = hourly(stream).writeStream.outputMode("update").option("checkpointLocation", state).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    newest = F.max_by(F.struct("n", "total"), "batch").alias("x")
    rows = spark.read.parquet(out).groupBy("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hora")).agg(newest)
    return rows.select("event_type", "hora", F.col("x.n").alias("n"), F.round("x.total", 4).alias("total"))
