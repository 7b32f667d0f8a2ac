"""Counts of an append-only event table as it grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arqueo.session import new_path


def hourly_counts(spark: SparkSession, path: str, files_per_trigger: int = 8, late: str = "30 days") -> DataFrame:
    """window_start, event_type, n and total of all events that are there now, by a stream that stops when it has read them.

    State is one row for each hour and type, kept until ``late`` after the newest event seen; an event that arrives later than that counts no more. Updates go to a table in the shared folder, batch by batch; the last update of each
    window is its result, so a batch that runs again after a failure changes nothing.
    """
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path + "*").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    counts = events.groupBy(F.window("at", "1 hour")["start"].alias("start"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    out = new_path(spark, "stream")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    run = counts.writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").foreachBatch(save).trigger(availableNow=True).start()
    run.awaitTermination()
    x = spark.read.schema("start timestamp, event_type string, n bigint, total double, batch_id bigint").parquet(f"{out}/data/*")
    x = x.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch_id").alias("r"))
    return x.select(F.date_format("start", "yyyy-MM-dd HH:00").alias("window_start"), "event_type", F.col("r.n").alias("n"), F.round("r.total", 4).alias("total"))
