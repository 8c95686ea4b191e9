"""Structured Streaming over the event log: windowed counts and sessions with a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, d: str, name: str = "events") -> DataFrame:
    """The table as a stream; event times without a zone are read in the session's."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "7 days") -> DataFrame:
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "7 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def drain(df: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now; executors write the whole result table as Parquet, which is returned."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/result")

    q = df.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/progress")
    q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/result")
