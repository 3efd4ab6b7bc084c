"""Structured Streaming over an event table; each query also takes a static DataFrame, with equal final results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_stream(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def _marked(df: DataFrame, late: str) -> DataFrame:
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark is on a timestamp with time zone
    return df.withWatermark("ts", late) if df.isStreaming else df


def tumbling_counts(df: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    by = _marked(df, late).groupBy(F.window("ts", width), "event_type")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding_average(df: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    return _marked(df, late).groupBy(F.window("ts", width, step)).agg(F.avg("value").alias("mean"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "mean", "n")


def sessions(df: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return _marked(df, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(df: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return _marked(df, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All data that is there now, in a memory table."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def upsert_stream(df: DataFrame, sink, checkpoint: str):
    """Feed a keyed sink batch by batch."""
    return df.writeStream.foreachBatch(lambda rows, _: sink.load(rows)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
