"""Queries that run a stream over the events table to its end and return what it leaves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.registry import ORACLE, query, read
from quire.plans import activity_queries
from quire.storage import shared_dir
from quire.streaming import activity


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = read(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{d}/events.parquet*")


def _finish(df: DataFrame, mode: str) -> DataFrame:
    """Runs the stream over all that is there; each batch is written to shared storage once, under its number.

    In complete mode the last batch is the result, else all of them are. State and progress are in shared storage too.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire-stream-{uuid.uuid4().hex}"
    write = lambda rows, n: rows.write.mode("overwrite").parquet(f"{path}/rows/batch={n}")  # noqa: E731  a batch that is run again replaces itself
    q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(df.schema.add("batch", "long")).parquet(f"{path}/rows")
    if mode == "complete":
        rows = rows.where(F.col("batch") == (rows.agg(F.max("batch")).first()[0] or 0))
    return rows.drop("batch")


def stream_time_buckets(spark: SparkSession, d: str) -> DataFrame:
    e = _stream(spark, d).select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.floor(F.col("value") * 300).cast("bigint").alias("seconds"))
    return _finish(activity.buckets(e), "complete")


query(ORACLE["time_buckets"])(stream_time_buckets)


def stream_pace(spark: SparkSession, d: str) -> DataFrame:
    e = _stream(spark, d).select("user_id", "ts", "event_id", F.floor(F.col("value") * 40).cast("bigint").alias("x"))
    last = _finish(activity.pace(e), "update")
    return last.groupBy("user_id").agg(F.max_by("avg", "n").alias("pace"), F.max("n").alias("pages"))


query(ORACLE["pace_fold"])(stream_pace)


@query("select distinct user_id, ts::date as day from events")
def stream_day_sets(spark: SparkSession, d: str) -> DataFrame:
    return _finish(activity.day_sets(_stream(spark, d)), "append")


def stream_debounced(spark: SparkSession, d: str) -> DataFrame:
    """Positions saved by the debouncer (tests hold it against a loop)."""
    e = _stream(spark, d).select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("event_id") % 7).alias("position"))
    return _finish(activity.debounced(e), "append")


query()(stream_debounced)

assert activity_queries
