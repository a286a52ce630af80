"""Event-time jobs over a log of calls and a feed of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnway.session import scratch

# Fixed value: so many outages make a provider count as down.
OUTAGES_TO_OPEN = 3


def follow(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """The parquet files of one name as a stream; the schema comes from the files themselves."""
    files = spark.read.option("pathGlobFilter", name).parquet(folder)
    return (
        spark.readStream.schema(files.schema)
        .option("pathGlobFilter", name)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return what it wrote.

    Sink and progress lie in the shared folder, so a restarted run goes on where it stopped.
    """
    spark = stream.sparkSession
    out, progress = scratch(spark, "stream"), scratch(spark, "progress")
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", out)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def request_rates(events: DataFrame, key: str, limit: int, window: str = "60 seconds", late: str = "60 seconds") -> DataFrame:
    """Requests per key and window, with how many went over the limit."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), key).agg(
        F.count(F.lit(1)).alias("requests")
    )
    return counted.select(
        F.col("w.start").alias("window_start"), key, "requests",
        F.greatest(F.col("requests") - limit, F.lit(0).cast("long")).alias("over_limit"),
    )


def weather_rollups(readings: DataFrame, late: str = "1 hour") -> DataFrame:
    """Sums over sliding 24 hours per point, one window per hour; hours that come too late drop."""
    rolled = readings.withWatermark("ts", late).groupBy(
        F.window("ts", "24 hours", "1 hour").alias("w"), "point_id"
    ).agg(
        F.count(F.lit(1)).alias("readings"),
        F.sum("millis").alias("precipitation_millis"),
    )
    return rolled.select(F.col("w.end").alias("until"), "point_id", "readings", "precipitation_millis")


def query_sessions(events: DataFrame, key: str, gap: str = "5 minutes", late: str = "5 minutes") -> DataFrame:
    """Runs of the same search with no pause of the cache's lifetime; all but the first are saved."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(
        F.count(F.lit(1)).alias("searches"), F.approx_count_distinct("user_id").alias("about_users")
    )
    return s.select(
        F.col("w.start").alias("started"), key, "searches",
        (F.col("searches") - 1).alias("repeats_saved"), "about_users",
    )


def first_seen(rows: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Each identity once while its state is kept."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def outages(calls: DataFrame, window: str = "15 minutes", late: str = "60 seconds") -> DataFrame:
    """Calls, outages and refusals per provider and window, and whether the outages count as down.

    A refusal is an answer, so it is counted apart. All are partial aggregates, so a busy provider
    is no group of rows anywhere.
    """
    counted = calls.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "provider").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("outcome") == "outage").alias("outages"),
        F.count_if(F.col("outcome") == "refused").alias("refusals"),
    )
    return counted.select(
        F.col("w.start").alias("window_start"), "provider", "calls", "outages", "refusals",
        (F.col("outages") >= OUTAGES_TO_OPEN).alias("down"),
    )
