"""Windowed figures over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import scratch


def hourly_figures(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Count and mean per user and hour; events later than `late` are dropped once a watermark has passed them."""
    return events.withWatermark("ts", late).groupBy("user_id", F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")).select("user_id", F.col("window.start").alias("hour"), "n", "mean")


def run_to_table(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming query over all there is now, into files of the shared folder, and read them."""
    spark = df.sparkSession
    at = scratch(spark, "stream")
    q = df.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def partial_figures(stream: DataFrame, at: str) -> None:
    """Counts and sums per user and hour of each micro-batch, in a folder of its own; a batch that is run again replaces its folder.

    The query holds no state, so no event is too late, and the figures of any
    time are the sums over the batches so far.
    """

    def add(batch: DataFrame, number: int) -> None:
        per = batch.groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("values"), F.sum("value").alias("total"))
        per.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()


def hourly(spark: SparkSession, path: str) -> DataFrame:
    """Count and mean per user and hour of the events of a file, run as a stream; late events count, null values do not enter the mean."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rstrip("/").rsplit("/", 1)
    source = spark.readStream.schema(schema).option("pathGlobFilter", name if "." in name else "*")
    at = scratch(spark, "stream")
    # a timestamp without zone is read as the session's
    partial_figures(source.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")), at)
    kinds = f"user_id {schema['user_id'].dataType.simpleString()}, hour timestamp, n long, values long, total double, batch long"
    parts = spark.read.schema(kinds).parquet(f"{at}/out")
    return parts.groupBy("user_id", "hour").agg(F.sum("n").alias("n"), F.round(F.sum("total") / F.sum("values"), 6).alias("mean"))
