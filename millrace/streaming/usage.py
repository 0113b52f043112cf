"""Bucketed metrics as a stream: event-time windows, late rows dropped by watermark, closed windows appended to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.usage import AGGREGATIONS, aggregate

NAMES = ("sum_value", "max_value", "p90_value", "p99_value")


def windowed(samples: DataFrame, width: str, late: str) -> DataFrame:
    """All four aggregations of a stream (ts, metric, value) by window; ``ts`` without a zone is taken as UTC."""
    out = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return out.groupBy(F.window("ts", width).alias("w"), "metric").agg(*[aggregate("value", a).alias(n) for a, n in zip(AGGREGATIONS, NAMES)])


def flat(stats: DataFrame) -> DataFrame:
    return stats.select(F.unix_millis("w.start").alias("bucket"), "metric", *NAMES)


def start(samples: DataFrame, out: str, checkpoint: str, width: str = "1 minute", late: str = "1 minute", listener=None, every: str | None = None):
    """A running query that appends closed windows to Parquet below ``out``; ``listener`` sees each batch.

    With ``every`` (a processing time such as "30 seconds") a batch is tried at that interval, so that windows
    close by and by while the source rests; else the query ends when the source has no more. Started again
    with the same folders it goes on where it was: a repeated batch replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = flat(batch)
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if listener:
            listener(rows, batch_id)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return windowed(samples, width, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(write).start()


def run_to_files(samples: DataFrame, out: str, checkpoint: str, width: str = "1 minute", late: str = "1 minute", listener=None):
    """``start`` without an interval, until the source has no more."""
    query = start(samples, out, checkpoint, width, late, listener)
    query.awaitTermination()
    return query


def closed(spark: SparkSession, out: str) -> DataFrame:
    """What the stream has closed so far."""
    return spark.read.parquet(out).select("bucket", "metric", *NAMES)


def flushed(spark: SparkSession, out: str, samples: DataFrame, width: str) -> DataFrame:
    """Closed windows from the files and, from the samples as a table, those that the stream still held open at its end."""
    done = closed(spark, out)
    whole = samples.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", width).alias("w"), "metric")
    rest = flat(whole.agg(*[aggregate("value", a).alias(n) for a, n in zip(AGGREGATIONS, NAMES)])).join(done.select("bucket", "metric"), ["bucket", "metric"], "left_anti")
    return done.unionByName(rest)
