"""Daily store of metric records: Parquet partitioned by day."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "t bigint, data array<bigint>, day string"


def day_key(ms) -> F.Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def append_stats(records: DataFrame, path: str) -> None:
    """Add records (t in ms, data) to the files of their days."""
    records.select("t", "data", day_key(F.col("t")).alias("day")).write.mode("append").partitionBy("day").parquet(path)


def append_startup_marker(spark: SparkSession, path: str, now_ms: int) -> None:
    append_stats(spark.createDataFrame([(now_ms, None)], "t bigint, data array<bigint>"), path)


def read_stats(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """Records of a day, or of all; a store that is not there yet is empty, unreadable files are passed over."""
    try:
        df = spark.read.schema(SCHEMA).option("ignoreCorruptFiles", "true").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df = spark.createDataFrame([], SCHEMA)
    return df.where(F.col("day") == day) if day else df


def stat_days(spark: SparkSession, path: str) -> DataFrame:
    """The days of the store, latest first."""
    return read_stats(spark, path).select("day").distinct().orderBy(F.desc("day"))
