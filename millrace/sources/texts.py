"""Line-oriented sources: proxy lists, libsvm text, and whole files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_proxy_lines(lines: DataFrame) -> DataFrame:
    """(ip, port, refreshed): addresses with the list's refresh time; lines that are neither are dropped."""
    stamp = lines.where(F.col("value").startswith("lastRefreshTime=")).agg(F.max(F.expr("try_cast(substr(value, 17) as bigint)")).alias("refreshed"))
    rows = lines.where(~F.col("value").startswith("lastRefreshTime=")).select(F.regexp_extract("value", r"^([^:]+):", 1).alias("ip"), F.expr("try_cast(regexp_extract(value, '^[^:]+:([0-9]+)$', 1) as int)").alias("port"))
    return rows.where("ip <> '' and port is not null").distinct().join(F.broadcast(stamp))  # one row


def read_proxy_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_proxy_lines(spark.read.text(path))


def read_libsvm(spark: SparkSession, path: str, n_features: int | None = None) -> DataFrame:
    """(label, features); indexes 1.. of the file are 0.. of the vector."""
    reader = spark.read.format("libsvm")
    return (reader.option("numFeatures", str(n_features)) if n_features else reader).load(path)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(value): each file as one text with line ends ``\\n``."""
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\r\n?", "\n").alias("value"))
