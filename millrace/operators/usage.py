"""Time-bucketed metrics: long form (bucket, metric_id, value), one row per sample until aggregated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGGREGATIONS = ("Sum", "Max", "Percentile90", "Percentile99")


def bucket(ts: Column, resolution_ms: int = 60_000) -> Column:
    """Start of the bucket as milliseconds since the epoch."""
    return (F.unix_millis(ts.cast("timestamp")) / resolution_ms).cast("bigint") * resolution_ms


def index_percentile(value: str, share: float) -> Column:
    """The element at floor(n * share), counted from zero, of the values (SQL text) in ascending order.

    Counted from the other end that is the discrete percentile of 1 - share, which keeps a count for each
    different value, never the values themselves. Exact for values up to 2**53.
    """
    rest = f"{1 - share - 1e-12:.15f}D"  # a hair less, so that a product just above a whole number counts as that
    return F.expr(f"percentile_disc({rest}) within group (order by cast({value} as bigint) desc)").cast("bigint")


def aggregate(value: str, how: str) -> Column:
    """An aggregation of ``value`` (a column or SQL text). Sums are 64 bit; a maximum is never below zero, since cells start there."""
    whole = F.expr(f"cast({value} as bigint)")
    if how == "Sum":
        return F.sum(whole)
    if how == "Max":
        return F.greatest(F.lit(0).cast("bigint"), F.max(whole))
    if how == "Percentile90":
        return index_percentile(value, 0.9)
    if how == "Percentile99":
        return index_percentile(value, 0.99)
    raise ValueError(f"unknown aggregation {how!r}; one of {AGGREGATIONS}")


def bucket_stats(samples: DataFrame, by: tuple[str, ...] = ("bucket", "metric")) -> DataFrame:
    """All four aggregations of (bucket, metric, value), and ``n``, the number of samples; ``by`` may name more columns.

    Samples are counted by value before anything is gathered, so a bucket costs its different values, not its
    samples, and percentiles are read off running counts.
    """
    counts = samples.where("value is not null").groupBy(*by, F.col("value").cast("bigint").alias("value")).agg(F.count("*").alias("c"))
    group = Window.partitionBy(*by)
    placed = counts.withColumn("upto", F.sum("c").over(group.orderBy("value"))).withColumn("n", F.sum("c").over(group))
    at = lambda share: F.min(F.when(F.col("upto") > F.floor(F.col("n") * F.expr(share + "D")), F.col("value")))
    return placed.groupBy(*by).agg(
        F.sum(F.col("value") * F.col("c")).alias("sum_value"), F.greatest(F.lit(0).cast("bigint"), F.max("value")).alias("max_value"), at("0.9").alias("p90_value"), at("0.99").alias("p99_value"), F.sum("c").alias("n")
    )


def merge_shards(shards: DataFrame, compat: bool = False, into: int = 0) -> DataFrame:
    """One row per (bucket, metric) from rows (shard, bucket, metric, how, value[, weight]).

    Sum adds, Max takes the largest, percentiles are averaged by weight and rounded half up; without a weight
    (null) they are folded pairwise in the order of shards. ``compat`` drops buckets after the last one of
    shard ``into``, as a merge does that walks its own keys only.
    """
    if compat:
        last = shards.where(F.col("shard") == into).agg(F.max("bucket").alias("last"))  # one row
        shards = shards.join(F.broadcast(last), F.col("bucket") <= F.col("last")).drop("last")
    if "weight" not in shards.columns:
        shards = shards.withColumn("weight", F.lit(None).cast("double"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("shard", F.col("value").cast("bigint").alias("v")))), lambda x: x["v"])
    pairwise = F.aggregate(ordered, F.lit(None).cast("bigint"), lambda a, v: F.when(a.isNull(), v).otherwise(F.floor((a + v) / 2 + 0.5)))
    weighted = F.floor(F.sum(F.col("value") * F.col("weight")) / F.sum("weight") + 0.5)
    merged = F.when(F.col("how") == "Sum", F.sum(F.col("value").cast("bigint"))).when(F.col("how") == "Max", F.max(F.col("value").cast("bigint"))).otherwise(F.coalesce(weighted, pairwise))
    return shards.groupBy("bucket", "metric", "how").agg(merged.alias("value")).select("bucket", "metric", "value")


def ratio_series(samples: DataFrame) -> DataFrame:
    """(bucket, ratio): sum over count rounded half up, 0 without any."""
    total, n = F.sum("value"), F.count("value")
    return samples.groupBy("bucket").agg(F.when(n == 0, F.lit(0)).otherwise(F.floor(total / n + 0.5)).cast("bigint").alias("ratio"))


def pivot_metrics(stats: DataFrame, metrics: list[str], value: str = "sum_value") -> DataFrame:
    """One row per bucket with a column for each metric, 0 where it has no value."""
    wide = stats.groupBy("bucket").pivot("metric", metrics).agg(F.first(value))
    return wide.select("bucket", *[F.coalesce(F.col(f"`{m}`"), F.lit(0)).alias(m) for m in metrics])


def series_json(series: DataFrame, offset_ms: int = 0) -> DataFrame:
    """(metric, series): ``[[time,value],...]`` by time; a negative value is read as an unsigned 32-bit number."""
    pair = F.array((F.col("bucket") + offset_ms).cast("bigint"), F.expr("value & 4294967295L"))
    return series.groupBy("metric").agg(F.to_json(F.sort_array(F.collect_list(pair))).alias("series"))


def counter_delta(counters: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Differences of a growing counter within each key; each key's first sample has none and is left out."""
    w = Window.partitionBy(key).orderBy(order)
    return counters.withColumn("delta", F.col(value) - F.lag(value).over(w)).where(F.col("delta").isNotNull())


def count_time_pairs(events: DataFrame, metric: Column, elapsed: Column, slave_of: Column) -> DataFrame:
    """Two samples for each event: 1 for its metric, the elapsed time (never below zero) for the metric's slave."""
    pair = F.array(F.struct(metric.alias("metric"), F.lit(1).cast("bigint").alias("value")), F.struct(slave_of.alias("metric"), F.greatest(elapsed, F.lit(0)).cast("bigint").alias("value")))
    return events.select("*", F.explode(pair).alias("m")).select(*events.columns, "m.metric", "m.value")


def group_times(measured: DataFrame, request: str, metric: str, elapsed: str) -> DataFrame:
    """(request, metric, elapsed): distinct metrics of a request share its one, longest time."""
    times = measured.groupBy(request).agg(F.max(elapsed).alias(elapsed))
    return measured.select(request, metric).distinct().join(times, request)


def map_ids(samples: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace ``metric`` by its target in ``mapping`` (foreign, metric); unmapped samples are left out."""
    return samples.withColumnRenamed("metric", "foreign").join(mapping, "foreign").drop("foreign")


def split_markers(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(data, startup markers) of records whose ``data`` array is null at a process start."""
    return records.where("data is not null"), records.where("data is null")


def zero_pad(data: Column, width: int) -> Column:
    """An array filled up to ``width`` with zeros."""
    return F.concat(data, F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.lit(width) - F.size(data), F.lit(0))))
