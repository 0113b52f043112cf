"""Queries over metric series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import usage as U
from millrace.plans.lineage import scratch
from millrace.registry import query, table
from millrace.sources import records as R
from millrace.sources import stats as D

DAY = 86_400_000
_E = f"(SELECT ((epoch_us(ts) // 1000) // {DAY}) * {DAY} AS bucket, event_type AS metric, CAST(floor(value) AS BIGINT) AS value, user_id, event_id, ts FROM events)"
_P90, _P99 = ("list_sort(list(value))[CAST(floor(count(*) * CAST(%s AS DOUBLE)) AS BIGINT) + 1]" % p for p in ("0.9", "0.99"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(U.bucket(F.col("ts"), DAY).alias("bucket"), F.col("event_type").alias("metric"), F.floor("value").cast("bigint").alias("value"), "user_id", "event_id", "ts")


@query(f"SELECT bucket, metric, sum(value)::BIGINT AS sum_value, greatest(0, max(value)) AS max_value, {_P90} AS p90_value, {_P99} AS p99_value FROM {_E} GROUP BY 1, 2")
def usage_bucket_stats(spark, sf_dir):
    return U.bucket_stats(_samples(spark, sf_dir)).drop("n")


@query(f"SELECT metric, {_P90} AS p90_value, {_P99} AS p99_value FROM {_E} GROUP BY 1")
def usage_percentile_columns(spark, sf_dir):
    return _samples(spark, sf_dir).groupBy("metric").agg(U.aggregate("value", "Percentile90").alias("p90_value"), U.aggregate("value", "Percentile99").alias("p99_value"))


@query("SELECT ((epoch_us(ts) // 1000) // 60000) * 60000 AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def usage_minute_buckets(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(U.bucket(F.col("ts")).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _shards(spark, sf_dir, how, agg, n=2):
    s = _samples(spark, sf_dir).withColumn("shard", (F.col("user_id") % n).cast("int"))
    if agg is None:
        return U.bucket_stats(s, ("shard", "bucket", "metric")).withColumnRenamed("p90_value", "value").withColumn("how", F.lit(how))
    return s.groupBy("shard", "bucket", "metric").agg(agg.alias("value"), F.count("*").alias("n")).withColumn("how", F.lit(how))


@query(f"SELECT bucket, metric, sum(value)::BIGINT AS value FROM {_E} GROUP BY 1, 2")
def usage_merge_shards(spark, sf_dir):
    return U.merge_shards(_shards(spark, sf_dir, "Sum", F.sum("value")))


@query(f"SELECT bucket, metric, max(value) AS value FROM {_E} GROUP BY 1, 2")
def usage_merge_max(spark, sf_dir):
    return U.merge_shards(_shards(spark, sf_dir, "Max", F.max("value")))


@query(f"SELECT bucket, metric, sum(value)::BIGINT AS value FROM {_E} WHERE (user_id % 2 = 1 OR bucket % ({DAY} * 7) = 0) AND bucket <= (SELECT max(bucket) FROM {_E} WHERE user_id % 2 = 0 AND bucket % ({DAY} * 7) = 0) GROUP BY 1, 2")
def usage_merge_compat(spark, sf_dir):
    s = _shards(spark, sf_dir, "Sum", F.sum("value")).where((F.col("shard") == 1) | (F.col("bucket") % (DAY * 7) == 0))
    return U.merge_shards(s, compat=True)


@query(f"SELECT bucket, metric, CAST(floor(sum(p * n) / sum(n) + 0.5) AS BIGINT) AS value FROM (SELECT bucket, metric, user_id % 2 AS shard, CAST({_P90} AS DOUBLE) AS p, count(*) AS n FROM {_E} GROUP BY 1, 2, 3) GROUP BY 1, 2")
def usage_merge_weighted_p90(spark, sf_dir):
    return U.merge_shards(_shards(spark, sf_dir, "Percentile90", None).withColumn("weight", F.col("n").cast("double")))


@query(f"SELECT bucket, metric, list_reduce(list(p ORDER BY shard), lambda a, b: CAST(floor((a + b) / 2.0 + 0.5) AS BIGINT)) AS value FROM (SELECT bucket, metric, user_id % 3 AS shard, {_P90} AS p FROM {_E} GROUP BY 1, 2, 3) GROUP BY 1, 2")
def usage_merge_unweighted_p90(spark, sf_dir):
    return U.merge_shards(_shards(spark, sf_dir, "Percentile90", None, 3))


@query(f"SELECT bucket, CAST(floor(sum(value) / count(value) + 0.5) AS BIGINT) AS ratio FROM {_E} GROUP BY 1")
def usage_ratio_series(spark, sf_dir):
    return U.ratio_series(_samples(spark, sf_dir))


_TYPES = ["click", "view", "purchase", "signup", "error"]


@query(f"SELECT bucket, {', '.join(f'coalesce(sum(value) FILTER (metric = {chr(39)}{t}{chr(39)}), 0)::BIGINT AS {chr(34)}{t}{chr(34)}' for t in _TYPES)} FROM {_E} GROUP BY 1")
def usage_pivot(spark, sf_dir):
    return U.pivot_metrics(U.bucket_stats(_samples(spark, sf_dir)), _TYPES)


@query(f"SELECT metric, '[' || string_agg('[' || bucket || ',' || CASE WHEN value < 0 THEN value + 4294967296 ELSE value END || ']', ',' ORDER BY bucket) || ']' AS series FROM (SELECT bucket, metric, (sum(value) - 20000)::BIGINT AS value FROM {_E} GROUP BY 1, 2) GROUP BY 1")
def usage_series_json(spark, sf_dir):
    return U.series_json(U.bucket_stats(_samples(spark, sf_dir)).select("bucket", "metric", (F.col("sum_value") - 20000).alias("value")))


@query(f"SELECT metric, bucket, delta FROM (SELECT metric, bucket, total - lag(total) OVER (PARTITION BY metric ORDER BY bucket) AS delta FROM (SELECT metric, bucket, (sum(sum(value)) OVER (PARTITION BY metric ORDER BY bucket))::BIGINT AS total FROM {_E} GROUP BY metric, bucket)) WHERE delta IS NOT NULL")
def usage_counter_delta(spark, sf_dir):
    from pyspark.sql import Window

    days = _samples(spark, sf_dir).groupBy("metric", "bucket").agg(F.sum("value").alias("value"))
    total = days.withColumn("total", F.sum("value").over(Window.partitionBy("metric").orderBy("bucket")))
    return U.counter_delta(total, "metric", "bucket", "total").select("metric", "bucket", "delta")


@query(f"SELECT metric, sum(value)::BIGINT AS value FROM (SELECT metric, 1 AS value FROM {_E} UNION ALL SELECT metric || '_time', greatest(value - 20, 0) FROM {_E}) GROUP BY 1")
def usage_count_time_pairs(spark, sf_dir):
    s = _samples(spark, sf_dir).withColumnRenamed("metric", "kind").withColumnRenamed("value", "ms")
    return U.count_time_pairs(s, F.col("kind"), F.col("ms") - 20, F.concat("kind", F.lit("_time"))).groupBy("metric").agg(F.sum("value").alias("value"))


@query(f"SELECT request, metric, elapsed FROM (SELECT DISTINCT user_id AS request, metric FROM {_E}) JOIN (SELECT user_id AS request, max(value) AS elapsed FROM {_E} GROUP BY 1) USING (request)")
def usage_group_times(spark, sf_dir):
    s = _samples(spark, sf_dir).select(F.col("user_id").alias("request"), "metric", F.col("value").alias("elapsed"))
    return U.group_times(s, "request", "metric", "elapsed").select("request", "metric", "elapsed")


@query(f"SELECT m AS metric, count(*) AS n, sum(value)::BIGINT AS total FROM (SELECT CASE metric WHEN 'click' THEN 3 WHEN 'view' THEN 3 WHEN 'purchase' THEN 4 END AS m, value FROM {_E}) WHERE m IS NOT NULL GROUP BY 1")
def usage_id_mapping(spark, sf_dir):
    mapping = spark.createDataFrame([("click", 3), ("view", 3), ("purchase", 4)], "foreign string, metric int")
    return U.map_ids(_samples(spark, sf_dir), mapping).groupBy("metric").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def _records(spark, sf_dir):
    data = F.when(F.col("event_type") != "signup", F.array(F.col("event_id"), F.col("user_id")))
    return table(spark, sf_dir, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), data.alias("data"))


@query("SELECT event_type = 'signup' AS marker, count(*) AS n, max((epoch_us(ts) // 1000)) AS last FROM events GROUP BY 1")
def usage_markers(spark, sf_dir):
    data, markers = U.split_markers(_records(spark, sf_dir))
    return data.select(F.lit(False).alias("marker"), "t").unionByName(markers.select(F.lit(True).alias("marker"), "t")).groupBy("marker").agg(F.count("*").alias("n"), F.max("t").alias("last"))


@query("SELECT (epoch_us(ts) // 1000) AS t, event_id || ',' || user_id || ',0,0,0' AS padded FROM events WHERE event_type <> 'signup'")
def usage_zero_pad(spark, sf_dir):
    return U.split_markers(_records(spark, sf_dir))[0].select("t", F.array_join(U.zero_pad(F.col("data"), 5), ",").alias("padded"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, dense_rank() OVER (ORDER BY strftime(ts, '%Y-%m-%d') DESC) AS nth FROM events GROUP BY 1")
def usage_stat_days(spark, sf_dir):
    path = scratch(spark, "stats")
    D.append_stats(_records(spark, sf_dir), path)
    return R.positions(D.stat_days(spark, path)).select("day", (F.col("row_id") + 1).alias("nth"))


@query("SELECT epoch_us(ts) // 1000 AS t, event_id AS first FROM events WHERE strftime(ts, '%Y-%m-%d') = '2024-01-05' AND event_type <> 'signup'")
def usage_stat_day(spark, sf_dir):
    path = scratch(spark, "stats")
    D.append_stats(_records(spark, sf_dir), path)
    D.append_startup_marker(spark, path, 1_704_412_800_000)
    return U.split_markers(D.read_stats(spark, path, "2024-01-05"))[0].select("t", F.col("data")[0].alias("first"))
