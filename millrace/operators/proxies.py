"""Proxy statistics, ranking, sanity and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.crawl import sanity


def proxy_stats(requests: DataFrame) -> DataFrame:
    """Per proxy, from (proxy, ok, ms): gets, faults, their ratio (0 without any), and mean times by whole division (0 without any)."""
    good, bad = F.count_if("ok"), F.count_if(~F.col("ok"))
    good_ms, bad_ms = (F.coalesce(F.sum(F.when(c, F.col("ms"))), F.lit(0)) for c in (F.col("ok"), ~F.col("ok")))
    mean = lambda total, n: F.when(n == 0, F.lit(0)).otherwise(F.floor(total / F.greatest(n, F.lit(1)))).cast("bigint")
    return requests.groupBy("proxy").agg(
        good.alias("gets"), bad.alias("faults"), F.when(good + bad == 0, F.lit(0.0)).otherwise(bad / F.greatest(good + bad, F.lit(1))).alias("fault_ratio"),
        mean(good_ms, good).alias("mean_ok_ms"), mean(bad_ms, bad).alias("mean_fault_ms"), mean(good_ms + bad_ms, good + bad).alias("mean_ms"),
    )


def fastest_first(stats: DataFrame) -> list[Column]:
    """Sort keys: proxies never tried, then by mean time, weighted down by use and up by faults."""
    tried = (F.col("gets") > 0) | (F.col("faults") > 0)
    score = (F.col("mean_ok_ms") / F.log10(F.col("gets") + 9) * (1 + F.col("faults") / 2)).cast("float")
    return [tried.asc(), score.asc(), F.col("proxy").asc()]


def least_loaded(stats: DataFrame) -> list[Column]:
    return [(F.col("gets") + 50 * F.col("faults")).asc(), F.col("proxy").asc()]


def ranked(stats: DataFrame, keys: list[Column], group: str) -> DataFrame:
    """``stats`` with the place of each proxy in the order of ``keys`` within its group."""
    return stats.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*keys)))


def checkout(stats: DataFrame, keys: list[Column]) -> DataFrame:
    """The best proxy whose latency is not negative."""
    return stats.where("latency >= 0").orderBy(*keys).limit(1)


def fast_enough(measured: DataFrame, limit_ms: int) -> DataFrame:
    """Proxies with a last-byte latency above zero and below the limit that are not insane."""
    return measured.where((F.col("latency") > 0) & (F.col("latency") < limit_ms) & ~F.col("insane"))


def judged(pages: DataFrame, sane: list[str], insane: list[str], limit_ms: int) -> DataFrame:
    """Adds ``insane`` and replaces ``latency`` by limit + 1 for answers other than 200."""
    bad = sanity(F.coalesce("html", F.lit("")), sane, insane) != "ok"
    return pages.withColumn("insane", bad).withColumn("latency", F.when(F.coalesce(F.col("status") == 200, F.lit(False)), F.col("latency")).otherwise(F.lit(limit_ms + 1)))


def scraped(nodes: DataFrame, codes: dict[str, str]) -> DataFrame:
    """Distinct ``ip:port`` from scraped (ip, port) texts; ports written in the code's signs are translated, blanks dropped."""
    port = F.trim("port")
    for sign, digit in codes.items():
        port = F.replace(port, F.lit(sign), F.lit(digit))
    out = nodes.select(F.trim("ip").alias("ip"), port.alias("port")).where("ip <> '' and port rlike '^[0-9]+$'")
    return out.select(F.concat_ws(":", "ip", "port").alias("address")).distinct()
