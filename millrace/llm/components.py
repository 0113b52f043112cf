"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a minimum per node (combined before the shuffle) and a join of two written tables, so a
hub with any number of links is split by adaptive skew handling and nothing is gathered per group.
Edges go to the shared folder after each half step; the loop ends when a round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.storage import Work


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, work: Work, rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b bigint); root is the component's smallest node.

    Self links and repeated or reversed links are allowed; null ends are ignored; an empty table gives none.
    """
    lone = F.col("a") != F.col("b")
    now = work.keep(edges.where(lone).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _signature(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        past = [work.where["edges"]]
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = work.keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = work.keep(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        past += [work.where["low"], work.where["large"]]
        low = work.keep(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = work.keep(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        work.drop(*past, work.where["low"])
        then, seen = seen, _signature(now)
        if then == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
