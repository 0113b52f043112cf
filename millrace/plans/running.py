"""Row numbers and running sums over a whole table without gathering it in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.lineage import cut


def running(df: DataFrame, order: list[Column], number: str, sums: dict[str, Column] | None = None, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """``df`` with ``number``, a row's place from 0 in the order of ``order``, and ``sums``: name -> what is added up, the row's own included.

    Rows are dealt by ranges of the order and counted in each; only one row a partition is summed in one place.
    ``keep`` fixes the dealt rows, since the ranges come from a sample. Rows equal in the order have any order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    taken = {c.lower() for c in df.columns}
    part, own = "part", "before"
    while part in taken:
        part += "_"
    while any(c.startswith(own) for c in taken):
        own += "_"
    dealt = keep(df.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()))
    added = {number: F.lit(1).cast("bigint")} | (sums or {})
    names = {name: f"{own}{i}" for i, name in enumerate(added)}
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    totals = dealt.groupBy(part).agg(*(F.sum(c).alias(names[n]) for n, c in added.items()))
    before = totals.select(F.col(part).alias(own), *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in names.values()))
    out = dealt.withColumns({name: F.sum(c).over(inside) for name, c in added.items()})
    out = out.join(F.broadcast(before), F.col(part) == F.col(own))  # as many rows as shuffle partitions
    kept = [F.col(f"`{c}`") for c in df.columns if c not in added]
    return out.select(*kept, *(((F.col(n) + F.col(c)) - (1 if n == number else 0)).alias(n) for n, c in names.items()))
