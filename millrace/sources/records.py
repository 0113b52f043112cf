"""Tables of records: opening, numbering, counting, repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans.lineage import cut
from millrace.plans.running import running


def open_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def positions(df: DataFrame) -> DataFrame:
    """``df`` with ``row_id``: the place of each row, from 0, in the order in which ``df`` yields them, a sorted one included.

    Rows are written once with their place in their partition; the partitions' sizes give the rest.
    """
    at = cut(df.withColumn("row_id", F.monotonically_increasing_id()))
    part = F.shiftright("row_id", 33)
    sizes = at.groupBy(part.alias("of")).agg(F.count("*").alias("n"))  # one row a partition
    before = sizes.select("of", (F.sum("n").over(Window.orderBy("of")) - F.col("n")).alias("before"))
    placed = at.join(F.broadcast(before), part == F.col("of"))
    return placed.withColumn("row_id", F.col("before") + F.col("row_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("of", "before")


def with_row_id(df: DataFrame, *order: str) -> DataFrame:
    """Number the rows from 0: over the whole table by one column, or within each first column by the remaining ones."""
    if not order:
        raise ValueError("name a column to order by")
    if len(order) == 1:
        return running(df, [F.col(order[0])], "row_id")
    return df.withColumn("row_id", F.row_number().over(Window.partitionBy(order[0]).orderBy(*order[1:])).cast("bigint") - 1)


def repair(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Copy what can be read of a damaged table to a new one, and return that; unreadable files are passed over.

    The schema is that of the first file that can be read.
    """
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    files = [str(f.getPath()) for f in root.getFileSystem(conf).listStatus(root) if f.getPath().getName().endswith(".parquet")]
    for f in sorted(files):
        try:
            schema = spark.read.parquet(f).schema
            break
        except Exception as e:  # noqa: BLE001  a damaged footer; any other trouble shows at the next file or below
            last = e
    else:
        raise ValueError(f"nothing readable in {source}") from (last if files else None)
    spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(source).write.parquet(target)
    return spark.read.parquet(target)
