"""Record exploration: lookups, free-text search, sorting, statistics, updates and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.textfilter import matches

_INDEXED = (T.IntegerType, T.LongType, T.StringType)


def cell_text(df: DataFrame, name: str) -> Column:
    """A value as shown: null is empty, an array ``{a, b}``, all else its text."""
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return F.coalesce(F.concat(F.lit("{"), F.array_join(F.col(name).cast("array<string>"), ", ", "null"), F.lit("}")), F.lit(""))
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lookup(df: DataFrame, column: str, key: str) -> DataFrame:
    """Rows whose column equals the key.

    For int, bigint and string columns the key is read as that type and the comparison reaches the scan; a key
    that cannot be read finds nothing. Other columns are compared by their text. Null never matches.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, _INDEXED):
        if not isinstance(kind, T.StringType):
            try:
                number = int(key)
            except (TypeError, ValueError):
                return df.where(F.lit(False))
            bits = 31 if isinstance(kind, T.IntegerType) else 63
            if not -(1 << bits) <= number < 1 << bits:
                return df.where(F.lit(False))
            return df.where(F.col(column) == F.lit(number).cast(kind))
        return df.where(F.col(column) == F.lit(key))
    return df.where(F.col(column).cast("string") == F.lit(key))


def lookup_keys(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose column equals one of a table of keys; rows are not multiplied by repeated keys."""
    return df.join(keys.select(F.col(keys.columns[0]).alias(column)), column, "left_semi")


def search(df: DataFrame, filter_text: str, columns: list[str] | None = None) -> DataFrame:
    """Rows whose cells, each after a blank, pass the filter; null cells are left out."""
    shown = [F.when(F.col(c).isNotNull(), F.concat(F.lit(" "), cell_text(df, c))) for c in columns or df.columns]
    return df.where(matches(F.concat_ws("", *shown), filter_text))


def sort_by(df: DataFrame, column: str, ascending: bool = True, ignore_case: bool = False) -> DataFrame:
    """Order by one column, null the smallest; types without an order are refused."""
    if isinstance(df.schema[column].dataType, (T.MapType, T.VariantType)):
        raise ValueError(f"{column} has no order")
    by = F.lower(column) if ignore_case else F.col(column)
    return df.orderBy(by.asc_nulls_first() if ascending else by.desc_nulls_last())


def sort_keys(df: DataFrame, *keys: tuple[str, bool, bool]) -> DataFrame:
    """Order by several columns, each (name, ascending, ignore case); null the smallest."""
    order = []
    for name, ascending, ignore_case in keys:
        by = F.lower(name) if ignore_case else F.col(name)
        order.append(by.asc_nulls_first() if ascending else by.desc_nulls_last())
    return df.orderBy(*order)


def dump_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n_rows, size): the number of records, and how many bytes their cells and separators take as text."""
    line = F.concat_ws("\t", *[cell_text(df, c) for c in columns])
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.octet_length(line) + 1), F.lit(0)).alias("bytes")).select("n_rows", size_text(F.col("bytes")).alias("size"))


def size_text(n: Column) -> Column:
    """A number of bytes with its unit; the next unit takes over at half of it, by whole division."""
    kb, mb, gb = 1024, 1024**2, 1024**3
    number = lambda unit, name: F.concat((F.floor(n / unit)).cast("string"), F.lit(name))
    return F.when(n > gb // 2, number(gb, " GB")).when(n > mb // 2, number(mb, " MB")).when(n > kb // 2, number(kb, " kB")).otherwise(number(1, " B"))


def update_cell(df: DataFrame, row: Column, column: str, text: str) -> DataFrame:
    """``df`` with one cell set from text read as the column's type; a text that cannot be read raises when run."""
    return df.withColumn(column, F.when(row, F.lit(text).cast(df.schema[column].dataType)).otherwise(F.col(column)))


def delete_rows(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return df.join(rows.select(key).distinct(), key, "left_anti")


def contains_token(text: Column, token: str, separator: str) -> Column:
    """Whether ``token`` stands in ``text`` between separators or the ends."""
    sep = F.lit(separator)
    return F.concat(sep, text, sep).contains(f"{separator}{token}{separator}")
