"""What the trained operators share: the held-out fold and bounded, repeatable samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id's decimal text leaves 1 modulo 3; false for a null id, which is never learned from either."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learnable(doc_id: str = "doc_id") -> Column:
    return F.col(doc_id).isNotNull() & ~held_out(doc_id)


def bounded_sample(rows: DataFrame, key: str, most: dict | int, seed: int = 7, id_col: str = "doc_id") -> DataFrame:
    """About ``most`` rows of each value of ``key`` at most, chosen by a hash of the id; all rows of smaller values.

    The count of rows by key is the only thing gathered; there must be few keys (labels, languages).
    """
    counts = {r[0]: r[1] for r in rows.groupBy(key).count().collect()}
    keep = F.lit(False)
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    for value, n in sorted(counts.items(), key=str):
        limit = most if isinstance(most, int) else most.get(value, 0)
        keep = keep | ((F.col(key) == F.lit(value)) & (place < min(1.0, limit / n)))
    return rows.where(keep)
