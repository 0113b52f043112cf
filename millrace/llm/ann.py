"""Nearest neighbours by collision counting over single projections.

Rows are dealt into blocks by a hash of their id, queries too; a task holds one block of rows and one
of queries. In a block, inner-product search becomes Euclidean search by one more coordinate that
lifts every vector to the block's largest norm. Each of ``projections`` random directions keeps the
block's rows sorted; around a query's own projection a window grows by virtual rehashing, and a row
that lies in enough windows is verified with the exact inner product on the original vectors. Windows
grow until a row nearer than the k-th best found would, with a margin of ``sigmas`` standard
deviations, have collided often enough; so the share of rows verified follows the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import kernels as K
from millrace.llm.storage import Work, shuffle_partitions


class Block:
    """The sorted projections of some vectors, all of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int, threshold: float, seed: int):
        self.ids, self.vectors, self.m, self.threshold = ids, vectors, projections, threshold
        self.scale = 1.0 / float(np.abs(vectors).max())  # geometry is done on components of at most 1
        even = vectors * self.scale
        self.quick = even.astype(np.float32)
        norms = (even * even).sum(1)
        self.top = norms.max()
        lifted = np.hstack([even, np.sqrt(np.maximum(self.top - norms, 0))[:, None]])
        self.axes = np.random.default_rng(seed).standard_normal((lifted.shape[1], projections))
        self.order, self.sorted = np.empty((projections, len(ids)), np.int32), np.empty((projections, len(ids)), np.float32)
        for j in range(projections):  # one direction at a time: memory is eight bytes a row and direction
            at = (lifted @ self.axes[:, j]).astype(np.float32)
            self.order[j] = np.argsort(at, kind="stable")
            self.sorted[j] = at[self.order[j]]

    def first_window(self, queries: np.ndarray, k: int) -> float:
        """A half-width to start from: three quarters of the typical k-th distance, from a few queries and rows."""
        rows = self.vectors[:: max(1, len(self.vectors) // 512)] * self.scale
        some = queries[:: max(1, len(queries) // 32)]
        gaps = self.top + (some * some).sum(1)[:, None] - 2 * some @ rows.T
        part = max(0, min(rows.shape[0] - 1, k * len(rows) // len(self.vectors)))
        return 0.75 * sqrt(max(float(np.median(np.partition(gaps, part, axis=1)[:, part])), 1e-12 * max(self.top, 1e-300)))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, growth: float, sigmas: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(query row, ids, scores, rows verified) with the k best by (score, id)."""
        n, need = len(self.ids), max(1, int(np.ceil(self.threshold * self.m)))
        # a query's length does not change its order of rows; at the rows' largest norm distances differ most
        sizes = np.abs(queries).max(1)
        sizes = sizes * np.sqrt(((queries / sizes[:, None]) ** 2).sum(1) / self.top)
        even = queries / sizes[:, None]
        centre = np.hstack([even, np.zeros((len(queries), 1))]) @ self.axes
        start = self.first_window(even, k)
        for i, query in enumerate(queries):
            light, span, factor = even[i].astype(np.float32), float(even[i] @ even[i]), self.scale / sizes[i]
            count, seen = np.zeros(n, np.int64), np.zeros(n, bool)
            here = centre[i].tolist()
            rows, scores = np.zeros(0, np.int64), np.zeros(0)
            low = high = None
            half, checked, idle = start, 0, 0
            slack = 1e-5 * sqrt(self.top * span)  # far above what single precision loses
            while True:
                lo = [int(s.searchsorted(np.float32(c - half), "left")) for s, c in zip(self.sorted, here)]
                hi = [int(s.searchsorted(np.float32(c + half), "right")) for s, c in zip(self.sorted, here)]
                if low is None:
                    new = [o[a:b] for o, a, b in zip(self.order, lo, hi)]
                else:
                    new = [o[a:b] for o, a, b in zip(self.order, lo, low)] + [o[a:b] for o, a, b in zip(self.order, high, hi)]
                low, high = lo, hi
                count += np.bincount(np.concatenate(new), minlength=n)
                found = np.flatnonzero((count >= need) & ~seen)
                seen[found] = True
                checked += len(found)
                idle = 0 if len(found) else idle + 1
                grown = growth if idle < 8 else 2.0  # far from everything: hurry
                mine = self.ids[found] == query_ids[i]
                found = found[~mine]
                if len(rows) == k:  # by a quick product first: only what comes near the k-th best is summed in a fixed order
                    found = found[self.quick[found] @ light >= scores[-1] * factor - slack]
                rows = np.concatenate([rows, found])
                scores = np.concatenate([scores, (self.vectors[found] * query).sum(1)])
                best = np.lexsort((self.ids[rows], -scores))[:k]
                rows, scores = rows[best], scores[best]
                if checked == n:
                    break
                if len(rows) == k:
                    gap = sqrt(max(self.top + span - 2 * scores[-1] * factor, 1e-300))
                    p = erf(half / gap / sqrt(2))
                    if p - sigmas * sqrt(p * (1 - p) / self.m) >= self.threshold:
                        break
                half *= grown
            yield i, self.ids[rows], scores, checked


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = 65536, query_rows: int = 4096, projections: int = 64, threshold: float = 0.6, growth: float = 1.07, sigmas: float = 2.0, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows by inner product, in double precision.

    ``vectors`` and ``queries``: (vec_id, embedding); a query's own id is no candidate. Ties go to the smaller
    id; with fewer candidates than k all are returned. Rows with a null id, and vectors null, empty, zero or
    with null or non-finite components, take no part. An id stands for one vector: repeated rows count once, and of
    several vectors the smallest by components stands. Only vectors of equal length are compared. Extra columns are
    ignored whatever their names; empty tables give an empty result. Queries travel in blocks of ``query_rows``, or
    fewer where there are not yet as many pairs of blocks as cores; each such block meets every block of rows.
    """
    spark = vectors.sparkSession
    work = Work(spark, "ann")
    usable = F.expr("vec_id is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)")
    cast = [F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")]
    rows = work.keep(vectors.select(*cast).where(F.coalesce(usable, F.lit(False))), "vectors")
    asked = work.keep(queries.select(*cast).where(F.coalesce(usable, F.lit(False))), "queries")
    n_blocks, n_asking, cores = max(1, -(-rows.count() // block_rows)), asked.count(), spark.sparkContext.defaultParallelism
    n_asked = max(1, -(-n_asking // query_rows), min(-(-n_asking // 64), -(-cores // n_blocks)))
    hashed = F.xxhash64(F.lit(seed), "vec_id")
    data = rows.select(F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))).alias("q"), F.pmod(hashed, F.lit(n_blocks)).alias("b"), F.lit(0).alias("asks"), "vec_id", "embedding")
    ask = asked.select(F.pmod(hashed, F.lit(n_asked)).cast("int").alias("q"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))).alias("b"), F.lit(1).alias("asks"), "vec_id", "embedding")
    both = data.unionByName(ask).select((F.col("q") * F.lit(n_blocks) + F.col("b")).cast("bigint").alias("pair"), "asks", "vec_id", "embedding")

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """The rows of one pair of blocks at a time; they arrive sorted by pair."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            pair = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(pair)) + 1).tolist(), len(pair)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if held and held[0].column(0)[0].as_py() != pair[a]:
                        yield pa.Table.from_batches(held)
                        held = []
                    held.append(batch.slice(a, b - a))
        if held:
            yield pa.Table.from_batches(held)

    def parts(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """ids and matrix by vector length; the first row of an id stands."""
        ids = t.column("vec_id").to_numpy()
        lists = t.column("embedding").combine_chunks()
        lengths = lists.value_lengths().to_numpy()
        first = np.sort(np.unique(ids, return_index=True)[1])
        out = {}
        for d in np.unique(lengths[first]) if len(ids) else []:
            of = first[lengths[first] == d]
            flat = lists.take(pa.array(of)).flatten().to_numpy()
            out[int(d)] = (ids[of], flat.reshape(-1, int(d)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches):
            asks = t.column("asks").to_numpy()
            have, want = parts(t.filter(pa.array(asks == 0))), parts(t.filter(pa.array(asks == 1)))
            for d in sorted(have.keys() & want.keys()):
                block = Block(*have[d], projections, threshold, seed)
                for i, ids, scores, _ in block.search(*want[d], k, growth, sigmas):
                    if len(ids):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), want[d][0][i])), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])
        K.release()

    pairs = n_blocks * n_asked
    tasks = min(pairs, max(shuffle_partitions(spark), 8 * cores))
    dealt = both.repartitionById(tasks, F.pmod("pair", F.lit(tasks)).cast("int")).sortWithinPartitions("pair", "asks", "vec_id", "embedding")
    found = dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= int(k)).select("query_id", "rank", "vec_id", "score")


def nearest_every(vectors: DataFrame, every: int = 20, **options) -> DataFrame:
    """``nearest`` with the rows whose id is divisible by ``every`` as queries."""
    return nearest(vectors, vectors.where(F.col("vec_id") % every == 0), **options)
