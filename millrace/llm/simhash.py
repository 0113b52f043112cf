"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most 2h bits apart have a value within h bits of both. Every distinct fingerprint
emits all values of its ball of radius h; those that meet at a value are within 2h of each other by the
triangle inequality, so a bucket yields a star of links, never its pairs. The shuffle is on the leading
bits of the emitted value: one row stands for all variants of a fingerprint that share those bits, and
the remaining bits are varied inside the task. Rows per task follow from the number of fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernels as K
from millrace.llm.components import components
from millrace.llm.storage import Work, fresh, shuffle_partitions

#: fingerprint rows that one prefix should hold at most on average, for choosing the prefix length
PREFIX_LOAD = 1 << 18
#: variants generated at a time inside a task
VARIANTS_AT_ONCE = 1 << 22


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> bytes:
    """Eight bytes, most significant first; eight zero bytes for a text without words."""
    words = text.lower().split()  # bytes.lower is A-Z only and bytes.split breaks at ASCII white space only
    n = len(words)
    if not n:
        return bytes(8)
    digest = xxhash.xxh64_digest
    joined = b" ".join(words)
    if n <= shingle:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.zeros(n, np.int64)
    starts[1:] = ends[:-1] + 1
    total, counts = n - shingle + 1, np.zeros(64, np.int64)
    starts, ends = starts[:total].tolist(), ends[shingle - 1 :].tolist()
    for i in range(0, total, 1 << 16):
        raw = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[i : i + (1 << 16)], ends[i : i + (1 << 16)])])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        counts += np.add.reduce(bits, axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > total).tobytes()


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``docs`` with ``fp`` (bigint) in place of ``text``; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = K.text_bytes(batch.column(0))
            at = offsets.tolist()
            out = b"".join(fingerprint(data[a:b].tobytes(), shingle, seed) for a, b in zip(at, at[1:]))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.frombuffer(out, ">i8").astype(np.int64))], [*names, "fp"])
        K.release()

    names = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.col("text").cast("string").alias("text"), *names)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, schema + "fp bigint")


def _ball(bits: int, radius: int) -> list[np.ndarray]:
    """Masks over ``bits`` low bits by weight 0..radius (radius at most 2 is all that is used)."""
    one = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    out = [np.zeros(1, np.uint64), one]
    for _ in range(2, radius + 1):
        out.append(np.unique((out[-1][:, None] | one[None, :])[(out[-1][:, None] & one[None, :]) == 0]))
    return out[: radius + 1]


def _meetings(variant: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from the smallest owner of each variant value to its other owners."""
    order = np.sort(variant)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return owner[:0], owner[:0]
    at = np.minimum(np.searchsorted(twice, variant), len(twice) - 1)
    hit = np.flatnonzero(twice[at] == variant)
    at, who = at[hit], owner[hit]
    low = np.full(len(twice), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(low, at, who)
    a, b = low[at], who
    far = a != b
    return a[far], b[far]


def ball_links(fps: DataFrame, n_fps: int, radius: int = 4, prefix_bits: int | None = None, partitions: int = 200) -> DataFrame:
    """(a, b): links that join every two distinct fingerprints at most ``radius`` bits apart, directly or through others.

    Links between fingerprints that meet in one task are thinned to a spanning forest there.
    """
    if radius % 2:
        raise ValueError("an even radius is needed: only then does meeting at a value prove the distance")
    half = radius // 2
    if prefix_bits is None:
        prefix_bits = 10
        while prefix_bits < 30 and n_fps * sum(map(len, _ball(prefix_bits, half))) / 2**prefix_bits > PREFIX_LOAD:
            prefix_bits += 2
    rest = 64 - prefix_bits

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = np.concatenate(_ball(prefix_bits, half))
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fp), 1 << 13):
                part = fp[i : i + (1 << 13)]
                key = (part >> np.uint64(rest))[:, None] ^ masks[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().astype(np.int32)), pa.array(np.repeat(part, len(masks)).view(np.int64))], ["key", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = _ball(rest, half)
        grown = [np.concatenate(ball[: r + 1]) for r in range(half + 1)]
        low_bits = np.uint64((1 << rest) - 1)
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def thin() -> None:
            if found:
                nodes, roots = K.local_roots(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
                found[:] = [(roots[nodes != roots], nodes[nodes != roots])]

        def part(key: np.ndarray, fp: np.ndarray) -> None:
            """All rows of some whole keys; varied in runs of values of the next bits where they are too many."""
            used = np.bitwise_count(key ^ (fp >> np.uint64(rest)))
            total = sum(int((used == half - r).sum()) * len(grown[r]) for r in range(half + 1))
            cuts = 1
            while total / cuts > VARIANTS_AT_ONCE and cuts < 1 << 12:
                cuts *= 2
            cut_shift = np.uint64(rest - (cuts.bit_length() - 1))
            for c in range(cuts):
                variants, owners = [], []
                for r in range(half + 1):
                    mine = used == half - r
                    k, f = key[mine], fp[mine]
                    if cuts > 1:  # only those whose own ball reaches this cut
                        near = np.bitwise_count(((f & low_bits) >> cut_shift) ^ np.uint64(c)) <= r
                        k, f = k[near], f[near]
                    for i in range(0, len(k), max(1, VARIANTS_AT_ONCE // len(grown[r]))):
                        kk, ff = k[i : i + max(1, VARIANTS_AT_ONCE // len(grown[r]))], f[i : i + max(1, VARIANTS_AT_ONCE // len(grown[r]))]
                        v = (ff & low_bits)[:, None] ^ grown[r][None, :]
                        o = np.broadcast_to(ff[:, None], v.shape)
                        v |= kk[:, None] << np.uint64(rest)
                        if cuts > 1:
                            inside = ((v & low_bits) >> cut_shift) == np.uint64(c)
                            variants.append(v[inside])
                            owners.append(o[inside])
                        else:
                            variants.append(v.ravel())
                            owners.append(o.ravel())
                if variants:
                    found.append(_meetings(np.concatenate(variants), np.concatenate(owners)))
            if sum(len(x) for x, _ in found) > 1 << 18:
                thin()

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(key):
                continue
            held.append((key, fp))
            if sum(len(k) for k, _ in held) >= 1 << 15 and held[0][0][0] != key[-1]:
                key, fp = (np.concatenate(x) for x in zip(*held))
                whole = key != key[-1]
                part(key[whole], fp[whole])
                held = [(key[~whole], fp[~whole])]
        if held:
            part(*(np.concatenate(x) for x in zip(*held)))
        thin()
        if found:
            a, b = found[0]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    rows = fps.select("fp").mapInArrow(emit, "key int, fp bigint")
    return rows.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(meet, "a bigint, b bigint")


def simhash_groups(docs: DataFrame, radius: int = 4, shingle: int = 4, prefix_bits: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id, fp): one row per row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most ``radius`` bits, the row's own
    included. Null and wordless texts have fingerprint zero and are linked like any other. Repeated rows
    are repeated in the result; rows with a null doc_id keep it and never give a group its id. Extra
    columns are ignored. An empty table gives an empty result.
    """
    work = Work(docs.sparkSession, "simhash")
    own = work.keep(fingerprints(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), shingle), "fingerprints")
    at = _rooted(own, work, radius, prefix_bits)
    work.prune("fingerprints", "rooted")
    firsts = own.groupBy("fp").agg(F.min("doc_id").alias("first")).join(at, "fp")
    ids = work.keep(firsts.groupBy("root").agg(F.min("first").alias("component_id")), "ids")
    names = work.keep(at.join(ids, "root").select("fp", "component_id"), "names")
    return own.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")


def _rooted(own: DataFrame, work: Work, radius: int, prefix_bits: int | None) -> DataFrame:
    """(fp, root) for every distinct fingerprint of the written table ``own``."""
    parts = shuffle_partitions(own.sparkSession)
    reps = work.keep(own.select("fp").distinct().repartition(parts), "distinct")  # each task emits as many balls
    links = ball_links(reps, reps.count(), radius, prefix_bits, parts)
    found = work.keep(components(links, work).select(F.col("node").alias("fp"), "root"), "roots")
    return work.keep(reps.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "rooted")


def one_of_each(docs: DataFrame, radius: int = 4, shingle: int = 4, prefix_bits: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, all columns kept, whatever their names: of each group the one with the smallest doc_id.

    Null ids come last; of rows with equal ids, or none, the first stays, so of repeated rows one is left. Null
    and wordless texts are one group. Groups are those of ``simhash_groups``. An empty table gives an empty result.
    """
    work = Work(docs.sparkSession, "simhash")
    rid = fresh(docs, "rid")
    base = work.keep(docs.withColumn(rid, F.monotonically_increasing_id()), "rows")
    own = work.keep(fingerprints(base.select("doc_id", F.col(rid).alias("rid"), "text"), shingle), "fingerprints")
    at = _rooted(own, work, radius, prefix_bits)
    first = own.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("first"))
    kept = work.keep(first.join(at, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.rid").alias(rid)), "kept")
    work.prune("rows", "kept")
    return base.join(kept.hint("merge"), rid, "left_semi").drop(rid)  # kept grows with the rows: never broadcast
