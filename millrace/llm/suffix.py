"""Removal of byte strings that occur more than once, by interval expansion on a Burrows-Wheeler transform.

A string of ``length`` bytes is assigned to an anchor: of its 32-byte windows, the leftmost with the
least hash. Equal strings have equal anchors at equal places, so strings are compared only where an
anchor's hash occurs again, and a run of consecutive strings with the same anchor travels as one
segment. Equal segments are counted before the shuffle; only anchors with different segments need
comparing. There the segments of whole anchors are joined to a text, its Burrows-Wheeler transform is
built, and backward extension, breadth first, sets the longest common prefix of neighbouring suffixes
by increasing value. It stops at ``length``: what is unset then is a repeated string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernels as K
from millrace.llm.storage import Work, shuffle_partitions

ANCHOR = 32
#: bytes of segments that one transform is built of, unless a single anchor has more
AT_ONCE = 1 << 19
#: different segments of an anchor beyond which its strings are compared by hash, spread over all tasks
CROWDED = 4096


def window_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all windows of ANCHOR bytes, by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    n, step = 1, 0x9E3779B97F4A7C15
    while n < ANCHOR:
        h = h[:-n] * np.uint64(step) + h[n:]
        n *= 2
        step = step * step % (1 << 64)
    return K.mix(h)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    out, n = values, 1
    while 2 * n <= width:
        out = np.minimum(out[:-n], out[n:])
        n *= 2
    rest = width - n
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def windows(offsets: np.ndarray, data: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Offsets and bytes of some documents, and where those bytes begin: all at once, or a long document's by and by, overlapping so that each string is in one part."""
    if len(data) < 2 * K.SLICE_BYTES:
        yield offsets, data, 0
        return
    for a in range(0, max(1, len(data) - length + 1), K.SLICE_BYTES):
        part = data[a : a + K.SLICE_BYTES + length - 1]
        yield np.array([0, len(part)]), part, a


def segments(offsets: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with the same anchor: anchor hash, segment hash, first string's place in ``data``, strings, document.

    Hashes are compared without as many low bits as hold a place in any part of ``windows``, so equal strings
    have equal anchors wherever they stand.
    """
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    place_bits = np.uint64((1 << (2 * K.SLICE_BYTES + length).bit_length()) - 1)
    hashes = window_hashes(data)
    least = sliding_least((hashes & ~place_bits) | np.arange(len(hashes), dtype=np.uint64), length - ANCHOR + 1)
    anchor = (least & place_bits).astype(np.int64)
    starts = np.arange(n)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    inside = starts + length <= offsets[owner + 1]
    first = np.ones(n, bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1] | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first & inside)
    ends = np.flatnonzero(inside & np.append(first[1:] | ~inside[1:], True)) + 1
    prefix = K.prefix_sums(data)
    content = K.span_hash(prefix, at, ends - 1 + length) ^ K.mix((anchor[at] - at).astype(np.uint64))
    return hashes[anchor[at]], content, at, ends - at, owner[at]


def suffix_array(text: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Suffixes in the order of at least their first ``length`` symbols; each terminator (0, at ``ends``) is a symbol of its own.

    ``text``: bytes plus one. UTF-8 has no byte 255, so eight symbols pack into a machine word.
    """
    n = len(text)
    segment = np.searchsorted(ends, np.arange(n))
    left = ends[segment] - np.arange(n)  # symbols before the terminator
    padded = np.concatenate([text, np.zeros(8, text.dtype)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | np.where(k < left, padded[k : k + n], 0)
    tie = np.where(left < 8, segment + 1, 0)
    order = np.lexsort((tie, key))
    new = np.ones(n, bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (tie[order][1:] != tie[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new) - 1
    known = 8
    while known < length and rank.max() < n - 1:
        later = np.minimum(np.arange(n) + known, n - 1)
        key = (rank << 32) | rank[later]
        order = np.argsort(key)
        sorted_key = key[order]
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        rank[order] = np.cumsum(new) - 1
        known *= 2
    return np.argsort(rank, kind="stable")


def repeated_suffixes(text: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix shares its first ``length`` symbols with another; computed from the transform alone once suffixes are placed."""
    n, m = len(text), len(ends)
    sa = suffix_array(text, ends, length)
    row = np.empty(n, np.int64)
    row[sa] = np.arange(n)
    transform = text[sa - 1]  # the symbol before each suffix; 0 where a terminator stands
    back = row[sa - 1]
    unset = np.ones(n + 1, bool)
    # strings of one symbol: every terminator by itself, then the bytes
    symbols = np.sort(text[text > 0])
    bounds = np.concatenate([np.arange(m + 1), m + np.flatnonzero(np.diff(symbols)) + 1, [n]]) if len(symbols) else np.arange(m + 1)
    bounds = np.unique(bounds)
    low, high = bounds[:-1], bounds[1:]
    unset[bounds] = False
    for _ in range(1, length):
        if not len(low):
            break
        size = high - low
        which = np.repeat(np.arange(len(low)), size)
        at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + low[which]
        symbol = transform[at]
        keep = symbol > 0
        which, symbol, to = which[keep], symbol[keep], back[at[keep]]
        # rows of one interval with one symbol before them are the rows of the longer string
        group = which * 256 + symbol
        order = np.lexsort((to, group))
        group, to = group[order], to[order]
        edge = np.flatnonzero(np.diff(group)) + 1
        low, high = to[np.concatenate([[0], edge])] if len(to) else to, to[np.concatenate([edge - 1, [len(to) - 1]])] + 1 if len(to) else to
        fresh = unset[high]
        low, high = low[fresh], high[fresh]
        unset[high] = False
    same = unset[:n].copy()  # row i has at least ``length`` symbols in common with row i - 1
    same[0] = False
    with_next = np.append(same[1:], False)
    out = np.zeros(n, bool)
    out[sa] = same | with_next
    return out


def repeated_starts(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment, which of its strings occur again among all segments."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.zeros(starts[-1], np.uint8)
    for p, a in zip(pieces, starts):
        text[a : a + len(p)] = np.frombuffer(p, np.uint8) + 1
    found = repeated_suffixes(text, starts[1:] - 1, length)
    return [found[a : a + s - length + 1] for a, s in zip(starts, sizes)]


def _runs(flags: np.ndarray) -> list[int]:
    """First and last index of each run of true, one after the other."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    edge[1::2] -= 1
    return edge.tolist()


def _bytes(col) -> list[bytes]:
    return [x if x is not None else b"" for x in col.to_pylist()]


def remove_repeats(docs: DataFrame, length: int = 200, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans), one row per row of ``docs``.

    Removed is every byte covered by a string of ``length`` bytes that also starts anywhere else, in the same
    row included; strings never cross rows and are judged on the input. ``kept`` holds the remaining bytes,
    ``spans`` the removed runs as start and end by turns. A null text counts as empty. Repeated rows are
    rows like any other, so they remove each other. Extra columns are ignored whatever their names; an empty table gives an
    empty result. Texts are read whole, a long one half a megabyte at a time; where it is cut it is held as bytes.
    """
    if length < 2 * ANCHOR:
        raise ValueError(f"length must be at least {2 * ANCHOR}")
    spark = docs.sparkSession
    work = Work(spark, "suffix")
    parts = shuffle_partitions(spark)

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = work.keep(rows.mapInArrow(K.pack, "rid bigint, doc_id bigint, n bigint, z binary"), "texts", "uncompressed")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, offsets, data in K.slabs(batch.column(1), batch.column(2)):
                for edges, part, begin in windows(offsets, data, length):
                    h, seg, at, n, owner = segments(edges, part, length)
                    rid = batch.column(0).to_numpy()[i:j][owner]
                    at = at - edges[owner] + begin
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(rid), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], ["h", "seg", "rid", "at", "n"])
        K.release()

    marks = work.keep(base.select("rid", "n", "z").mapInArrow(mark, "h bigint, seg bigint, rid bigint, at int, n int"), "marks", "uncompressed")
    again = marks.groupBy("h").agg(F.count("*").alias("c"), (F.min("seg") != F.max("seg")).alias("mixed")).where("c > 1").select("h", "mixed")
    again = work.keep(again, "again")
    hits = work.keep(marks.join(again.hint("merge"), "h"), "hits")  # anchors grow with the texts: never broadcast
    work.drop(work.where["marks"], work.where["again"])
    work.release()

    # anchors with different segments: one of each, with its text
    kinds = work.keep(hits.where("mixed").groupBy("h", "seg").agg(F.count("*").alias("c"), F.min(F.struct("rid", "at", "n")).alias("one")), "kinds")
    crowds = work.keep(kinds.groupBy("h").count().where(F.col("count") > crowded).select("h", F.lit(True).alias("crowd")), "crowds")
    asked = kinds.join(crowds, "h", "left").select("one.rid", F.struct("h", "seg", "c", F.coalesce("crowd", F.lit(False)).alias("crowd"), F.col("one.at").alias("at"), F.col("one.n").alias("n")).alias("s"))
    asked = asked.groupBy("rid").agg(F.collect_list("s").alias("s"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for z, wanted in zip(_bytes(batch.column(0)), batch.column(1)):
                s = wanted.values
                text = expand(z)
                at, n = s.field("at").to_pylist(), s.field("n").to_pylist()
                yield pa.RecordBatch.from_arrays([s.field("h"), s.field("seg"), s.field("c"), s.field("crowd"), pa.array([text[a : a + k + length - 1] for a, k in zip(at, n)], pa.binary())], ["h", "seg", "c", "crowd", "text"])

    texts = work.keep(base.join(asked, "rid").select("z", "s").mapInArrow(fetch, "h bigint, seg bigint, c bigint, crowd boolean, text binary"), "segments")
    work.release()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []

        def done(rows: list) -> pa.RecordBatch:
            found = repeated_starts([t for *_, t in rows], length)
            runs = [[0, len(f) - 1] if c > 1 else _runs(f) for (_, _, c, _), f in zip(rows, found)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(runs, pa.list_(pa.int32()))], ["h", "seg", "runs"])

        size = 0
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), _bytes(batch.column(3))):
                if size >= AT_ONCE and held[-1][0] != row[0]:
                    yield done(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield done(held)
        K.release()

    plain = texts.where("not crowd").select("h", "seg", "c", "text").repartition(parts, "h").sortWithinPartitions("h", "seg").mapInArrow(compare, "h bigint, seg bigint, runs array<int>")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, seg, c, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                data = np.frombuffer(text, np.uint8)
                prefix, at = K.prefix_sums(data), np.arange(len(data) - length + 1)
                one = K.span_hash(prefix, at, at + length)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), h)), pa.array(np.full(len(at), seg)), pa.array(np.full(len(at), c)), pa.array(at.astype(np.int32)), pa.array(one.view(np.int64))], ["h", "seg", "c", "k", "one"])

    # an anchor with too many different segments for one task: its strings are dealt by their hashes, and where
    # those meet their bytes are compared, equal ones counted before they are sent
    crowd = texts.where("crowd")
    each = work.keep(crowd.select("h", "seg", "c", "text").mapInArrow(strings, "h bigint, seg bigint, c bigint, k int, one bigint"), "strings")
    twice = work.keep(each.groupBy("one").agg(F.sum("c").alias("times")).where("times > 1").select("one"), "twice")
    maybe = each.join(twice, "one").groupBy("h", "seg").agg(F.collect_list("k").alias("ks"))
    maybe = crowd.join(maybe, ["h", "seg"]).select("h", "seg", "c", F.explode("ks").alias("k"), "text")
    maybe = work.keep(maybe.select("h", "seg", "c", "k", F.substring("text", F.col("k") + 1, F.lit(length)).alias("string")), "maybe")
    equal = work.keep(maybe.groupBy("string").agg(F.sum("c").alias("times")).where("times > 1").select("string"), "equal")
    rest = maybe.join(equal, "string").groupBy("h", "seg").agg(F.flatten(F.collect_list(F.array("k", "k"))).alias("runs"))
    runs = work.keep(plain.unionByName(rest).where("size(runs) > 0"), "runs")

    mixed = hits.where("mixed").select("h", "seg", "rid", "at").join(runs, ["h", "seg"]).select("rid", F.transform("runs", lambda k: k + F.col("at")).alias("runs"))
    # all segments of the anchor are one and the same: they are the longer strings, with nothing to tell apart
    single = hits.where("not mixed").select("rid", F.array(F.col("at"), F.col("at") + F.col("n") - 1).alias("runs"))
    spans = work.keep(mixed.unionByName(single).groupBy("rid").agg(F.flatten(F.collect_list("runs")).alias("runs")), "spans")
    work.prune("texts", "spans")
    work.release()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for z, r in zip(_bytes(batch.column(1)), batch.column(2)):
                text, spans = expand(z), []
                if r.values is not None and len(r.values):
                    pairs = r.values.to_numpy().reshape(-1, 2)
                    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
                    reach = np.maximum.accumulate(pairs[:, 1] + length)
                    new = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] > reach[:-1]]))
                    spans = np.stack([pairs[new, 0], reach[np.append(new[1:], len(pairs)) - 1]], 1).ravel().tolist()
                at = [0, *spans, len(text)]
                kept = b"".join(text[a:b] for a, b in zip(at[::2], at[1::2]))
                out.append((len(text), len(text) - len(kept), len(spans) // 2, hashlib.sha256(kept).hexdigest(), kept, spans))
            cols = [pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int32())))] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])
        K.release()

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, spans array<int>"
    return base.join(spans.hint("merge"), "rid", "left").select("doc_id", "z", "runs").mapInArrow(cut, schema)
