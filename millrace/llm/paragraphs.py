"""Near-duplicate paragraphs by MinHash banding.

Paragraphs are the non-blank lines of a text. Distinct paragraphs (by their words) are signed over
five-word shingles and cut into bands; ten bands of three rows find a pair of similarity 0.8 with
probability 0.999. Only bands met by different paragraphs go on: their members' shingles are fetched,
exact Jaccard similarities are taken inside each band, and links of 0.8 or more are joined to
components. Of each component the paragraph with the smallest (doc_id, place) stays.

A passage inside otherwise different long paragraphs is found by pieces: a paragraph of fifty words or more
is cut where a word's hash is the least within REACH words, so equal passages are cut alike wherever they
stand. A piece has about nine shingles, and a changed word leaves it far below the similarity, so pieces
are matched whole; what stays of the paragraphs is searched, and repeated pieces in a row of PASSAGE words or
more are removed but for their first occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import kernels as K
from millrace.llm.components import components
from millrace.llm.storage import Work, fresh, shuffle_partitions

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 10, 3
#: paragraphs of a band that are compared in one task; a band with more is dealt into shares by hash, anew
#: for each band, and every two shares are compared, but for those inside the band's largest component so far
CROWDED = 4096
#: paragraphs of so many words or more are cut into pieces; words on either side that decide a cut; words of a repeated passage
LONG, REACH, PASSAGE = 50, 6, 24
_LINE = K.lut(b"\n")
_KEYS = np.random.default_rng(77).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def pieces(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Offsets and bytes of some documents, and where those bytes begin in their document: all at once, or a long document's lines by and by."""
    if len(offsets) > 2 or len(data) <= 2 * K.SLICE_BYTES:
        yield offsets, data, 0
        return
    feeds = np.append(np.flatnonzero(data == 10) + 1, len(data))
    a = 0
    while a < len(data):
        b = int(feeds[min(np.searchsorted(feeds, a + K.SLICE_BYTES), len(feeds) - 1)])
        yield np.array([0, b - a]), data[a:b], a
        a = b


def word_hashes(low: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of the words; none crosses a bound. Bytes are hashed some at a time, cut between words."""
    starts, ends, hashes = [], [], []
    a = 0
    while a < len(low):
        b = min(a + K.SLICE_BYTES, len(low))
        while b < len(low):
            gap = np.flatnonzero(~K.WORD[low[b : b + 4096]])
            if len(gap):
                b += int(gap[0])
                break
            b = min(b + 4096, len(low))
        part = low[a:b]
        edges = bounds[np.searchsorted(bounds, a) : np.searchsorted(bounds, b, side="right")] - a
        s, e = K.runs(K.WORD[part], edges)
        hashes.append(K.span_hash(K.prefix_sums(part), s, e))
        starts.append(s + a)
        ends.append(e + a)
        a = b
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


class Paragraphs:
    """The paragraphs of some whole documents: owner, place in the document, identity, and shingles by ``bounds``.

    Words are runs of letters and digits, lower-cased (A-Z). A paragraph without words is its bytes. Fewer
    than five words make one shingle.
    """

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        low = K.LOWER[data]
        start, end = K.runs(~_LINE[low], offsets)
        if len(start):  # behind a line there are line feeds only, up to the next one
            solid = np.logical_or.reduceat(K.NOT_SPACE[low], start)
            start, end = start[solid], end[solid]
        self.start, self.end = start, end
        self.owner = np.searchsorted(offsets, start, side="right") - 1
        first = np.searchsorted(self.owner, np.arange(len(offsets) - 1))
        self.place = np.arange(len(start)) - first[self.owner]
        ws, we, words = word_hashes(low, np.unique(np.concatenate([offsets, start, end])))
        lo, hi = np.searchsorted(ws, start), np.searchsorted(ws, end)
        self.n_words = hi - lo
        sums = np.zeros(len(words) + 1, np.uint64)
        pw, inv = K.powers(len(words) + 1)
        np.cumsum(words * pw[: len(words)], out=sums[1:])
        self.identity = K.mix((sums[hi] - sums[lo]) * inv[lo] + self.n_words.astype(np.uint64))
        for k in np.flatnonzero(self.n_words == 0):
            line = low[start[k] : end[k]]
            self.identity[k] = K.span_hash(K.prefix_sums(line), np.array([0]), np.array([len(line)]))[0] ^ np.uint64(1)
        self.words, self.first_word, self.word_start, self.word_end = words, lo, ws, we
        grams = K.combine(words, SHINGLE)
        count = np.maximum(self.n_words - SHINGLE + 1, 1)
        self.bounds = np.concatenate([[0], np.cumsum(count)])
        at = np.arange(self.bounds[-1]) - np.repeat(self.bounds[:-1], count) + np.repeat(lo, count)
        self.shingles = np.repeat(self.identity, count)
        long = np.repeat(self.n_words >= SHINGLE, count)
        self.shingles[long] = grams[at[long]]

    def cuts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The pieces of long paragraphs: paragraph, first byte, the byte behind (up to the next piece), words, identity."""
        n = len(self.words)
        of = np.repeat(np.arange(len(self.n_words)), self.n_words)
        long = (self.n_words >= LONG)[of]
        at, first = np.arange(n), self.first_word[of]
        last = first + self.n_words[of]
        h = K.mix(self.words ^ np.uint64(77))
        cut = long & (at - REACH >= first) & (at + REACH < last)
        for k in range(1, min(REACH, max(n - 1, 0)) + 1):  # ties go to the left
            cut[k:] &= h[k:] < h[:-k]
            cut[:-k] &= h[:-k] <= h[k:]
        begin = np.flatnonzero(cut | (long & (at == first)))
        owner = of[begin]
        end = np.minimum(np.append(begin[1:], n), last[begin])
        sums = np.zeros(n + 1, np.uint64)
        pw, inv = K.powers(n + 1)
        np.cumsum(self.words * pw[:n], out=sums[1:])
        identity = K.mix((sums[end] - sums[begin]) * inv[begin] + (end - begin).astype(np.uint64)) ^ np.uint64(2)
        closes = end == last[begin]
        behind = np.where(closes, self.word_end[end - 1], self.word_start[np.minimum(end, max(n - 1, 0))])
        return owner, self.word_start[begin], behind, end - begin, identity

    def bands(self, which: np.ndarray) -> np.ndarray:
        """(BANDS, len(which)) band keys."""
        out = np.zeros((BANDS, len(which)), np.uint64)
        if not len(which):
            return out
        count = np.diff(self.bounds)[which]
        cuts = np.concatenate([[0], np.cumsum(count)])
        a = 0
        while a < len(which):
            z = max(a + 1, int(np.searchsorted(cuts, cuts[a] + (1 << 16), side="right")) - 1)
            n = count[a:z]
            starts = cuts[a:z] - cuts[a]
            shingles = self.shingles[np.arange(n.sum()) - np.repeat(starts, n) + np.repeat(self.bounds[which[a:z]], n)]
            shingles ^= shingles >> np.uint64(29)
            for b in range(BANDS):
                key = np.full(z - a, b + 1, np.uint64)
                for r in range(ROWS):
                    key = K.mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(shingles * _KEYS[b * ROWS + r], starts))
                out[b, a:z] = key
            a = z
        return out


def band_clusters(ids: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all members of one band that are similar, directly or through other members.

    Grown cluster by cluster: each member is compared once with those not yet placed, so a band whose members
    all resemble the first costs one comparison each.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
    open_ = np.arange(len(ids))
    a, b = [], []
    while len(open_):
        todo, open_ = [open_[0]], open_[1:]
        while todo and len(open_):
            i = todo.pop()
            # whether each shingle of the open members is one of i's
            n = sizes[open_]
            pick = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[open_], n)
            mine = sets[i]
            at = np.minimum(np.searchsorted(mine, flat[pick]), len(mine) - 1)
            common = np.add.reduceat((mine[at] == flat[pick]).astype(np.int64), np.cumsum(n) - n)
            near = common >= similarity * (n + sizes[i] - common) - 1e-9
            found = open_[near]
            a += [ids[i]] * len(found)
            b += ids[found].tolist()
            todo += found.tolist()
            open_ = open_[~near]
    return np.array(a, np.int64), np.array(b, np.int64)


def near_links(left_ids: np.ndarray, left: list[np.ndarray], right_ids: np.ndarray, right: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that join whatever all pairs of a left and a right set that are similar would join.

    Every pair is counted: shingles that many sets hold by products of 0/1 matrices, the others pair by pair.
    """
    m, n = len(left), len(right)
    sizes = [np.fromiter(map(len, sets), np.int64, len(sets)) for sets in (left, right)]
    flats = [np.concatenate(sets) for sets in (left, right)]
    shared = np.intersect1d(np.unique(flats[0]), np.unique(flats[1]))
    common = np.zeros((m, n), np.float32)
    rows, cols = [], []
    for size, flat in zip(sizes, flats):
        at = np.minimum(np.searchsorted(shared, flat), max(len(shared) - 1, 0))
        known = np.flatnonzero(shared[at] == flat) if len(shared) else np.zeros(0, np.int64)
        known = known[np.argsort(at[known], kind="stable")]
        rows.append(np.repeat(np.arange(len(size)), size)[known])
        cols.append(at[known])
    held = [np.bincount(c, minlength=len(shared)) for c in cols]
    begin = [np.cumsum(h) - h for h in held]
    work = held[0] * held[1]
    often = work * 160 > m * n
    dense = np.flatnonzero(often)
    for a in range(0, len(dense), 1024):
        chosen = dense[a : a + 1024]
        place = np.full(len(shared), -1, np.int64)
        place[chosen] = np.arange(len(chosen))
        x, y = (np.zeros((k, len(chosen)), np.float32) for k in (m, n))
        for into, row, col in zip((x, y), rows, cols):
            hit = place[col] >= 0
            into[row[hit], place[col[hit]]] = 1
        for r in range(0, m, 1024):
            common[r : r + 1024] += x[r : r + 1024] @ y.T
    each = np.flatnonzero(~often[cols[0]])
    pairs = held[1][cols[0][each]]
    cuts = np.concatenate([[0], np.cumsum(pairs)])
    a = 0
    while a < len(each):
        b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + (1 << 22), side="right")) - 1)
        k = pairs[a:b]
        other = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(begin[1][cols[0][each[a:b]]], k)
        np.add.at(common, (np.repeat(rows[0][each[a:b]], k), rows[1][other]), np.float32(1))
        a = b
    near = np.zeros((m, n), bool)
    for r in range(0, m, 256):
        c = common[r : r + 256].astype(np.float64)
        near[r : r + 256] = c >= similarity * (sizes[0][r : r + 256, None] + sizes[1] - c) - 1e-9
    turned = np.ascontiguousarray(near.T)
    open_left, open_right = near.any(1), near.any(0)
    a, b = [left_ids[:0]], [left_ids[:0]]
    for i in np.flatnonzero(open_left):
        todo = np.array([i]) if open_left[i] else np.zeros(0, np.int64)
        open_left[i] = False
        while len(todo):
            over = np.flatnonzero(near[todo].any(0) & open_right)
            open_right[over] = False
            todo = np.flatnonzero(turned[over].any(0) & open_left)
            open_left[todo] = False
            for met in (right_ids[over], left_ids[todo]):
                a.append(np.full(len(met), left_ids[i]))
                b.append(met)
    return np.concatenate(a), np.concatenate(b)


def paragraph_duplicates(docs: DataFrame, similarity: float = SIMILARITY, crowded: int = CROWDED, rid: str | None = None) -> DataFrame:
    """The first table of ``duplicates``."""
    return duplicates(docs, similarity, crowded, rid)[0]


def duplicates(docs: DataFrame, similarity: float = SIMILARITY, crowded: int = CROWDED, rid: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rid, place, start, end, n_words, component, repeated, kept_in, keep): one row per paragraph of ``docs``;
    and (doc_id, rid, place, start, end, n_words, kept_in): one row per passage to remove inside paragraphs that stay.

    ``rid`` tells rows apart that share a doc_id, or have none; it is numbered here, or taken from a bigint column of that
    name. start and end are byte offsets in the text. component is the identity of the group, keep false for
    every paragraph but the group's first by (doc_id, rid, place), null ids last; repeated is true for all of a
    group of several, kept_in their first's doc_id. Null, empty and blank texts have no paragraphs; ties and
    repeated rows are ordinary duplicates. Extra columns are ignored whatever their names; an empty table gives an
    empty result. Texts are read whole, a long one some lines at a time: a worker's memory follows the longest
    line, about forty times its bytes.
    """
    spark = docs.sparkSession
    work = Work(spark, "paragraphs")
    parts = shuffle_partitions(spark)
    own = F.col(rid).cast("bigint") if rid else F.monotonically_increasing_id()
    rows = docs.select(own.alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = work.keep(rows.mapInArrow(K.pack, "rid bigint, doc_id bigint, n bigint, z binary"), "texts", "uncompressed")
    keys = [f"b{i}" for i in range(BANDS)]

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every paragraph's place and identity, and the band keys of those with more than one shingle."""
        for batch in batches:
            for i, _, offsets, data in K.slabs(batch.column(2), batch.column(3)):
                done = 0
                for at, part, begin in pieces(offsets, data):
                    p = Paragraphs(at, part)
                    who = pa.array(p.owner + i)
                    start = p.start - at[p.owner] + begin
                    cols = [batch.column(0).take(who), batch.column(1).take(who), pa.array((p.place + done).astype(np.int32)), pa.array(start.astype(np.int32)), pa.array((start + p.end - p.start).astype(np.int32)), pa.array(p.n_words.astype(np.int32)), pa.array(p.identity.view(np.int64))]
                    short = p.n_words <= SHINGLE  # one shingle: alike only if equal
                    bands = np.zeros((BANDS, len(short)), np.int64)
                    bands[:, ~short] = p.bands(np.flatnonzero(~short)).view(np.int64)
                    of, first, behind, n, piece = p.cuts()
                    first, behind = first - at[p.owner[of]] + begin, behind - at[p.owner[of]] + begin
                    cells = pa.StructArray.from_arrays([pa.array(first.astype(np.int32)), pa.array(behind.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(piece.view(np.int64))], ["start", "end", "n_words", "pid"])
                    held = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(short) + 1)).astype(np.int32)), cells)
                    yield pa.RecordBatch.from_arrays([*cols, held, *(pa.array(b, mask=short) for b in bands)], ["rid", "doc_id", "place", "start", "end", "n_words", "pid", "pieces", *keys])
                    done += len(p.place)
        K.release()

    schema = "rid bigint, doc_id bigint, place int, start int, end int, n_words int, pid bigint, pieces array<struct<start: int, end: int, n_words: int, pid: bigint>>, " + ", ".join(f"{k} bigint" for k in keys)
    where = work.keep(base.mapInArrow(locate, schema), "places")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by band and paragraph: each band's different paragraphs, where there are more than one."""
        last = None
        for batch in batches:
            band, pid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if last is not None:
                band, pid = np.concatenate([[last[0]], band]), np.concatenate([[last[1]], pid])
            if len(band) < 2:
                last = (band[0], pid[0]) if len(band) else last
                continue
            same = band[1:] == band[:-1]
            differ = same & (pid[1:] != pid[:-1])
            # one row per change of paragraph, with the one before it
            at = np.flatnonzero(differ)
            last = (band[-1], pid[-1])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(band[at], 2)), pa.array(np.stack([pid[at], pid[at + 1]], 1).ravel())], ["band", "pid"])

    # equal paragraphs have equal keys: each is counted once before it is dealt by its bands
    signed = where.where("b0 is not null").groupBy("pid").agg(*(F.min(k).alias(k) for k in keys)).select(F.explode(F.array(*keys)).alias("band"), "pid")
    members = work.keep(signed.repartition(parts, "band").sortWithinPartitions("band", "pid").mapInArrow(meet, "band bigint, pid bigint"), "members")
    work.release()

    # the shingles of the paragraphs that met, each fetched at one place
    asked = members.select("pid").distinct().join(where.groupBy("pid").agg(F.min(F.struct("rid", "place")).alias("one")), "pid")
    asked = asked.groupBy("one.rid").agg(F.collect_list("one.place").alias("places"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(2)
            for i, j, offsets, data in K.slabs(batch.column(0), batch.column(1)):
                done = 0
                for at, part, _ in pieces(offsets, data):
                    p = Paragraphs(at, part)
                    first = np.searchsorted(p.owner, np.arange(len(at) - 1)) - done
                    which = np.concatenate([first[d] + wanted[i + d].values.to_numpy() for d in range(len(at) - 1)])
                    which = which[(which >= 0) & (which < len(p.place))]
                    done += len(p.place)
                    sets = [np.unique(p.shingles[p.bounds[k] : p.bounds[k + 1]]).tobytes() for k in which]
                    yield pa.RecordBatch.from_arrays([pa.array(p.identity[which].view(np.int64)), pa.array(sets, pa.binary())], ["pid", "shingles"])
        K.release()

    shingles = work.keep(base.join(asked, "rid").select("n", "z", "places").mapInArrow(fetch, "pid bigint, shingles binary"), "shingles")
    work.drop(work.where["texts"])
    work.release()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links inside each (band, share); of crowded bands also each cluster's first member, as a link to itself. Rows arrive sorted."""
        held: dict[int, bytes] = {}
        now = (None, None)

        def links() -> Iterator[pa.RecordBatch]:
            ids = np.array(list(held), np.int64)
            sets = [np.frombuffer(x, np.uint64) for x in held.values()]
            if now[1] < 0:
                a, b = band_clusters(ids, sets, similarity) if len(held) > 1 else (ids[:0], ids[:0])
            else:
                a, b = near_links(ids, sets, ids, sets, similarity)
                nodes, root = K.local_roots(np.concatenate([a, ids]), np.concatenate([b, ids]))
                heads = nodes[nodes == root]
                a, b = np.concatenate([a, heads]), np.concatenate([b, heads])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), now[0])), pa.array(a), pa.array(b)], ["band", "a", "b"])

        for batch in batches:
            for band, share, pid, x in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (band, share) != now:
                    if held:
                        yield from links()
                    held, now = {}, (band, share)
                held[pid] = x
        if held:
            yield from links()
        K.release()

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links between two shares of a band, or inside one. Rows arrive sorted by pair of shares, then by share."""
        held: dict[int, dict[int, bytes]] = {}
        now = None

        def links() -> Iterator[pa.RecordBatch]:
            if now[1] == now[2] or len(held) == 2:
                sides = [(np.array(list(x), np.int64), [np.frombuffer(y, np.uint64) for y in x.values()]) for x in held.values()]
                a, b = near_links(*sides[0], *sides[-1], similarity)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for band, low, high, own, pid, x in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (band, low, high) != now:
                    if held:
                        yield from links()
                    held, now = {}, (band, low, high)
                held.setdefault(own, {})[pid] = x
        if held:
            yield from links()
        K.release()

    def checked(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "band", "share").sortWithinPartitions("band", "share", "pid").mapInArrow(verify, "band bigint, a bigint, b bigint")

    members = work.keep(members.distinct(), "members")
    crowds = work.keep(members.groupBy("band").count().where(F.col("count") > crowded), "crowds")
    share = F.coalesce(F.pmod(F.xxhash64("band", "pid"), F.ceil(F.col("count") / crowded)), F.lit(-1)).cast("bigint")
    met = members.join(shingles, "pid").join(crowds, "band", "left").select("band", share.alias("share"), "pid", "shingles")
    edges = work.keep(checked(met), "edges")
    found = edges.select("a", "b")
    if not crowds.isEmpty():
        # the clusters' first members, dealt anew: what they join needs no comparison of whole shares
        heads = edges.where("a = b").select("band", F.col("a").alias("pid"))
        heads = heads.join(heads.groupBy("band").count(), "band").select("band", F.pmod(F.xxhash64("pid", "band"), F.ceil(F.col("count") / crowded)).cast("bigint").alias("share"), "pid")
        met = work.keep(heads, "heads").join(shingles, "pid").select("band", "share", "pid", "shingles")
        found = work.keep(found.unionByName(work.keep(checked(met), "edges").select("a", "b")).distinct(), "edges")
        # every pair of a band but those inside its largest component so far is compared, share against share
        roots = components(found, work).select(F.col("node").alias("pid"), "root")
        crowd = work.keep(members.join(crowds.select("band"), "band").join(roots, "pid", "left").select("band", "pid", F.coalesce("root", "pid").alias("root")), "crowd")
        largest = crowd.groupBy("band", "root").count().groupBy("band").agg(F.max_by("root", F.struct("count", "root")).alias("largest"), F.max("count").alias("inside"), F.sum("count").alias("all"))
        largest = largest.where("inside < all").select("band", "largest", F.ceil((F.col("all") - F.col("inside")) / crowded).alias("outer"), F.ceil(F.col("inside") / crowded).alias("inner"))
        inner = F.col("root") == F.col("largest")
        dealt = F.xxhash64("band", "pid")
        own = F.when(inner, F.col("outer") + F.pmod(dealt, F.col("inner"))).otherwise(F.pmod(dealt, F.col("outer")))
        against = F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(inner, F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1))
        crowd = crowd.join(largest, "band").select("band", "pid", own.alias("own"), against.alias("against"))
        crowd = work.keep(crowd.select("band", F.least("own", "against").alias("low"), F.greatest("own", "against").alias("high"), "own", "pid"), "crowd")
        met = crowd.join(shingles, "pid").select("band", "low", "high", "own", "pid", "shingles").repartition(parts, "band", "low", "high").sortWithinPartitions("band", "low", "high", "own", "pid")
        found = found.unionByName(work.keep(met.mapInArrow(cross, "a bigint, b bigint"), "edges"))
    roots = work.keep(components(found, work).select(F.col("node").alias("pid"), "root"), "roots")
    work.release()

    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid", "place")).alias("first")
    named = where.groupBy("pid").agg(F.count("*").alias("times"), first).join(roots, "pid", "left").where("times > 1 or root is not null")
    named = work.keep(named.select("pid", F.coalesce("root", "pid").alias("component"), "first"), "named")
    heads = work.keep(named.groupBy("component").agg(F.min("first").alias("head")), "heads")
    groups = work.keep(named.select("pid", "component").join(heads, "component").select("pid", "component", "head"), "groups")
    lines = where.drop("pieces", *keys)
    out = lines.join(groups, "pid", "left")
    keep = F.coalesce((F.col("rid") == F.col("head.rid")) & (F.col("place") == F.col("head.place")), F.lit(True))
    found = out.select("doc_id", "rid", "place", "start", "end", "n_words", F.coalesce("component", "pid").alias("component"), F.col("component").isNotNull().alias("repeated"), F.col("head.doc_id").alias("kept_in"), keep.alias("keep"))
    return found, _passages(where, groups, work)


def _passages(where: DataFrame, groups: DataFrame, work: Work) -> DataFrame:
    """The second table of ``duplicates``, from the paragraphs with their pieces and the groups of whole paragraphs."""
    parted = where.where("size(pieces) > 0")
    cells = parted.select("doc_id", "rid", "place", F.posexplode("pieces").alias("no", "p")).select("doc_id", "rid", "place", "no", "p.*")
    again = work.keep(cells.groupBy("pid").count().where("count > 1").select("pid"), "again")
    # what goes as a whole paragraph is searched no more
    gone = parted.select("pid", "rid", "place").join(groups, "pid").where("rid <> head.rid or place <> head.place").select("rid", "place")
    hits = work.keep(cells.join(again, "pid").join(gone, ["rid", "place"], "left_anti"), "hits")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid", "place", "no")).alias("first")
    heads = hits.groupBy("pid").agg(F.count("*").alias("times"), first).where("times > 1").select("pid", "first")
    hits = work.keep(hits.join(heads, "pid"), "hits")
    # pieces in a row: their number less their place among the line's repeated ones does not change
    line = Window.partitionBy("rid", "place")
    run = hits.withColumn("run", F.col("no") - F.row_number().over(line.orderBy("no")))
    run = run.withColumn("words", F.sum("n_words").over(Window.partitionBy("rid", "place", "run"))).where(F.col("words") >= PASSAGE)
    run = run.where("rid <> first.rid or place <> first.place or no <> first.no")
    run = run.withColumn("run", F.col("no") - F.row_number().over(line.orderBy("no")))
    out = run.groupBy("doc_id", "rid", "place", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_words").alias("n_words"), F.min("first.doc_id").alias("kept_in"))
    return work.keep(out.drop("run"), "passages")


def paragraph_report(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, n_paragraphs, n_repeated, n_removed, removed, kept_in, passages): documents with paragraphs.

    n_repeated counts paragraphs that have a near copy, the kept ones included; ``removed`` are the places that
    go, ascending, ``passages`` the byte spans that go inside paragraphs that stay; n_removed counts both, and
    kept_in are the ids of the documents that keep their like. Rows that share a doc_id stay apart; a row
    without paragraphs has no row here, so an empty table gives none.
    """
    found, passages = duplicates(docs, similarity)
    out = found.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n_paragraphs"), F.count_if("repeated").alias("n_repeated"), F.array_sort(F.collect_list(F.when(~F.col("keep"), F.col("place")))).alias("removed"), F.collect_set(F.when(~F.col("keep"), F.col("kept_in"))).alias("kept_in"))
    inside = passages.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("passages"), F.collect_set("kept_in").alias("others"))
    out = out.join(inside, "rid", "left").withColumn("passages", F.coalesce("passages", F.array().cast("array<struct<start:int,end:int>>")))
    kept = F.array_sort(F.array_union("kept_in", F.coalesce("others", F.array().cast("array<bigint>"))))
    return out.select("doc_id", "n_paragraphs", "n_repeated", (F.size("removed") + F.size("passages")).cast("bigint").alias("n_removed"), "removed", kept.alias("kept_in"), "passages")


def _without(text: str, gone: list[int], spans: list[tuple[int, int]]) -> str:
    """``text`` without the paragraphs ``gone``, their line ends, and the byte spans."""
    raw, out, at, place = text.encode(), [], 0, 0
    gone_ = set(gone)
    for line in raw.split(b"\n"):
        begin, at = at, at + len(line) + 1
        if line.strip(b" \t\n\v\f\r"):
            place += 1
            if place - 1 in gone_:
                continue
            for a, b in sorted((s for s in spans if begin <= s[0] < at), reverse=True):
                line = line[: a - begin] + line[b - begin :]
        out.append(line)
    return b"\n".join(out).decode()


def remove_paragraphs(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the texts' removed paragraphs, their line ends, and repeated passages taken out; all columns kept.

    Rows are told apart by number, so rows that share a doc_id or have none lose only their own paragraphs.
    A null text stays null; an empty table gives an empty result.
    """
    rid, cut = fresh(docs, "rid"), fresh(docs, "cut")
    work = Work(docs.sparkSession, "paragraphs")
    base = work.keep(docs.withColumn(rid, F.monotonically_increasing_id()), "rows")
    lines, passages = duplicates(base, similarity, rid=rid)
    lines = lines.where(~F.col("keep")).select("rid", "place", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    each = lines.unionByName(passages.select("rid", F.lit(None).cast("int").alias("place"), "start", "end"))
    each = work.keep(each.groupBy(F.col("rid").alias(rid)).agg(F.collect_list("place").alias("gone"), F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", "end"))).alias("spans")).select(rid, F.struct("gone", "spans").alias(cut)), "cut")
    names = [*docs.columns, rid]
    at, where = names.index("text"), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            texts = [t if c is None or t is None else _without(t, c["gone"], [(s["start"], s["end"]) for s in c["spans"]]) for t, c in zip(texts, batch.column(where).to_pylist())]
            cols = [c for i, c in enumerate(batch.columns) if i != where]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    both = base.withColumn("text", F.col("text").cast("string")).join(each.hint("merge"), rid, "left").select(*(F.col(f"`{c}`") for c in names), cut)
    schema = T.StructType([f for f in both.schema.fields if f.name != cut])
    return both.mapInArrow(run, schema).drop(rid)
