"""Benchmark decontamination by template canonicalisation.

Numbers, units after numbers and capitalised words inside sentences become typed placeholders; windows
of five tokens of the result are joined by hash with those of the benchmark's items. A document holds an
item if it has at least 0.8 of the item's windows and its slots are filled consistently: at one
alignment, equal values of the item stand against equal values of the document. So both literal copies
and re-parameterised ones are found. A capitalised word that opens a sentence may be a name or not: windows
with such words are kept in both forms, as they are and with placeholders, and either form may be met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernels as K
from millrace.llm.storage import Work, fresh

#: units that follow a number
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers mg g kg gram grams kilogram kilograms lb lbs pound pounds ounce ounces ton tons tonnes "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent degrees celsius fahrenheit kelvin "
    "usd dollar dollars cent cents eur euro euros mph kmh hz khz mhz ghz w kw v volts amps joules watts newtons kb mb gb tb bytes bits"
).split()
#: words that open sentences without being names
OPENERS = (
    "a an the this that these those i you he she it we they my your his her its our their one two three four five six seven eight nine ten each every all both some any many much more most no none "
    "in on at by for from to of with without after before during since until under over between about into out up down and or but so yet nor as if when while because although though then thus hence therefore however also there here now "
    "how what which who whom whose where why is are was were be been do does did has have had can could may might must shall should will would let find calculate compute determine solve show prove give given write suppose assume consider note use not"
).split()
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0x4E554D, 0x4E414D, 0x554E54))
#: windows of a benchmark up to which its hashes are sent to the scanning tasks (8 bytes each)
MOST_SENT = 1 << 22
_DIGIT, _UPPER, _BREAK = K.lut(range(48, 58)), K.lut(range(65, 91)), K.lut(b".!?:\n\r")


def _hashes(words: list[str]) -> np.ndarray:
    raw = [np.frombuffer(u.encode(), np.uint8) for u in words]
    return np.unique(np.concatenate([K.span_hash(K.prefix_sums(r), np.array([0]), np.array([len(r)])) for r in raw]))


def _words(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to words."""
    digit, inside = _DIGIT[data], K.WORD[data]
    if len(data) > 2:  # a point or comma between digits belongs to the number
        point = (data[1:-1] == 46) | (data[1:-1] == 44)
        inside = inside.copy()
        inside[1:-1] |= point & digit[:-2] & digit[2:]
    return inside


def template(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tokens of whole documents: first byte, owner, hash of the lower-cased value, hash of the canonical form, placeholder flag, and flag of sentence openers that may be names."""
    start, end = K.runs(_words(data), offsets)
    value = K.span_hash(K.prefix_sums(K.LOWER[data]), start, end)
    owner = np.searchsorted(offsets, start, side="right") - 1
    if not len(start):
        return start, owner, value, value, np.zeros(0, bool), np.zeros(0, bool)
    first = data[start]
    second = data[np.minimum(start + 1, end - 1)]
    upper = _UPPER[first] | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    after = data[np.minimum(start + np.where(first == 0xC3, 2, 1), end - 1)]
    mixed = (end - start > 1) & ~_UPPER[after]
    breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])
    opens = np.ones(len(start), bool)
    opens[1:] = (breaks[start[1:]] > breaks[end[:-1]]) | (owner[1:] != owner[:-1])
    number = _DIGIT[first]
    unit = np.zeros(len(start), bool)
    unit[1:] = number[:-1] & (owner[1:] == owner[:-1]) & np.isin(value[1:], _hashes(UNITS))
    name = upper & mixed & ~opens
    form = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, value)))
    maybe = upper & mixed & opens & ~unit
    maybe[maybe] = ~np.isin(value[maybe], _hashes(OPENERS))
    return start, owner, value, form, number | unit | name, maybe


def _sequences(form: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k`` tokens from each start on, as whole sequences."""
    out = np.zeros(len(starts), np.uint64)
    for j in range(k):
        out = out * K._ODD + form[starts + j]
    return K.mix(out) ^ np.uint64(k)


def windows(offsets: np.ndarray, data: np.ndarray, size: int, lines: bool = False) -> tuple[np.ndarray, ...]:
    """Window hashes with owner and first token, the end of each window's sequence, the tokens' values and placeholder
    flags (literal openers, then open ones), and for each hash whether it has placeholders for openers and the window's own hash.

    A window with fewer than two literal tokens is hashed by its values. A document of fewer than
    ``size`` tokens has one window, the whole sequence; with ``lines`` so has each line of so few.
    """
    start, owner, value, form, slot, maybe = template(offsets, data)
    n = len(owner)
    counts = np.bincount(owner, minlength=len(offsets) - 1)
    ends = np.cumsum(counts)
    full = np.flatnonzero(owner[: n - size + 1] == owner[size - 1 :]) if n >= size else np.zeros(0, np.int64)
    few = np.flatnonzero((counts > 0) & (counts < size))
    begin, length = ends[few] - counts[few], counts[few]
    if lines and n:
        feeds = np.concatenate([[0], np.cumsum(data == 10)])
        first = np.flatnonzero(np.diff(np.concatenate([[-1], feeds[start] + owner])))
        each = np.diff(np.append(first, n))
        mine = (each < size) & (each < counts[owner[first]])  # a document of one short line has its window already
        begin, length = np.append(begin, first[mine]), np.append(length, each[mine])

    def hashed(form: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each window, and whether it is one of values."""
        slots = np.concatenate([[0], np.cumsum(slot)])
        hashes, bare = np.zeros(len(full) + len(begin), np.uint64), np.zeros(len(full) + len(begin), bool)
        if len(full):
            b = (slots[size:] - slots[:-size] > size - 2)[full]
            hashes[: len(full)], bare[: len(full)] = np.where(b, K.combine(value, size)[full], K.combine(form, size)[full]), b
        for k in range(1, size):
            at = np.flatnonzero(length == k)
            starts = begin[at]
            b = k - (slots[starts + k] - slots[starts]) < min(2, k)
            hashes[len(full) + at], bare[len(full) + at] = np.where(b, _sequences(value, starts, k), _sequences(form, starts, k)), b
        return hashes, bare

    hashes, _ = hashed(form, slot)
    at = np.append(full, begin)
    until = np.append(full + size, begin + length)
    open_slot = slot | maybe
    if maybe.any():
        other, bare = hashed(np.where(maybe, NAME, form), open_slot)
        openers = np.concatenate([[0], np.cumsum(maybe)])
        twice = np.flatnonzero(~bare & (openers[until] > openers[at]))
        other = other[twice]
    else:
        twice, other = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    opened = np.arange(len(at) + len(twice)) >= len(at)
    own = np.append(hashes, hashes[twice])
    at, until = np.append(at, at[twice]), np.append(until, until[twice])
    return np.append(hashes, other), owner[at], at, until, value, (slot, open_slot), opened, own


def _table(rows: DataFrame, size: int, wanted=None, lines: bool = False) -> DataFrame:
    """Windows of rows whose last column is a text: the other columns, and w, own, at, slots (hash, place in the text, hashes of the values in its slots).

    own is the window's hash with literal sentence openers, w that or the one with placeholders for them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if wanted is None else wanted.value
        if known is not None:
            sieve = np.zeros(1 << 20, bool)
            sieve[(known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for batch in batches:
            offsets, data = K.text_bytes(batch.column(batch.num_columns - 1))
            for i, j in K.slices(offsets):
                hashes, owner, at, until, value, flags, opened, own = windows(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]], size, lines)
                if known is not None:
                    hit = np.flatnonzero(sieve[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
                    if len(known):
                        place = np.minimum(np.searchsorted(known, hashes[hit]), len(known) - 1)
                        hit = hit[known[place] == hashes[hit]]
                    else:
                        hit = hit[:0]
                    hashes, owner, at, until, opened, own = hashes[hit], owner[hit], at[hit], until[hit], opened[hit], own[hit]
                if not len(hashes):
                    continue
                slots = [value[a:b][slot[a:b]].view(np.int64).tolist() if slot[a:b].any() else [] for a, b, slot in zip(at.tolist(), until.tolist(), (flags[k] for k in opened.tolist()))]
                of = pa.array(owner + i)
                yield pa.RecordBatch.from_arrays([*(c.take(of) for c in batch.columns[:-1]), pa.array(hashes.view(np.int64)), pa.array(own.view(np.int64)), pa.array(at), pa.array(slots, pa.list_(pa.int64()))], [*batch.schema.names[:-1], "w", "own", "at", "slots"])
        K.release()

    lead = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, lead + "w bigint, own bigint, at bigint, slots array<bigint>")


def _pairs(rows: DataFrame, key: list[str], benchmark: DataFrame, size: int, similarity: float, most_sent: int, work: Work) -> DataFrame:
    """The columns ``key`` with item_id, item_windows, matched, coverage, slots and conflicts, for rows (key, text) that hold an item."""
    spark = rows.sparkSession
    texts = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    items = _table(texts.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), size)
    items = work.keep(items, "item_windows")
    items = items.groupBy("item", "item_id", "w", "own").agg(F.min_by(F.struct("at", "slots"), F.struct("at", F.to_json("slots"))).alias("s")).select("item", "item_id", "w", "own", F.col("s.at").alias("item_at"), F.col("s.slots").alias("item_slots"))
    items = work.keep(items, "items")
    wanted = None
    if items.count() <= most_sent:
        wanted = spark.sparkContext.broadcast(np.unique(items.select("w").toArrow().column(0).to_numpy().view(np.uint64)))
    sizes = items.groupBy(F.col("item").alias("of")).agg(F.countDistinct("own").alias("item_windows"))
    found = _table(rows, size, wanted, lines=True)
    found = found.select(*key, "w", "at", "slots", (F.col("w") == F.col("own")).alias("plain"))
    met = found.join(items, "w").withColumn("plain", F.col("plain") & (F.col("w") == F.col("own")))
    # once with openers as they are on both sides (names l_...), once in either form (e_...)
    pair = F.arrays_zip(F.col("item_slots").alias("b"), F.col("slots").alias("d"))
    forms = (("l", lambda c: F.when(F.col("plain"), c)), ("e", lambda c: c))
    line = met.groupBy(*key, "item", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        *(F.collect_set(of(F.col("own"))).alias(f"{x}_hits") for x, of in forms),
        *(F.array_distinct(F.flatten(F.collect_set(of(pair)))).alias(f"{x}_pairs") for x, of in forms),
    )
    for x, _ in forms:
        line = line.withColumn(f"{x}_values", F.size(F.array_distinct(F.transform(f"{x}_pairs", lambda p: p["b"]))))
    whole = line.groupBy(*key, "item", "item_id").agg(
        *(F.size(F.array_distinct(F.flatten(F.collect_set(f"{x}_hits")))).alias(f"{x}_matched") for x, _ in forms),
        *(F.sum(f"{x}_values").alias(f"{x}_slots") for x, _ in forms),
        *(F.sum(F.size(f"{x}_pairs") - F.col(f"{x}_values")).alias(f"{x}_conflicts") for x, _ in forms),
    )
    out = whole.join(sizes, F.col("item") == F.col("of"))
    kept = {x: (F.col(f"{x}_matched") / F.col("item_windows") >= similarity) & (F.col(f"{x}_conflicts") <= (1 - similarity) * F.col(f"{x}_slots")) for x, _ in forms}
    out = out.where(kept["l"] | kept["e"])
    for c in ("matched", "slots", "conflicts"):
        out = out.withColumn(c, F.when(kept["l"], F.col(f"l_{c}")).otherwise(F.col(f"e_{c}")))
    return out.select(*key, "item_id", "item_windows", "matched", (F.col("matched") / F.col("item_windows")).alias("coverage"), "slots", "conflicts")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 5, similarity: float = 0.8, most_sent: int = MOST_SENT) -> DataFrame:
    """(doc_id, item_id, item_windows, matched, coverage, slots, conflicts): rows of ``docs`` with an item that they hold.

    coverage: share of the item's distinct windows found in the document. matched, slots and conflicts count
    windows with sentence openers as they are, or in either form where those alone do not suffice. Every row is
    judged by itself, whether it shares its id or has none; so is every item, but repeated rows of the
    benchmark count once. Null and empty texts hold nothing and are held by nothing; an item of fewer than
    ``size`` tokens is held by a document with a line, or a whole text, of just it. Ties in an item's windows go to the first. Repeated rows of
    ``docs`` are repeated in the result; extra columns are ignored; empty tables give an empty result. Texts are
    read whole: a worker's memory follows the longest text, about forty times its bytes.
    """
    work = Work(docs.sparkSession, "decontaminate")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _pairs(rows, ["rid", "doc_id"], benchmark, size, similarity, most_sent, work).drop("rid")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that hold no item of ``benchmark``, all columns kept, whatever their names.

    A verdict follows from the text alone, so rows are told by its digest: null and shared ids matter not, and
    repeated rows go or stay together. A null text stays. Empty tables: nothing goes.
    """
    work = Work(docs.sparkSession, "decontaminate")
    digest = F.md5(F.col("text").cast("string").cast("binary"))
    found = _pairs(docs.select(digest.alias("digest"), F.col("text").cast("string").alias("text")), ["digest"], benchmark, size, similarity, MOST_SENT, work)
    gone = fresh(docs, "digest")
    found = work.keep(found.select(F.col("digest").alias(gone)).distinct(), "found")
    work.prune("found")
    return docs.join(found, digest == F.col(gone), "left_anti")
