"""Token-ID output: Parquet list columns, dictionary or delta encoded, with page indexes, and their readers.

A table of tokens is a folder of Parquet files. Row: part, doc_id, local_start, n_tokens, ids. Files are
in ascending doc_id order (part is the file's rank), rows inside a file too; ``local_start`` counts the
ids before the document within its file, so a file is complete without the others. Metadata readers
fetch the narrow columns only, and a filter on doc_id prunes row groups and pages by their indexes.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import kernels as K
from millrace.llm.storage import Work, shuffle_partitions

#: pieces remembered by a worker; beyond it those not used since the last time are forgotten
REMEMBERED = 400_000
SCHEMA = "part int, doc_id bigint, local_start bigint, n_tokens bigint, ids array<int>"
_LETTER = K.lut(range(65, 91), range(97, 123))
_PRINTING = K.lut(range(33, 127))
#: ASCII white space and every byte that may end, or begin, a longer white-space character
_MAY_END_SPACE = K.lut(range(9, 14), range(28, 33), range(0x80, 0x8B), (0x9F, 0xA0, 0xA8, 0xA9, 0xAF))
_MAY_BEGIN_SPACE = K.lut(range(9, 14), range(28, 33), (0xC2, 0xE1, 0xE2, 0xE3))
_SIMPLE = r"^ ?[\x21-\x7e\p{L}\p{N}]+$"


def cuts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Starts of pieces that a byte-level BPE tokenizer encodes alone as it does inside the text.

    Such a tokenizer first cuts a text into words with one leading blank, numbers, runs of signs and runs of
    white space, and never merges across. Surely cut are: a document's start; a blank, unless white space
    stands on both sides; whatever follows a Latin letter and is ASCII but no letter; and a letter after a
    line feed that follows a sign or letter.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before, here = data[:-1], data[1:]
        after_space = np.ones(n - 1, bool)
        after_space[:-1] = _MAY_BEGIN_SPACE[data[2:]] | edge[2:-1]
        letter = _LETTER[before]
        latin = np.zeros(n - 1, bool)
        latin[1:] = (data[:-2] == 0xC3) & (before[1:] >= 0x80) & (before[1:] != 0x97) & (before[1:] != 0xB7)
        cut[1:-1] = (here == 32) & ~(_MAY_END_SPACE[before] & after_space)
        cut[1:-1] |= (letter | latin) & (here < 128) & ~_LETTER[here] & ~((here == 32) & _MAY_END_SPACE[before] & after_space)
        line = np.zeros(n - 1, bool)
        line[1:] = _LETTER[here[1:]] & (before[1:] == 10) & _PRINTING[data[:-2]] & ~edge[1:-2]
        cut[1:-1] |= line
    cut[offsets[:-1][offsets[:-1] < n]] = True
    return np.flatnonzero(cut[:n])


class Encoder:
    """Whole-text encoding through remembered pieces: each distinct piece of a batch is looked up once, and only unknown ones reach the tokenizer.

    What the tokenizer adds to its vocabulary (special tokens) is met as the library meets it. Texts are cut
    into pieces only where that is known to change nothing: by the byte-level word pattern, without
    normalisation, and at added tokens that take no neighbours with them; else whole texts are encoded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        before = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        self.cuttable = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") is True and not before.get("add_prefix_space")
        self.cuttable &= not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
        # the leftmost is met first, and of several there the longest
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, names)).encode()) if names else None
        self.line = self.tok.encode("\n", add_special_tokens=False).ids
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        simple = pc.match_substring_regex(pa.array(new, pa.string()), _SIMPLE).to_numpy(zero_copy_only=False).tolist() if len(self.line) == 1 else [False] * len(new)
        plain = [p for p, s in zip(new, simple) if s]
        # one string for many pieces, a line feed between them: their ids are what stands between its ids
        groups = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        for group, e in zip(groups, self.tok.encode_batch_fast(["\n".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            at = [-1, *np.flatnonzero(ids == self.line[0]).tolist(), len(ids)]
            if len(at) != len(group) + 1:
                raise ValueError("the tokenizer joins a line feed with its neighbours")
            raw = ids.tobytes()
            for p, a, b in zip(group, at, at[1:]):
                self.memory[p] = raw[4 * a + 4 : 4 * b]
        rest = [p for p, s in zip(new, simple) if not s]
        for i in range(0, len(rest), 1024):
            part = rest[i : i + 1024]
            for p, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False)):
                self.memory[p] = np.array(e.ids, "<u4").tobytes()

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents in a row, and the number of ids of each."""
        if not self.cuttable:
            raw = np.ascontiguousarray(data).tobytes()
            coded = [self.tok.encode(raw[a:b].decode(), add_special_tokens=False).ids for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            return np.array([i for ids in coded for i in ids], np.uint32), np.fromiter(map(len, coded), np.int64, len(coded))
        spans = np.zeros((0, 2), offsets.dtype)
        raw = memoryview(np.ascontiguousarray(data))
        if self.added is not None and self.added.search(raw):
            spans = np.array([(m.start() + a, m.end() + a) for a, b in zip(offsets.tolist(), offsets[1:].tolist()) for m in self.added.finditer(raw[a:b])], offsets.dtype).reshape(-1, 2)
        # an added token stands alone, so what is around it is as good as a text of its own
        starts = cuts(np.unique(np.concatenate([offsets, spans.ravel()])), data)
        if len(spans):
            of = np.maximum(np.searchsorted(spans[:, 0], starts, side="right") - 1, 0)
            starts = starts[~((starts > spans[of, 0]) & (starts < spans[of, 1]))]
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        bounds = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        words = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.memory) + len(words) > REMEMBERED:
            self.memory, self.older = {}, self.memory
        memory, older = self.memory, self.older
        new = []
        for w in words:
            if w not in memory:
                if w in older:
                    memory[w] = older[w]
                else:
                    new.append(w)
        if new:
            self._learn(new)
        coded = [memory[w] for w in words]
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        flat, first = np.frombuffer(b"".join(coded), "<u4"), np.concatenate([[0], np.cumsum(size)])[:-1]
        which = pieces.indices.to_numpy()
        each = size[which]
        ends = np.cumsum(each)
        ids = flat[np.repeat(first[which] - ends + each, each) + np.arange(ends[-1])]
        total = np.concatenate([[0], ends])
        return ids, np.diff(total[np.searchsorted(starts, offsets)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, encoding: str = "dictionary", row_group_mb: int = 32, page_kb: int = 256, codec: str = "zstd", parts: int | None = None) -> None:
    """Encode every whole text (null: empty), append ``end_id`` and write the table of tokens to ``path``.

    Texts are dealt by ranges of doc_id and sorted there, ties by text; null ids come first. Repeated
    rows are written repeatedly. ``encoding``: "dictionary", or "delta" for delta binary packing. Extra
    columns are ignored. Nothing is written but an empty table for an empty input.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, before = encoder(vocabulary), 0
        for batch in batches:
            offsets, data = K.text_bytes(batch.column(2))
            for i, j in K.slices(offsets):
                ids, counts = enc.encode(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])
                ids = np.insert(ids, np.cumsum(counts), end_id).view(np.int32)
                counts += 1
                at = np.zeros(len(counts) + 1, np.int64)
                np.cumsum(counts, out=at[1:])
                values = pa.array(ids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(at[:-1] + before), pa.array(counts), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)],
                    ["part", "doc_id", "local_start", "n_tokens", "ids"],
                )
                before += int(at[-1])
        K.release()

    parts = parts or shuffle_partitions(docs.sparkSession)
    dealt = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    out = dealt.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(run, SCHEMA)
    options = {
        "compression": codec, "parquet.enable.dictionary": str(encoding == "dictionary").lower(), "parquet.writer.version": "PARQUET_2_0" if encoding == "delta" else "PARQUET_1_0",
        "parquet.block.size": str(row_group_mb << 20), "parquet.page.size": str(page_kb << 10), "parquet.page.row.count.limit": "2000",
    }
    out.write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def token_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(part, doc_id, start, n_tokens): places in the concatenation of all files, without reading any id."""
    rows = read_tokens(spark, path).select("part", "doc_id", "local_start", "n_tokens")
    return _placed(spark, path, rows)


def _placed(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    per_file = read_tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    before = per_file.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("local_start")).drop("before", "local_start")


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part) from the files alone; crc32 over the ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            at = lists.offsets.to_numpy()
            raw = memoryview(lists.values.to_numpy().astype("<i4", copy=False)).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), at[1:].tolist())]
            counts = pa.array(np.diff(at).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], counts, pa.array(sums, pa.int64())], ["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).select("part", "doc_id", "local_start", "ids").mapInArrow(run, "part int, doc_id bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint")
    return _placed(spark, path, rows).select("doc_id", "start", "n_tokens", "ids_crc32", "part")


def tokens_roundtrip(docs: DataFrame, vocabulary: str, end_id: int = 2, **options) -> DataFrame:
    """Write ``docs`` to a new table of tokens in the shared folder and return its digest as read back."""
    path = Work(docs.sparkSession, "tokens").path("ids")
    write_tokens(docs, path, vocabulary, end_id, **options)
    return token_digest(docs.sparkSession, path)
