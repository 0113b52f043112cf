"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts of up to ``ORDER`` bytes, kept as sorted keys. A byte is coded in
the longest known context; where it was never seen there, an escape is coded and the next shorter context
takes over, without the bytes that the longer one would have coded (method C with exclusion). Statistics
are frozen after training, so a byte's code length depends on its context only: an escape's cost and that
of the shorter context add up, and each different run of bytes in a batch is costed once. A text's
language is the one with the shortest code.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernels as K
from millrace.llm.learning import bounded_sample, held_out, learnable
from millrace.llm.storage import Work

#: longest context in bytes; a context and its byte fit in a machine word
ORDER = 4
#: a context of two bytes or more that was seen less often is left out, in training texts of any size
LEAST = 2
_PAD = 32  # a document begins as after blanks


def _low(n: int) -> np.int64:
    """A mask of the last ``n`` bytes."""
    return np.int64((1 << (8 * n)) - 1)


def grams(data: np.ndarray, starts: np.ndarray, a: int, b: int) -> np.ndarray:
    """Of the bytes a .. b - 1, each with the ``ORDER`` bytes before it in its document, the last byte lowest. ``starts``: where documents begin."""
    out = data[a:b].astype(np.int64)
    for back in range(1, ORDER + 1):
        c = np.full(b - a, _PAD, np.int64)
        skip = max(0, back - a)
        c[skip:] = data[a + skip - back : b - back]
        for k in range(back):
            at = starts[np.searchsorted(starts, a - k) : np.searchsorted(starts, b - k)] + k - a
            c[at] = _PAD
        out |= c << np.int64(8 * back)
    return out


@dataclass
class Layer:
    """Contexts of one length: seen (context, byte) with its bits, and each context with the bits of its escape."""

    seen: np.ndarray
    bits: np.ndarray
    context: np.ndarray
    escape: np.ndarray


def tree(gram: np.ndarray, count: np.ndarray, least: int = LEAST) -> list[Layer]:
    """One language's contexts from counts of (``ORDER`` bytes, byte), shortest first."""
    layers: list[Layer] = []
    for k in range(ORDER + 1):
        seen, at = np.unique(gram & _low(k + 1), return_inverse=True)
        n_seen = np.bincount(at, weights=count, minlength=len(seen))
        context, of = np.unique(seen >> 8, return_inverse=True)
        n, q = np.bincount(of, weights=n_seen, minlength=len(context)), np.bincount(of, minlength=len(context))
        if k > 1:
            known = n >= least
            mine = known[of]
            seen, n_seen, context, n, q = seen[mine], n_seen[mine], context[known], n[known], q[known]
            of = (np.cumsum(known) - 1)[of[mine]]
        if k:
            shorter = layers[-1]  # whatever is seen after a context is seen after its end, at least as often
            before = np.exp2(-shorter.bits[np.searchsorted(shorter.seen, seen & _low(k))])
        else:
            before = np.full(len(seen), 1 / 256)
        left = 1 - np.bincount(of, weights=before, minlength=len(context))
        escapes = left > 1e-9  # else every byte that the shorter context knows was seen here
        bits = np.log2((n + np.where(escapes, q, 0))[of] / n_seen)
        escape = np.where(escapes, np.log2((n + q) / q * np.maximum(left, 1e-9)), 40.0)
        layers.append(Layer(seen, bits, context, escape))
    return layers


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, keys), max(len(sorted_keys) - 1, 0))
    return at, (sorted_keys[at] == keys) if len(sorted_keys) else np.zeros(len(keys), bool)


class Model:
    """Languages in order, each with its tree."""

    def __init__(self, trees: dict[str, list[Layer]]):
        self.languages = sorted(trees)
        self.trees = [trees[x] for x in self.languages]

    def costs(self, layers: list[np.ndarray], shorter: list[np.ndarray]) -> np.ndarray:
        """Bits of the different runs of ``ORDER`` + 1 bytes, layers[-1], under each language; layers[k] are those of k + 1 bytes, shorter[k] their places in layers[k - 1]."""
        out = np.empty((len(self.trees), len(layers[-1])))
        for i, t in enumerate(self.trees):
            cost = np.full(1, 8.0)
            for k, runs in enumerate(layers):
                at, hit = _find(t[k].seen, runs)
                place, known = _find(t[k].context, runs >> 8)
                below = cost[shorter[k]]
                if len(t[k].context):
                    below = below + np.where(known, t[k].escape[place], 0.0)
                cost = np.where(hit, t[k].bits[at], below) if len(t[k].seen) else below
            out[i] = cost
        return out

    def code_lengths(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Bits of each document under each language; bytes are costed some at a time, so memory does not follow a document's length."""
        out = np.zeros((len(offsets) - 1, len(self.trees)))
        starts = np.unique(offsets[:-1][offsets[1:] > offsets[:-1]])
        owners = np.flatnonzero(offsets[1:] > offsets[:-1])
        for a in range(0, len(data), K.SLICE_BYTES):
            b = min(a + K.SLICE_BYTES, len(data))
            runs, where = np.unique(grams(data, starts, a, b), return_inverse=True)
            layers, shorter = [runs], []
            for k in range(ORDER, 0, -1):
                less, at = np.unique(layers[0] & _low(k), return_inverse=True)
                layers.insert(0, less)
                shorter.insert(0, at)
            shorter.insert(0, np.zeros(len(layers[0]), np.int64))
            first = int(np.searchsorted(starts, a, side="right")) - 1
            last = int(np.searchsorted(starts, b))
            cuts = np.maximum(starts[first:last] - a, 0)
            for i, cost in enumerate(self.costs(layers, shorter)):
                out[owners[first:last], i] += np.add.reduceat(cost[where], cuts)
        return out


def train(docs: DataFrame, docs_per_language: int = 600) -> Model | None:
    """A model from about ``docs_per_language`` whole texts of each language among the learnable rows; None without any.

    That sample is written once; a task builds the tree of a language, and only trees reach the driver.
    """
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(learnable() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    work = Work(docs.sparkSession, "language")
    sample = work.keep(bounded_sample(rows, "lang", docs_per_language), "sample")

    def build(table: pa.Table) -> pa.Table:
        counts: list[tuple[np.ndarray, np.ndarray]] = []
        for chunk in table.column("text").chunks:
            offsets, data = K.text_bytes(chunk)
            starts = np.unique(offsets[:-1][offsets[1:] > offsets[:-1]])
            for a in range(0, len(data), K.SLICE_BYTES):
                counts.append(np.unique(grams(data, starts, a, min(a + K.SLICE_BYTES, len(data))), return_counts=True))
        gram, at = np.unique(np.concatenate([g for g, _ in counts] or [np.zeros(0, np.int64)]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([n for _, n in counts] or [np.zeros(0)]), minlength=len(gram))
        layers = tree(gram, n)
        parts = [pa.array([getattr(x, f).tobytes() for x in layers], pa.binary()) for f in ("seen", "bits", "context", "escape")]
        lang = table.column("lang")[0].as_py()
        K.release()
        return pa.table([pa.array([lang] * len(layers), pa.string()), pa.array(range(len(layers)), pa.int32()), *parts], ["lang", "layer", "seen", "bits", "context", "escape"])

    got = sample.select("lang", "text").groupBy("lang").applyInArrow(build, "lang string, layer int, seen binary, bits binary, context binary, escape binary")
    trees: dict[str, list[Layer]] = {}
    for r in sorted(got.collect(), key=lambda r: (r.lang, r.layer)):  # bounded by the sample
        trees.setdefault(r.lang, []).append(Layer(np.frombuffer(r.seen, np.int64), np.frombuffer(r.bits), np.frombuffer(r.context, np.int64), np.frombuffer(r.escape)))
    work.drop(work.root)
    return Model(trees) if trees else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits_per_byte) for every row.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. score: the
    prediction's posterior under equal priors, from the code lengths. Ties go to the smaller name. Repeated
    rows are repeated, extra columns ignored whatever their names; an empty table gives an empty result. Texts are read
    whole, half a megabyte at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            text = batch.column(2)
            letter = pc.match_substring_regex(text.fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)
            offsets, data = K.text_bytes(text)
            names, score, rate = np.full(len(text), "und", object), np.zeros(len(text)), np.zeros(len(text))
            if m is not None:
                bits = m.code_lengths(offsets, data)
                low = bits.min(1)
                names[:] = np.array(m.languages, object)[bits.argmin(1)]
                score = 1.0 / np.exp2(low[:, None] - bits).sum(1)
                rate = low / np.maximum(np.diff(offsets), 1)
            names[~letter], score[~letter] = "und", 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(rate)], ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])
        K.release()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, bits_per_byte double")


def language_id(docs: DataFrame, docs_per_language: int = 600) -> DataFrame:
    return identify(docs, train(docs, docs_per_language))
