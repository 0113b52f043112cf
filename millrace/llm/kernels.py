"""Vectorised byte kernels shared by the operators: Arrow text access, word runs and word hashes.

Everything here works on a slice of a batch: some whole documents, about ``SLICE_BYTES`` together
(one longer document forms a slice of its own), so temporary arrays stay bounded by the largest
document rather than by the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

SLICE_BYTES = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n+1) and UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of documents of about ``limit`` bytes; at least one document each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text, as its number of bytes ``n`` and its compressed bytes ``z``; null counts as empty."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        offsets, data = text_bytes(batch.column(batch.num_columns - 1))
        raw = memoryview(np.ascontiguousarray(data))
        at = offsets.tolist()
        cols = [pa.array(np.diff(offsets)), pa.array([squeeze(raw[a:b]) for a, b in zip(at, at[1:])], pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], [*batch.schema.names[:-1], "n", "z"])
    release()


def slabs(n: pa.Array, z: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Some whole documents of packed texts at a time, expanded: the first, the one behind the last, their offsets and bytes."""
    expand = zstandard.ZstdDecompressor().decompress
    offsets = np.concatenate([[0], np.cumsum(n.to_numpy())])
    for i, j in slices(offsets):
        yield i, j, offsets[i : j + 1] - offsets[i], np.frombuffer(b"".join(expand(x) for x in z.slice(i, j - i).to_pylist()), np.uint8)


def release() -> None:
    """Give freed memory back to the system, so that a worker waiting for its next task is small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it keeps
        pass


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base modulo 2**64 and their inverses, at least ``n`` of each."""
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, 1 << 16)
        step = np.full(n, _ODD, np.uint64)
        step[0] = 1
        back = np.full(n, np.uint64(pow(int(_ODD), -1, 1 << 64)), np.uint64)
        back[0] = 1
        _powers, _inverse = np.multiply.accumulate(step), np.multiply.accumulate(back)
    return _powers, _inverse


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (splitmix64's finaliser)."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """P with P[i] the polynomial hash of the first i bytes; any substring's hash follows from two entries."""
    pw, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pw[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end)."""
    _, inv = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of true bytes; a run never crosses a document's edge."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets[(offsets >= 0) & (offsets <= n)]] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end


def lut(chars: bytes | range, *more: range) -> np.ndarray:
    out = np.zeros(256, bool)
    for c in chars:
        out[c] = True
    for r in more:
        out[list(r)] = True
    return out


#: ASCII white space, as in the word pattern [^\x20\x09-\x0D]+
NOT_SPACE = ~lut(b" \t\n\v\f\r")
#: letters, digits and every byte of a non-ASCII character
WORD = lut(range(48, 58), range(65, 91), range(97, 123), range(128, 256))
#: A-Z to a-z
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent hashes of all windows of ``n`` consecutive hashes (len - n + 1 of them)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * _ODD + hashes[k : k + m]
    return mix(out)


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node of each one's component, for links (a, b) that fit in a task."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new
