"""Words of whole Arrow text columns as 64-bit hashes, in numpy.

A word is a run of bytes that are ASCII letters, digits or part of a non-ASCII character, with A-Z
in lower case: `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the lower-cased text. Memory is bounded by blocks
of BLOCK bytes (a longer single word makes a longer block), so texts may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1

#: Byte to lower case; 0 for bytes between words.
FOLD = np.zeros(256, dtype=np.uint8)
for _b in range(256):
    if chr(_b) in "0123456789abcdefghijklmnopqrstuvwxyz" or _b >= 128:
        FOLD[_b] = _b
    elif chr(_b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        FOLD[_b] = _b + 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(n + 1, _BASE, dtype=np.uint64)
        up[0] = 1
        down = np.full(n + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; nulls are empty."""
    column = pa.chunked_array([column]).combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8), offsets


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about limit bytes of a text column, one row at least: bounds the memory of a step."""
    offsets = text_buffer(batch.column(column))[1]
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words_of(data: np.ndarray, edges: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hash and start of every word between edges[0] and edges[-1]; no word crosses an edge.

    For each length in prefixes one array more: hashes of the first bytes, 0 for words not longer.
    """
    hashes, starts, heads = [], [], [[] for _ in prefixes]
    at, end = int(edges[0]), int(edges[-1])
    while at < end:
        to = min(at + BLOCK, end)
        if to < end:  # back to the last gap or edge, else on to the next one
            edge = int(edges[np.searchsorted(edges, to, side="right") - 1])
            gaps = np.flatnonzero(FOLD[data[max(at, edge):to]] == 0)
            if len(gaps):
                to = max(at, edge) + int(gaps[-1]) + 1
            elif edge > at:
                to = edge
            else:
                limit = int(edges[np.searchsorted(edges, to, side="left")])
                while to < limit and FOLD[data[to]]:
                    to += 1
        folded = FOLD[data[at:to]]
        inside = folded != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cuts = edges[np.searchsorted(edges, at, side="right"): np.searchsorted(edges, to, side="left")] - at
        if len(cuts):
            first[cuts] = inside[cuts]
            last[cuts - 1] = inside[cuts - 1]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _powers(max(BLOCK, 1 << (to - at - 1).bit_length()))
        total = np.zeros(to - at + 1, dtype=np.uint64)
        np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * up[: to - at], out=total[1:])
        hashes.append(mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)))
        starts.append(a + at)
        for k, out in zip(prefixes, heads, strict=True):
            cut = np.minimum(a + k, b)
            out.append(np.where(b - a > k, mix((total[cut] - total[a]) * down[a] + np.uint64(k << 32)), np.uint64(0)))
        at = to
    none = np.zeros(0, np.uint64)
    join = lambda x: np.concatenate(x) if x else none
    return (join(hashes), join(starts).astype(np.int64), *map(join, heads))


def column_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a text column and, for each row, where its words begin (one more at the end)."""
    data, offsets = text_buffer(column)
    edges = np.unique(offsets)
    hashes, starts = words_of(data, edges) if len(edges) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return hashes, np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows; fewer words than k are one window, none is none."""
    if len(words) == 0:
        return words
    n = max(1, len(words) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(min(k, len(words))):
        out = out * np.uint64(0x100000001B3) + words[j: j + n]
    return mix(out)
