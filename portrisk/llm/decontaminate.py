"""Benchmark decontamination: benchmark items in documents, by edit distance over words.

The CGK walk turns a word sequence into one of three times its length: at each step it emits the
current word and moves on if a random bit of (step, word) says so. Sequences at small edit distance
end up at small Hamming distance, so sampled places of the output are a locality-sensitive hash.
Windows of an item's size at every word of every document are hashed by WALKS walks of SAMPLES samples
each; a window and an item with an equal sample are compared exactly: the least edit distance of the
item to any part of the window's neighbourhood must be at most MAX_EDITS of the item's words.

Before the walk a lossless count filter: within k edits, an n-word window has n - k words and
n - 1 - 2k word pairs of items. Other windows can't match, and these are nearly all.

Items are a query set of any size: they are taken in blocks of at most BLOCK_BYTES, each of which is
broadcast and meets all documents.

Edge cases: null texts are empty; items without a word match nothing; equal items match each; rows with
equal ids stay separate rows; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portrisk.llm.words import column_words, mix, slices

MAX_EDITS = 0.2
WALKS = 6
SAMPLES = 8
#: Two: at MAX_EDITS, items of 120 words are found; with three, 6 % of them were not.
PLACES = 2
BLOCK_BYTES = 16_000_000
#: Words of the windows that are sampled together.
WINDOW_WORDS = 1 << 18
SEED = 20_240_601


class ItemIndex:
    """Items by their number of words, with the count filter's sets and the hashed samples of their walks."""

    def __init__(self, words: list[np.ndarray], max_edits: float = MAX_EDITS):
        self.words, self.max_edits = words, max_edits
        some = [w for w in words if len(w)]
        self.single = np.unique(np.concatenate(some)) if some else np.zeros(0, np.uint64)
        self.pairs = np.unique(np.concatenate([pairs(w) for w in some])) if some else np.zeros(0, np.uint64)
        self.by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w):
                self.by_size.setdefault(len(w), []).append(i)
        # For each word pair, the sizes of items that hold it, as bits; beyond 64 sizes, some share a bit.
        self.bit = {n: np.uint64(i % 64) for i, n in enumerate(self.by_size)}
        self.sizes = np.zeros(len(self.pairs), dtype=np.uint64)
        for n, at in self.by_size.items():
            for i in at:
                self.sizes[np.searchsorted(self.pairs, pairs(words[i]))] |= np.uint64(1) << self.bit[n]
        # The samples of all items of a size in order, each with its item.
        self.keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, at in self.by_size.items():
            step = self.windows_at_once(n)
            keys = np.concatenate([self.samples(np.stack([words[i] for i in at[a: a + step]])) for a in range(0, len(at), step)])
            owner = np.repeat(np.array(at), keys.shape[1])
            # A sample of places past the end of the walk is the same for all and says nothing.
            telling = ~np.isin(keys, past_the_end()).ravel()
            flat, owner = keys.ravel()[telling], owner[telling]
            order = np.argsort(flat, kind="stable")
            self.keys[n] = flat[order], owner[order]

    @staticmethod
    def windows_at_once(n: int) -> int:
        """Windows of n words that are sampled together: about WINDOW_WORDS words."""
        return max(1, WINDOW_WORDS // n)

    def lookup(self, keys: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
        """Items that share a sample with rows of samples, and these rows in order."""
        known, owner = self.keys[n]
        flat = keys.ravel()
        low, high = np.searchsorted(known, flat, side="left"), np.searchsorted(known, flat, side="right")
        hit = np.flatnonzero(high > low)
        if not len(hit):
            return []
        count = (high - low)[hit]
        at = np.repeat(low[hit], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        met = np.unique(owner[at].astype(np.int64) * len(keys) + np.repeat(hit // keys.shape[1], count))
        item, row = met // len(keys), met % len(keys)
        edges = [0, *(np.flatnonzero(np.diff(item)) + 1).tolist(), len(item)]
        return [(int(item[a]), row[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def edits(self, n):
        return np.floor(np.asarray(n) * self.max_edits + 1e-9).astype(np.int64)

    def samples(self, windows: np.ndarray) -> np.ndarray:
        """Hashes of the sampled places of all walks: windows by WALKS * SAMPLES."""
        count, n = windows.shape
        padded = np.hstack([windows, np.zeros((count, 1), np.uint64)])
        out = np.empty((count, WALKS * SAMPLES), dtype=np.uint64)
        for walk in range(WALKS):
            rng = np.random.default_rng((SEED, walk, n))
            places = rng.integers(0, 2 * n, size=(SAMPLES, PLACES))  # later steps are mostly past the end
            salts = rng.integers(0, 1 << 63, size=3 * n, dtype=np.uint64)
            at, emitted = np.zeros(count, dtype=np.int64), np.empty((places.max() + 1, count), dtype=np.uint64)
            for step in range(len(emitted)):
                word = padded[np.arange(count), at]
                emitted[step] = word
                at = np.minimum(at + (mix(word ^ salts[step]) & np.uint64(1)).astype(np.int64), n)
            for s in range(SAMPLES):
                key = np.full(count, np.uint64(walk * SAMPLES + s + 1))
                for p in places[s]:
                    key = mix(key * np.uint64(0x100000001B3) + emitted[p])
                out[:, walk * SAMPLES + s] = key
        return out

    def search(self, words: np.ndarray, edge: np.ndarray, single: np.ndarray, sizes: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """By document and item: least distance, first word and words of the place, earliest first.

        edge: where each document's words begin; single: words of items before each word; sizes: item sizes by word pair.
        """
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        at = np.arange(len(words))
        stop = np.repeat(edge[1:], np.diff(edge))  # windows may lack words at the end of a document
        for n in self.by_size:
            k = int(self.edits(n))
            end = np.minimum(at + n, stop)
            double = np.zeros(len(words) + 1, dtype=np.int32)
            np.cumsum((sizes >> self.bit[n]) & np.uint64(1), out=double[1: len(sizes) + 1])
            double[len(sizes) + 1:] = double[len(sizes)]
            start = at[(double[np.maximum(end - 1, at)] - double[at] >= n - 1 - 2 * k) & (single[end] - single[at] >= n - k)]
            step = self.windows_at_once(n)
            for a in range(0, len(start), step):
                some = start[a: a + step]
                places = some[:, None] + np.arange(n)
                keys = self.samples(np.where(places < stop[some][:, None], words[np.minimum(places, len(words) - 1)], np.uint64(0)))
                document = np.searchsorted(edge, some, side="right") - 1
                for item, met in self.lookup(keys, n):
                    own, own_pairs = np.sort(self.words[item]), np.sort(pairs(self.words[item]))
                    # Windows that follow each other are one region, compared once.
                    breaks = np.flatnonzero((document[met][1:] != document[met][:-1]) | (np.diff(some[met]) > n)) + 1
                    for run in np.split(met, breaks):
                        d = int(document[run[0]])
                        low, high = max(int(edge[d]), int(some[run[0]]) - k), min(int(edge[d + 1]), int(some[run[-1]]) + n + k)
                        # The count filter once more, with this item's words and pairs only.
                        if member(own_pairs, pairs(words[low:high])).sum() < n - 1 - 2 * k or member(own, words[low:high]).sum() < n - k:
                            continue
                        if (best := nearest(self.words[item], words[low:high])) and best[0] <= k:
                            place = (best[0], low - int(edge[d]) + best[1], best[2])
                            if (d, item) not in found or place < found[d, item]:
                                found[d, item] = place
        return found


def past_the_end() -> np.ndarray:
    """Keys of samples that hold no word, in the order of samples()."""
    keys = np.arange(1, WALKS * SAMPLES + 1, dtype=np.uint64)
    for _ in range(PLACES):
        keys = mix(keys * np.uint64(0x100000001B3))
    return keys


def pairs(words: np.ndarray) -> np.ndarray:
    return mix(words[:-1] * np.uint64(0x100000001B3) + words[1:])


def nearest(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int] | None:
    """Least edit distance of the item to a part of region, with the part's start and length."""
    if not len(region):
        return None
    m = len(region)
    cost, start, steps = np.zeros(m + 1, dtype=np.int64), np.arange(m + 1), np.arange(m + 1)
    scale = m + 2  # cost and start in one number, so that the least one takes its start along
    for i, word in enumerate(item):
        before = cost * scale + start
        now = np.empty(m + 1, dtype=np.int64)
        now[0] = (i + 1) * scale
        now[1:] = np.minimum(before[:-1] + scale * (region != word), before[1:] + scale)
        now = np.minimum.accumulate(now - scale * steps) + scale * steps
        cost, start = now // scale, now % scale
    end = int(np.lexsort((steps, cost))[0])
    return int(cost[end]), int(start[end]), end - int(start[end])


def member(sorted_set: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(x), dtype=bool)
    at = np.searchsorted(sorted_set, x)
    return sorted_set[np.minimum(at, len(sorted_set) - 1)] == x


class BitTable:
    """A set of hashes behind a table of their upper 20 bits."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.table = np.zeros(1 << 20, dtype=bool)
        self.table[(values >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, x: np.ndarray) -> np.ndarray:
        out = self.table[(x >> np.uint64(44)).astype(np.int64)]
        maybe = np.flatnonzero(out)
        out[maybe] = member(self.values, x[maybe])
        return out


def _search_block(docs: DataFrame, items: list, max_edits: float) -> DataFrame:
    ids = [r["item_id"] for r in items]
    words, edge = column_words(pa.array([r["text"] for r in items], pa.string()))
    shared = docs.sparkSession.sparkContext.broadcast((ids, ItemIndex([words[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)], max_edits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, index = shared.value
        singles, doubles = BitTable(index.single), BitTable(index.pairs)
        for batch in (x for b in batches for x in slices(b, "_text")):
            words, edge = column_words(batch.column("_text"))
            one = np.concatenate([[0], np.cumsum(singles.hits(words))])
            double = pairs(words) if len(words) else words
            hit = np.flatnonzero(doubles.hits(double))
            sizes = np.zeros(len(double), dtype=np.uint64)
            sizes[hit] = index.sizes[np.searchsorted(index.pairs, double[hit])]
            rows = [(i, ids[item], first, count, distance) for (i, item), (distance, first, count) in sorted(index.search(words, edge, one, sizes).items())] if len(words) else []
            took = batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.record_batch([took, pa.array([r[1] for r in rows], pa.int64()), *[pa.array([r[j] for r in rows], pa.int64()) for j in (2, 3, 4)]],
                                  names=["doc_id", "item_id", "first_word", "n_words", "distance"])

    source = docs.select("doc_id", F.col("text").alias("_text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, item_id long, first_word long, n_words long, distance long")


def find_leaks(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every (document, item) with the item in the document: place and distance of the nearest occurrence."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // block_bytes + 1
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    parts = [_search_block(docs, items.where(number == b).orderBy("item_id", "text").collect(), max_edits) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)
