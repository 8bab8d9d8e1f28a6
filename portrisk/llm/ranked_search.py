"""Ranked lexical search over hashed max-sketches.

The index has one row per document: its length and a sketch of WIDTH coordinates and more a distinct term. Each
term folds its impact into MAPS coordinates by maximum. In one document the impact rises with the occurrences
alone, so the occurrences are what is folded, rounded up to 16 levels of four bits: the same bytes serve whatever
the corpus statistics turn out to be. The smallest coordinate of a query term bounds its impact from above, and
the weighted sum over the terms bounds the score.

Queries come in blocks of bounded size, against all rows of the index. A block goes through it twice:

1. The documents of highest bounds, a few for each query, are rescored exactly; the k-th best score is the
   query's threshold.
2. All documents whose bound reaches the threshold (with a smaller id, if it only equals it) are rescored.
   No other document can be among the best k, so the result is exact.

Terms are compared by 64-bit hash. The scores are those of the integers N, L, df and tf of all documents.

A null text or query has no term; a document without a term is not counted in N; queries without a term, or
whose terms no document has, have no result. Repeated queries (same id and text) have a result each; of
queries with equal ids and different texts each has its own. Repeated documents are ranked each, equal scores
by ascending id, null ids last. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portrisk.llm.common import BROADCAST_ROWS, cut, small
from portrisk.llm.words import column_words, mix, slices

BEST = 10
#: Coordinates that a term is folded into, and coordinates for each distinct term (up to the next power of two).
MAPS = 4
WIDTH = 8
#: Occurrences that the 16 values of a coordinate stand for; others are rounded up, the last is above all.
LEVELS = np.array([0, 1, 2, 3, 4, 5, 6, 8, 10, 13, 17, 23, 32, 48, 80, 10**9])
#: Distinct (query, term) pairs and queries of a block: they bound what is broadcast and the size of a bound matrix.
BLOCK_TERMS = 16_384
BLOCK_QUERIES = 512
#: Terms a task counts before it hands the counts on.
COUNTED = 1 << 19
#: Bytes of a row group of the index.
ROW_GROUP = 1 << 24
#: Documents whose bounds are computed at a time.
ROWS = 256
#: Pairs a task holds when it looks for the documents of highest bounds.
HELD = 1 << 16

_SEEDS = [np.uint64(0xA24BAED4963EE407 * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF) for k in range(MAPS)]


def _coordinates(terms: np.ndarray) -> np.ndarray:
    """MAPS hashes of each term; their low bits are coordinates of a sketch of any width."""
    return np.stack([mix(terms ^ seed) for seed in _SEEDS])


def sketch(terms: np.ndarray, tf: np.ndarray) -> bytes:
    """Two coordinates a byte."""
    width = 1 << max(4, int(WIDTH * len(terms) - 1).bit_length())
    out = np.zeros(width, dtype=np.uint8)
    level = np.searchsorted(LEVELS, tf).astype(np.uint8)
    for c in _coordinates(terms):
        np.maximum.at(out, (c & np.uint64(width - 1)).astype(np.int64), level)
    return (out[0::2] | out[1::2] << 4).tobytes()


def unfold(one: np.ndarray) -> np.ndarray:
    """The coordinates of a sketch."""
    out = np.empty(2 * len(one), dtype=np.uint8)
    out[0::2], out[1::2] = one & 15, one >> 4
    return out


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n, sketch) with at least one term, and the vocabulary (term, df), by one pass over the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n_held = 0

        def counted() -> pa.RecordBatch:
            terms, df = np.unique(np.concatenate(held), return_counts=True)
            k = len(terms)
            return pa.record_batch([pa.nulls(k, kind), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(terms.view(np.int64)), pa.array(df)], names=names)

        for batch in batches:
            kind = batch.column("doc_id").type
            for some in slices(batch, "text"):
                hashes, edge = column_words(some.column("text"))
                rows, ns, sketches = [], [], []
                for i in np.flatnonzero(np.diff(edge)).tolist():
                    terms, tf = np.unique(hashes[edge[i]: edge[i + 1]], return_counts=True)
                    rows.append(i)
                    ns.append(int(edge[i + 1] - edge[i]))
                    sketches.append(sketch(terms, tf))
                    held.append(terms)
                    n_held += len(terms)
                k = len(rows)
                yield pa.record_batch([some.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(ns, pa.int64()), pa.array(sketches, pa.binary()),
                                       pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=names)
                if n_held > COUNTED:
                    yield counted()
                    held, n_held = [], 0
        if n_held:
            yield counted()

    names = ["doc_id", "n", "sketch", "term", "df"]
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    both = cut(source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n long, sketch binary, term long, df long"), ROW_GROUP)
    index = both.where("term IS NULL").select("doc_id", "n", "sketch")
    return index, cut(both.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df")))


@dataclass
class Queries:
    """A block of queries: for each its terms as places in `terms`, and their weights."""

    n_docs: int
    n_terms: int
    terms: np.ndarray
    weights: np.ndarray
    places: list[np.ndarray]
    keys: list[int]
    thresholds: np.ndarray | None = None
    last_ids: list | None = None

    def m(self, n: np.ndarray) -> np.ndarray:
        return 10 + (90 * n * self.n_docs) // self.n_terms

    def scores(self, tf: np.ndarray, n: np.ndarray, query: int) -> np.ndarray:
        """Scores of rows of term counts (in the order of places[query])."""
        return ((1_000_000_000 * tf) // (1000 * tf + 8 * self.m(n)[:, None])) @ self.weights[self.places[query]]

    def matrix(self) -> np.ndarray:
        out = np.zeros((len(self.terms), len(self.places)), dtype=np.float32)
        for q, place in enumerate(self.places):
            out[place, q] = self.weights[place]
        return out


def _bounds(batches: Iterator[pa.RecordBatch], block: Queries, floor: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, and for pairs whose bound is floor[query] or more and not 0: row, query, bound. floor may rise meanwhile."""
    weights = block.matrix()
    spread, levels = _coordinates(block.terms), LEVELS.astype(np.float32)
    for batch in batches:
        n_all = batch.column("n").to_numpy()
        data, offsets = batch.column("sketch").buffers()[2], np.frombuffer(batch.column("sketch").buffers()[1], dtype=np.int32)
        offsets = offsets[batch.column("sketch").offset:][: len(batch) + 1].astype(np.int64)
        data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
        width = np.diff(offsets)
        order = np.argsort(width, kind="stable")
        for same in np.split(order, np.flatnonzero(np.diff(width[order])) + 1):
            w = 2 * int(width[same[0]]) if len(same) else 2
            at = (spread & np.uint64(w - 1)).astype(np.int64)
            for a in range(0, len(same), ROWS):
                rows = same[a: a + ROWS]
                tf = np.empty((len(rows), len(block.terms)), dtype=np.uint8)
                for i, start in enumerate(offsets[rows].tolist()):
                    one = unfold(data[start: start + w // 2])
                    seen = one[at[0]]
                    for c in at[1:]:
                        seen = np.minimum(seen, one[c])
                    tf[i] = seen
                m = block.m(n_all[rows]).astype(np.float32)[:, None]
                count = levels[tf]
                impact = count * np.float32(1e9) / (count * np.float32(1000) + np.float32(8) * m)
                rough = (impact @ weights) * np.float32(1.001)  # above the exact bound whatever the rounding
                r, q = np.nonzero((rough >= floor) & (rough > 0))
                by = np.argsort(q, kind="stable")
                r, q = r[by], q[by]
                bound = np.zeros(len(q), dtype=np.int64)
                for part in np.split(np.arange(len(q)), np.flatnonzero(np.diff(q)) + 1):
                    if len(part):
                        query = int(q[part[0]])
                        bound[part] = block.scores(LEVELS[tf[r[part]][:, block.places[query]]], n_all[rows[r[part]]], query)
                keep = (bound >= floor[q]) & (bound > 0)
                if keep.any():
                    yield batch.column("doc_id"), rows[r[keep]], q[keep], bound[keep]


def _pairs(ids: pa.Array, rows: np.ndarray, queries: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(queries, pa.int32()), ids.take(pa.array(rows)), pa.array(bounds, pa.int64())], names=["query", "doc_id", "bound"])


def _best_by_bound(block, k: int):
    """The k pairs of highest bound of each query, of one task."""
    def best(parts: list[pa.RecordBatch]) -> pa.Table:
        all_ = pa.Table.from_batches(parts).sort_by([("query", "ascending"), ("bound", "descending")])
        query = all_.column("query").to_numpy()
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        return all_.filter(pa.array(rank < k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        queries: Queries = block.value
        floor = np.zeros(len(queries.places), dtype=np.int64)
        for found in _bounds(batches, queries, floor):
            parts.append(_pairs(*found))
            held += len(parts[-1])
            if held > HELD:
                table = best(parts)
                query, counts = np.unique(table.column("query").to_numpy(), return_counts=True)
                full = query[counts == k]
                last = np.searchsorted(table.column("query").to_numpy(), full, side="right") - 1
                floor[full] = table.column("bound").to_numpy()[last] + 1  # later pairs must beat what is held
                parts, held = table.combine_chunks().to_batches(), len(table)
        if parts:
            yield from best(parts).combine_chunks().to_batches()

    return run


def _above_threshold(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = block.value
        for found in _bounds(batches, queries, queries.thresholds):
            pairs = _pairs(*found)
            query, bound = pairs.column("query").to_numpy(), pairs.column("bound").to_numpy()
            ties = np.flatnonzero(bound == queries.thresholds[query])
            keep = np.ones(len(query), dtype=bool)
            for i, id_ in zip(ties.tolist(), pairs.column("doc_id").take(pa.array(ties)).to_pylist(), strict=True):
                last = queries.last_ids[query[i]]
                keep[i] = last is None or (id_ is not None and id_ <= last)
            yield pairs.filter(pa.array(keep))

    return run


def _rescore(block):
    """Exact scores of texts for the queries listed beside them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = block.value
        for batch in batches:
            for some in slices(batch, "text"):
                hashes, edge = column_words(some.column("text"))
                place = np.minimum(np.searchsorted(queries.terms, hashes), len(queries.terms) - 1)
                known = queries.terms[place] == hashes
                out: tuple[list, list, list] = ([], [], [])
                for i, asked in enumerate(some.column("asked").to_pylist()):
                    if edge[i] == edge[i + 1]:
                        continue
                    own = slice(edge[i], edge[i + 1])
                    tf = np.bincount(place[own][known[own]], minlength=len(queries.terms))
                    n = np.array([edge[i + 1] - edge[i]])
                    for q in asked:
                        score = int(queries.scores(tf[queries.places[q]][None], n, q)[0])
                        if score > 0:
                            out[0].append(q)
                            out[1].append(i)
                            out[2].append(score)
                yield pa.record_batch([pa.array(out[0], pa.int32()), some.column("doc_id").take(pa.array(out[1], pa.int64())), pa.array(out[2], pa.int64())],
                                      names=["query", "doc_id", "score"])

    return run


def _top(scored: DataFrame, k: int, by: str) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc(by), F.asc_nulls_last("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Search:
    """An index over documents and the searches in it."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.spark = docs.sparkSession
        self.docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        self.id_type = self.docs.schema["doc_id"].dataType.simpleString()
        self.index, self.vocabulary = build_index(docs, id_col, text_col)
        totals = self.index.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms")).first()
        self.n_docs, self.n_terms = totals["n_docs"], totals["n_terms"]

    def _weighted_terms(self, texts: DataFrame) -> DataFrame:
        """key, text hash and weighted terms of distinct query texts; terms in no document score nothing and are left out."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in slices(batch, "text"):
                    hashes, edge = column_words(some.column("text"))
                    for i, key in enumerate(some.column("key").to_pylist()):
                        terms = np.unique(hashes[edge[i]: edge[i + 1]])
                        yield pa.record_batch([pa.array([key] * len(terms), pa.int64()), pa.array(terms.view(np.int64))], names=["key", "term"])

        terms = texts.select("key", "text").mapInArrow(run, "key long, term long")
        df = F.col("df").cast("double")
        weight = F.floor(1000 * F.log((2 * F.lit(float(self.n_docs)) + 2) / (2 * df + 1)))
        return terms.join(self.vocabulary, "term").select("key", "term", weight.cast("long").alias("weight"))

    def _candidates(self, pairs: DataFrame) -> DataFrame:
        """Exact scores of candidate pairs (query, doc_id): each text is read once for all its queries."""
        pairs = cut(pairs.select("query", "doc_id").distinct())
        asked = pairs.groupBy("doc_id").agg(F.collect_list("query").alias("asked")).withColumnRenamed("doc_id", "id_")
        asked = F.broadcast(asked) if pairs.count() <= BROADCAST_ROWS else asked
        return self.docs.join(asked, F.col("doc_id").eqNullSafe(F.col("id_"))).select("doc_id", "text", "asked")

    def _scored(self, pairs: DataFrame, block) -> DataFrame:
        return self._candidates(pairs).mapInArrow(_rescore(block), f"query int, doc_id {self.id_type}, score long")

    def _search_block(self, rows: list, k: int) -> DataFrame:
        """Best documents of one block of queries: key, rank, doc_id, score."""
        by_key: dict[int, list] = {}
        for row in rows:
            by_key.setdefault(row["key"], []).append(row)
        weight = {r["term"] & 0xFFFFFFFFFFFFFFFF: r["weight"] for r in rows}
        terms = np.array(sorted(weight), dtype=np.uint64)
        keys = sorted(by_key)
        places = [np.searchsorted(terms, np.array([r["term"] & 0xFFFFFFFFFFFFFFFF for r in by_key[key]], dtype=np.uint64)) for key in keys]
        queries = Queries(self.n_docs, self.n_terms, terms, np.array([weight[int(t)] for t in terms], dtype=np.int64), places, keys)
        shared = self.spark.sparkContext.broadcast(queries)
        pair = f"query int, doc_id {self.id_type}, bound long"
        seeds = _top(self.index.mapInArrow(_best_by_bound(shared, k), pair), k, "bound")
        first = _top(cut(self._scored(seeds, shared)), k, "score").where(F.col("rank") == k).collect()  # one row per query of the block
        queries.thresholds = np.zeros(len(keys), dtype=np.int64)
        queries.last_ids = [None] * len(keys)
        for row in first:
            queries.thresholds[row["query"]], queries.last_ids[row["query"]] = row["score"], row["doc_id"]
        bounded = self.spark.sparkContext.broadcast(queries)
        found = _top(self._scored(self.index.mapInArrow(_above_threshold(bounded), pair), bounded), k, "score")
        names = self.spark.createDataFrame([(q, key) for q, key in enumerate(keys)], "query int, key long")
        result = cut(found.join(F.broadcast(names), "query").select("key", "rank", "doc_id", "score"))
        shared.destroy()
        bounded.destroy()
        return result

    def search(self, queries: DataFrame, k: int = BEST, id_col: str = "item_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
        """The id of each query with rank, doc_id and score of its k best documents."""
        asked = queries.select(F.col(id_col).alias("item_id"), F.xxhash64(text_col, F.octet_length(text_col)).alias("key"), F.col(text_col).alias("text"))
        terms = cut(self._weighted_terms(asked.select("key", "text").distinct()))
        size = terms.agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("key").alias("keys")).first()
        blocks = max(1, -(-size["pairs"] // block_terms), -(-size["keys"] // BLOCK_QUERIES))
        terms = terms.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
        parts = [self._search_block(rows, k) for b in range(blocks) if (rows := terms.where(F.col("block") == b).collect())]
        result = None
        for part in parts:
            result = part if result is None else result.union(part)
        if result is None:
            result = self.spark.createDataFrame([], f"key long, rank int, doc_id {self.id_type}, score long")
        return asked.select("item_id", "key").join(small(result), "key").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = BEST) -> DataFrame:
    return Search(docs).search(queries, k)
