"""Toxicity by a classifier chain: each category's linear model also sees the earlier categories' probabilities.

Features are hashes of words and of word beginnings, which catch inflected forms; the FEATURES that tell most
about the categories are kept. Every text is read whole; a value is log(1 + count). In training, the
probabilities handed to later models are out of fold, so these learn how far earlier ones can be trusted:
a fold's model and its choice of features see the other folds only.

Only quality and toxic are labelled; the third category of the chain holds where both of the first do.

The classifier is fitted on at most about SAMPLE ids of each label combination, chosen by a hash, with one text
each (of rows with equal ids the least text). Labels of one id in several rows are merged (toxic if any says so,
good if all do).

Edge cases: a null or empty text has no features, so it gets the probabilities of the intercepts; without
labelled rows, or where a category has one value only, its probability is that value (0 without rows); rows
with equal ids stay separate rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portrisk.llm.common import cut, sampled
from portrisk.llm.words import slices, text_buffer, words_of

SAMPLE = 2500
FEATURES = 1500
MIN_ROWS = 5
PREFIXES = (3, 4, 5, 6, 7, 8)
FOLDS = 3
STEPS = 200
PENALTY = 1e-4
THRESHOLD = 0.5
#: The chain's order, as SQL over the columns quality and toxic.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1", "toxic_low_quality": "toxic = 1 AND quality = 0"}


def _occurrences(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and feature of each word and word beginning, a feature length at a time."""
    data, offsets = text_buffer(column)
    if len(offsets) < 2 or offsets[0] == offsets[-1]:
        return
    words, starts, *heads = words_of(data, np.unique(offsets), PREFIXES)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    for feature in (words, *heads):
        there = feature != 0
        yield rows[there], feature[there]


@dataclass(frozen=True)
class Chain:
    features: np.ndarray  # sorted hashes
    table: np.ndarray  # which upper 16 bits occur
    weights: tuple[np.ndarray, ...]  # per category: features, earlier categories, intercept

    @staticmethod
    def index(features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        features = np.sort(features.astype(np.uint64))
        table = np.zeros(1 << 16, dtype=bool)
        table[(features >> np.uint64(48)).astype(np.int64)] = True
        return features, table

    def values(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, feature number and value of all features that occur."""
        width, keys = max(1, len(self.features)), []
        for rows, found in _occurrences(column):
            maybe = self.table[(found >> np.uint64(48)).astype(np.int64)]
            rows, found = rows[maybe], found[maybe]
            at = np.searchsorted(self.features, found)
            right = self.features[np.minimum(at, len(self.features) - 1)] == found if len(self.features) else np.zeros(len(found), bool)
            keys.append(rows[right] * width + at[right])
        unique, counts = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
        return unique // width, unique % width, np.log1p(counts)

    def predict(self, column: pa.Array) -> list[np.ndarray]:
        n = len(column)
        rows, at, value = self.values(column)
        out: list[np.ndarray] = []
        for w in self.weights:
            k = len(self.features)
            logit = np.bincount(rows, weights=value * w[at], minlength=n) + w[-1]
            for p, v in zip(out, w[k:-1], strict=True):
                logit = logit + p * v
            out.append(sigmoid(logit))
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, steps: int = STEPS, penalty: float = PENALTY) -> np.ndarray:
    """Weights and intercept of a logistic regression with balanced classes, by accelerated gradient."""
    w = np.zeros(x.shape[1] + 1, dtype=np.float64)
    if len(y) == 0 or y.min() == y.max():
        w[-1] = 30.0 if len(y) and y[0] else -30.0
        return w
    balance = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    norms = np.einsum("ij,ij->i", x, x).astype(np.float64)
    rate = 1 / (0.25 * np.sqrt((balance * norms).sum() * max(1.0, np.median(norms))) + 0.25)
    at, last = w.copy(), w.copy()
    for k in range(steps):
        slope = balance * (sigmoid(x @ at[:-1].astype(np.float32) + at[-1]) - y)
        grad = np.append(x.T @ slope.astype(np.float32) + penalty * at[:-1], slope.sum())
        w = at - 4 * rate * grad
        at, last = w + k / (k + 3) * (w - last), w
    return last


def fit_chain(x: np.ndarray, y: np.ndarray, folds: np.ndarray, chosen: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """One model per column of y; the probabilities that later ones learn from are out of fold.

    chosen: the columns of x for the models without each fold, then those of the models of all rows.
    """
    weights, extra = [], np.zeros((len(x), 0), dtype=np.float32)
    for j in range(y.shape[1]):
        weights.append(fit_linear(np.hstack([x[:, chosen[-1]], extra]), y[:, j]))
        out = np.zeros((len(x), 1), dtype=np.float32)
        for f in range(FOLDS):
            rest, part = np.flatnonzero(folds != f), np.flatnonzero(folds == f)
            w = fit_linear(np.hstack([x[np.ix_(rest, chosen[f])], extra[rest]]), y[rest, j])
            out[part, 0] = sigmoid(np.hstack([x[np.ix_(part, chosen[f])], extra[part]]) @ w[:-1] + w[-1])
        extra = np.hstack([extra, out])
    return tuple(weights)


def _best(counts: DataFrame, n: list[str], p: list[str], rows: int, positive: list[int]) -> list[int]:
    """The FEATURES that tell most, by sums of the columns n (rows with it) and of p (of each category)."""
    z, have = [], sum((F.col(c) for c in n[1:]), F.col(n[0]))
    for j, pos in enumerate(positive):
        if 0 < pos < rows:
            own = sum((F.col(f"{c}_{j}") for c in p[1:]), F.col(f"{p[0]}_{j}"))
            spread = F.sqrt(have / rows * (1 / pos + 1 / (rows - pos)) + 1e-12)
            z.append(F.abs(own / pos - (have - own) / (rows - pos)) / spread)
    if not z:
        return []
    score = F.greatest(*z) if len(z) > 1 else z[0]
    return [r["feature"] for r in counts.where(have >= MIN_ROWS).select("feature", score.alias("z")).orderBy(F.desc("z"), "feature").limit(FEATURES).collect()]


def learn(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES) -> Chain:
    merged = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
              .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")))
    sizes = merged.groupBy("quality", "toxic").count().collect()
    taken = F.lit(False)
    for r in sizes:
        taken = F.when((F.col("quality") == r["quality"]) & (F.col("toxic") == r["toxic"]), sampled(F.col("doc_id"), r["count"], SAMPLE)).otherwise(taken)
    names = list(categories)
    # About SAMPLE ids for each of at most four label combinations: small enough to broadcast at any corpus size.
    marks = [f"_c{j}" for j in range(len(names))]
    chosen = merged.where(taken).select("doc_id", *[F.expr(categories[c]).cast("int").alias(m) for m, c in zip(marks, names, strict=True)])
    rows = cut(docs.select("doc_id", F.col("text").alias("_text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *marks).agg(F.min("_text").alias("_text"))
               .withColumn("_fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, "_text")):
            y = np.stack([batch.column(m).to_numpy(zero_copy_only=False) for m in marks], axis=1)
            fold = batch.column("_fold").to_numpy(zero_copy_only=False)
            for at, feature in _occurrences(batch.column("_text")):
                pairs = np.unique(np.stack([at.astype(np.uint64), feature]), axis=1) if len(at) else np.zeros((2, 0), np.uint64)
                unique, back = np.unique(pairs[1], return_inverse=True)
                own, of = y[pairs[0].astype(np.int64)], fold[pairs[0].astype(np.int64)]
                columns = []
                for f in range(FOLDS):
                    columns.append(np.bincount(back, weights=of == f, minlength=len(unique)))
                    columns += [np.bincount(back, weights=own[:, j] * (of == f), minlength=len(unique)) for j in range(len(names))]
                yield pa.record_batch([pa.array(unique.view(np.int64))] + [pa.array(c.astype(np.int64)) for c in columns], names=["feature", *sums])

    # Per fold: rows that have the feature, and those of them in each category.
    sums = [c for f in range(FOLDS) for c in (f"n{f}", *[f"p{f}_{j}" for j in range(len(names))])]
    sizes_of = {r["_fold"]: r for r in rows.groupBy("_fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in marks]).collect()}
    best: list[list[int]] = [[] for _ in range(FOLDS + 1)]
    if sizes_of:
        counts = cut(rows.mapInArrow(count, "feature long, " + ", ".join(f"{c} long" for c in sums)).groupBy("feature").agg(*[F.sum(c).alias(c) for c in sums]))
        for out in range(FOLDS + 1):  # the last choice leaves no fold out
            own = [f for f in range(FOLDS) if f != out]
            there = [sizes_of[f] for f in own if f in sizes_of]
            best[out] = _best(counts, [f"n{f}" for f in own], [f"p{f}" for f in own], sum(r["n"] for r in there), [sum(r[m] for r in there) for m in marks])
    features = np.unique(np.array([x for b in best for x in b], dtype=np.int64)).view(np.uint64)
    features, table = Chain.index(features)
    blank = Chain(features, table, ())

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, "_text")):
            at, number, value = blank.values(batch.column("_text"))
            edges = np.searchsorted(at, np.arange(len(batch) + 1))
            dense = [(number[a:b].tolist(), value[a:b].tolist()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.record_batch([pa.array([d[0] for d in dense], pa.list_(pa.int64())), pa.array([d[1] for d in dense], pa.list_(pa.float64()))]
                                  + [batch.column(c) for c in ("doc_id", "_fold", *marks)], names=["at", "value", "doc_id", "_fold", *marks])

    kind = rows.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(matrix, f"at array<long>, value array<double>, doc_id {kind}, _fold int, " + ", ".join(f"{m} int" for m in marks)).toPandas()
    got = got.sort_values("doc_id", kind="stable").reset_index(drop=True)  # any order of arrival gives the same model
    x = np.zeros((len(got), len(features)), dtype=np.float32)
    for i, (number, value) in enumerate(zip(got["at"], got["value"], strict=True)):
        x[i, np.asarray(number, dtype=np.int64)] = value
    y = got[marks].to_numpy(dtype=np.float64)
    where = [np.searchsorted(features, np.sort(np.array(b, dtype=np.int64).view(np.uint64))) for b in best]
    weights = fit_chain(x, y, got["_fold"].to_numpy(), where)
    # Predictions use the features of all rows: the last choice.
    return Chain(*Chain.index(features[where[-1]]), weights)


def predict(docs: DataFrame, chain: Chain, categories: dict[str, str] = CATEGORIES) -> DataFrame:
    """doc_id, probability of each category and the verdict of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, "_text")):
            p = [np.round(x, 6) for x in shared.value.predict(batch.column("_text"))]
            yield pa.record_batch([batch.column("doc_id"), *map(pa.array, p)], names=["doc_id", *names])

    source = docs.select("doc_id", F.col("text").alias("_text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    out = source.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} double" for n in names))
    return out.withColumn("toxic", F.col("p_toxic") > THRESHOLD)
