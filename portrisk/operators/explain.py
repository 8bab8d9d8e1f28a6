"""Scores and exact path-dependent Shapley values of a tree ensemble, and risk drivers.

Each half of a depth-4 tree depends on at most 8 split outcomes, so its whole
contribution vector is a table with 256 rows, built once on the driver.  A worker
evaluates the splits of an Arrow batch, forms one byte per row and half-tree, and
adds up table rows; score and explanation come out of the same pass.
"""

from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from portrisk import config as C


def _leaf_rows(feature, value, cover, leaf: int, outcomes: dict[int, np.ndarray], n_features: int) -> np.ndarray:
    """(patterns, n_features + 2) share of one leaf: contributions, base value, margin."""
    path, node = [], leaf
    while node:
        parent = (node - 1) // 2
        goes_right = node == 2 * parent + 2
        path.append((parent, goes_right, cover[node] / cover[parent] if cover[parent] else 0.0))
        node = parent
    n = len(next(iter(outcomes.values())))
    hit: dict[int, np.ndarray] = {}
    weight: dict[int, float] = {}
    for parent, goes_right, ratio in path:
        f = int(feature[parent])
        here = outcomes[parent] == goes_right
        hit[f] = hit.get(f, np.ones(n, bool)) & here
        weight[f] = weight.get(f, 1.0) * ratio
    fs, v, m = list(hit), value[leaf], len(hit)
    out = np.zeros((n, n_features + 2))
    reach = np.ones(n)
    missing = 1.0
    for f in fs:
        reach = reach * hit[f]
        missing *= weight[f]
    out[:, n_features], out[:, n_features + 1] = v * missing, v * reach
    for f in fs:
        others = [g for g in fs if g != f]
        mean = np.zeros(n)
        for size in range(m):
            share = factorial(size) * factorial(m - size - 1) / factorial(m)
            for known in combinations(others, size):
                term = np.full(n, share)
                for g in others:
                    term = term * (hit[g] if g in known else weight[g])
                mean += term
        out[:, f] += v * (hit[f] - weight[f]) * mean
    return out


def _leaf_margin(feature, value, leaf: int, outcomes: dict[int, np.ndarray]) -> np.ndarray:
    """(patterns, 1) share of one leaf in the margin alone."""
    reach, node = np.ones(len(next(iter(outcomes.values()))), bool), leaf
    while node:
        parent = (node - 1) // 2
        reach &= outcomes[parent] == (node == 2 * parent + 2)
        node = parent
    return value[leaf] * reach[:, None]


def ensemble_tables(trees: list[dict], n_features: int, depth: int, explain: bool = True):
    """Split features and thresholds, and contribution tables of the half-trees; without explain only margins.

    Bit k of a pattern says that split k of the half (root, then its subtree in
    breadth-first order) sends the row right.
    """
    inner = 2**depth - 1
    feature = np.zeros((len(trees), inner), dtype=np.int64)
    threshold = np.full((len(trees), inner), np.inf)
    halves = [[0], [0]]
    for side in (0, 1):
        level = [1 + side]
        for _ in range(depth - 1):
            halves[side] += level
            level = [c for i in level for c in (2 * i + 1, 2 * i + 2)]
    bits = len(halves[0])
    pattern = np.arange(2**bits)
    tables = np.zeros((len(trees), 2, 2**bits, n_features + 2 if explain else 1))
    for t, tree in enumerate(trees):
        f, v, c = (np.asarray(tree[k]) for k in ("feature", "value", "cover"))
        for i in range(inner):
            if f[i] >= 0:
                feature[t, i], threshold[t, i] = f[i], tree["threshold"][i]
        for side, nodes in enumerate(halves):
            outcomes = {node: (pattern >> k) & 1 == 1 for k, node in enumerate(nodes)}
            if f[0] < 0:
                if side == 0:
                    tables[t, 0, :, -2:] = v[0]  # base value and margin, or the margin
                continue
            todo = [1 + side]
            while todo:
                node = todo.pop()
                if node < inner and f[node] >= 0:
                    todo += [2 * node + 1, 2 * node + 2]
                else:
                    tables[t, side] += _leaf_rows(f, v, c, node, outcomes, n_features) if explain else _leaf_margin(f, v, node, outcomes)
    return feature, threshold, halves, tables


def score_batch(x: np.ndarray, ensemble, n_features: int, explain: bool) -> np.ndarray:
    """(rows, n_features + 2) sums over all trees; only the margin unless ``explain``."""
    feature, threshold, halves, tables = ensemble
    columns = [np.ascontiguousarray(x[:, f]) for f in range(n_features)]
    out = np.zeros((len(x), n_features + 2))
    margin = np.zeros(len(x))
    for t in range(len(feature)):
        # A missing split has threshold +inf, so its bit stays 0.
        right = [columns[feature[t, i]] >= threshold[t, i] for i in range(feature.shape[1])]
        for side, nodes in enumerate(halves):
            code = np.zeros(len(x), dtype=np.int64)
            for k, node in enumerate(nodes):
                code |= right[node].astype(np.int64) << k
            if explain:
                out += tables[t, side][code]
            else:
                margin += tables[t, side, :, -1][code]
    if not explain:
        out[:, n_features + 1] = margin
    return out


def margins_along(x: np.ndarray, ensemble, n_features: int, moves) -> np.ndarray:
    """(moves, rows) margins of the rows with one feature set to a value, for each move (feature, value).

    The splits are evaluated once; a move only replaces the outcomes of the splits on its feature.
    """
    feature, threshold, halves, tables = ensemble
    columns = [np.ascontiguousarray(x[:, f]) for f in range(n_features)]
    out = np.zeros((len(moves), len(x)))
    for t in range(len(feature)):
        right = [columns[feature[t, i]] >= threshold[t, i] for i in range(feature.shape[1])]
        for side, nodes in enumerate(halves):
            code = np.zeros(len(x), dtype=np.uint8)  # a half has at most eight splits
            for k, node in enumerate(nodes):
                code |= right[node].view(np.uint8) << np.uint8(k)
            table = np.ascontiguousarray(tables[t, side, :, -1])
            shares: dict[tuple[int, int], np.ndarray] = {}  # by bits replaced and their values
            for j, (f, value) in enumerate(moves):
                own = [(k, node) for k, node in enumerate(nodes) if feature[t, node] == f]
                mask = sum(1 << k for k, _ in own)
                bits = sum(1 << k for k, node in own if value >= threshold[t, node])
                if (mask, bits) not in shares:
                    shares[mask, bits] = table[code & np.uint8(255 - mask) | np.uint8(bits)]
                out[j] += shares[mask, bits]
    return out


class Scorer:
    """A pandas UDF over the feature array: struct of margin, base_value and, if asked, c0, c1, ...

    Only that array travels to Python.  What is broadcast, once, grows with the number of trees (40 kB each, 4 kB
    without explanation), never with the data.  ``close`` takes it off the executors.
    """

    def __init__(self, spark: SparkSession, trees: list[dict], base: float, n_features: int, depth: int, explain: bool):
        shared = self.shared = spark.sparkContext.broadcast(ensemble_tables(trees, n_features, depth, explain))
        self.base, self.n_features = base, n_features
        names = [f"c{i}" for i in range(n_features)] if explain else []

        @F.pandas_udf(", ".join(f"{f} double" for f in ["margin", "base_value", *names]))
        def scores(features: pd.Series) -> pd.DataFrame:
            x = np.array(features.tolist(), dtype=float).reshape(-1, n_features)
            s = score_batch(x, shared.value, n_features, explain)
            table = {"margin": base + s[:, n_features + 1], "base_value": base + s[:, n_features]}
            table.update({name: s[:, i] for i, name in enumerate(names)})
            return pd.DataFrame(table)

        # Marked nondeterministic so that filters on a score are not pushed below it and scored twice.
        self.udf = scores.asNondeterministic()

    def along(self, moves):
        """A pandas UDF over the feature array: struct of m0, m1, ..., the margin after each move (feature, value)."""
        shared, base, n_features, moves = self.shared, self.base, self.n_features, list(moves)

        @F.pandas_udf(", ".join(f"m{j} double" for j in range(len(moves))))
        def margins(features: pd.Series) -> pd.DataFrame:
            x = np.array(features.tolist(), dtype=float).reshape(-1, n_features)
            return pd.DataFrame({f"m{j}": m for j, m in enumerate(base + margins_along(x, shared.value, n_features, moves))})

        return margins.asNondeterministic()

    def close(self) -> None:
        self.shared.destroy()


def risk_drivers(contributions: Column, names=C.MODEL_FEATURES) -> Column:
    """Names of the two main drivers of a contribution array.

    Two or more positive values: the two largest.  One: it, then the largest
    magnitude of the rest.  None: the two largest magnitudes.  Ties keep feature order.
    """
    def ranked(key):
        rows = F.transform(
            contributions,
            lambda v, i: F.struct(key(v).alias("key"), i.alias("i"), (v > 0).alias("positive")),
        )
        return F.array_sort(rows)

    positive = F.filter(ranked(lambda v: -v), lambda s: s["positive"])
    by_size = ranked(lambda v: -F.abs(v))
    order = (
        F.when(F.size(positive) >= 2, positive)
        .when(F.size(positive) == 1, F.concat(positive, F.filter(by_size, lambda s: ~s["positive"])))
        .otherwise(by_size)
    )
    labels = F.array(*[F.lit(n) for n in names])
    return F.transform(F.slice(order, 1, 2), lambda s: F.get(labels, s["i"]))


def driver_texts(drivers: Column, reasons=None) -> Column:
    reasons = C.REASONS if reasons is None else reasons
    known = F.create_map(*[F.lit(x) for kv in reasons.items() for x in kv])
    return F.transform(
        drivers,
        lambda n: F.coalesce(F.try_element_at(known, n), F.concat(F.lit("Feature '"), n, F.lit("'"))),
    )

