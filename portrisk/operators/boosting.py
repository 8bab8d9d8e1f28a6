"""Monotone gradient-boosted trees as Spark jobs.

Rows are binned by Spark, and rows with equal bins are merged into one weighted
cell before training, so every pass costs the number of distinct cells rather
than of rows, and a hot cell is one record.  A tree level is one job: each task
reduces its cells to a (node, feature, bin) histogram of gradients, the
histograms are summed, and the driver picks splits from that fixed-size table.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import Bucketizer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portrisk import config as C
from portrisk.functions.scalar import sigmoid
from portrisk.operators.blocks import sum_partitions
from portrisk.operators.explain import Scorer
from portrisk.session import ensure_checkpoint_dir, materialize

CELLS_PER_BLOCK = 65_536
CELLS_PER_PARTITION = 500_000  # of the written blocks, whose content decides the row sample
CELLS_PER_TASK = 50_000  # the least worth a task of a pass
REFRESH_EVERY = 10  # rounds between rewrites of the cached margins
CHECKPOINT_EVERY = 50  # rounds between lineage cuts
MIN_GAIN = 1e-6
STORAGE = StorageLevel.MEMORY_AND_DISK  # a block that memory does not hold goes to disk


@dataclass
class Tree:
    """A depth-limited binary tree in heap order; feature -1 marks a leaf."""

    depth: int
    feature: np.ndarray = field(default=None)
    bin: np.ndarray = field(default=None)
    threshold: np.ndarray = field(default=None)
    value: np.ndarray = field(default=None)
    cover: np.ndarray = field(default=None)

    @classmethod
    def empty(cls, depth: int) -> "Tree":
        n = 2 ** (depth + 1) - 1
        return cls(depth, np.full(n, -1), np.zeros(n, int), np.zeros(n), np.zeros(n), np.zeros(n))

    def to_dict(self) -> dict:
        return {
            "feature": self.feature.tolist(),
            "threshold": self.threshold.tolist(),
            "value": self.value.tolist(),
            "cover": self.cover.tolist(),
        }


def walk(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Heap position of every binned row after at most ``levels`` splits."""
    node = np.zeros(len(x), dtype=np.int64)
    rows = np.arange(len(x))
    for _ in range(levels):
        f = feature[node]
        inner = f >= 0
        right = x[rows, np.maximum(f, 0)] >= cut[node]
        node = np.where(inner, 2 * node + 1 + right, node)
    return node


def add_trees(block, trees):
    key, x, counts, margin = block
    for feature, cut, value, depth in trees:
        margin = margin + value[walk(x, feature, cut, depth)]
    return key, x, counts, margin


def _histogram(blocks, pending, tree, level, slots, n_features, n_bins, subsample, seed):
    """Sum over one partition: histogram of the level's nodes that have a slot, then validation loss."""
    n_nodes = 2**level
    size = (int(slots.max()) + 1) * n_features * n_bins
    out = np.zeros(2 * size + 2)
    feature, cut = tree
    for block in blocks:
        key, x, counts, margin = add_trees(block, pending)
        p = 1.0 / (1.0 + np.exp(-margin))
        neg, pos, v_neg, v_pos = counts.T  # whole numbers
        if level == 0:
            safe = np.clip(p, 1e-15, 1 - 1e-15)
            out[-2] += -(v_pos * np.log(safe) + v_neg * np.log(1 - safe)).sum()
            out[-1] += v_pos.sum() + v_neg.sum()
        if subsample < 1.0:
            rng = np.random.default_rng([*seed, *key])
            neg, pos = rng.binomial(neg, subsample), rng.binomial(pos, subsample)
        n = neg + pos
        g, h = n * p - pos, n * p * (1 - p)
        node = walk(x, feature, cut, level) - (n_nodes - 1)
        slot = np.where(node >= 0, slots[np.maximum(node, 0)], -1)
        live = slot >= 0
        base = slot[live] * (n_features * n_bins)
        xs, g, h = x[live], g[live], h[live]
        for f in range(n_features):
            cell = base + f * n_bins + xs[:, f]
            out[:size] += np.bincount(cell, weights=g, minlength=size)
            out[size : 2 * size] += np.bincount(cell, weights=h, minlength=size)
    return out


def best_splits(hist, lo, hi, signs, allowed, reg_lambda, min_child):
    """Best (gain, feature, bin, left sums, right sums, weights) of every node."""
    g, h = hist
    total_g, total_h = g[:, :1].sum(2), h[:, :1].sum(2)

    def weight(gs, hs, low, high):
        return np.clip(-gs / (hs + reg_lambda), low, high)

    def score(gs, hs, w):
        return -(2 * gs * w + (hs + reg_lambda) * w * w)

    gl, hl = np.cumsum(g, 2)[:, :, :-1], np.cumsum(h, 2)[:, :, :-1]
    gr, hr = total_g[:, :, None] - gl, total_h[:, :, None] - hl
    low, high = lo[:, None, None], hi[:, None, None]
    wl, wr = weight(gl, hl, low, high), weight(gr, hr, low, high)
    parent = score(total_g, total_h, weight(total_g, total_h, lo[:, None], hi[:, None]))
    gain = score(gl, hl, wl) + score(gr, hr, wr) - parent[:, :, None]
    ok = (hl >= min_child) & (hr >= min_child) & allowed[None, :, None]
    ok &= signs[None, :, None] * (wr - wl) >= 0
    gain = np.where(ok, gain, -np.inf)
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(1)
    rows = np.arange(len(at))
    f, b = np.unravel_index(at, gain.shape[1:])
    pick = lambda a: a[rows, f, b]
    return flat[rows, at], f, b, pick(wl), pick(wr), pick(hl), pick(hr), total_h[:, 0]


def _lighter(tree: Tree, node: int) -> bool:
    """Whether a node has less weight than its sibling; of equals the left one."""
    sibling = node + 1 if node % 2 else node - 1
    return tree.cover[node] < tree.cover[sibling] or (tree.cover[node] == tree.cover[sibling] and node < sibling)


class MonotoneGBTClassifier(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Binary classifier with per-feature monotone signs and early stopping.

    ``validationCol`` (boolean) marks rows used only to choose the number of rounds.
    """

    #: Sum the lighter of two siblings only; the other histogram is the parent's rest.
    siblings = True

    rounds = Param(Params._dummy(), "rounds", "boosting rounds", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "tree depth", TypeConverters.toInt)
    eta = Param(Params._dummy(), "eta", "learning rate", TypeConverters.toFloat)
    subsample = Param(Params._dummy(), "subsample", "row share per round", TypeConverters.toFloat)
    colsample = Param(Params._dummy(), "colsample", "feature share per tree", TypeConverters.toFloat)
    minChildWeight = Param(Params._dummy(), "minChildWeight", "least hessian of a child", TypeConverters.toFloat)
    regLambda = Param(Params._dummy(), "regLambda", "L2 leaf penalty", TypeConverters.toFloat)
    patience = Param(Params._dummy(), "patience", "rounds without improvement", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins per feature", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)
    signs = Param(Params._dummy(), "signs", "monotone sign per feature", TypeConverters.toListInt)
    names = Param(Params._dummy(), "names", "feature names", TypeConverters.toListString)
    featuresCol = Param(Params._dummy(), "featuresCol", "array<double> column", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "0/1 label", TypeConverters.toString)
    validationCol = Param(Params._dummy(), "validationCol", "boolean column", TypeConverters.toString)

    def __init__(self, **params):
        super().__init__()
        self._setDefault(
            rounds=C.BOOST_ROUNDS,
            depth=C.BOOST_DEPTH,
            eta=C.BOOST_ETA,
            subsample=C.BOOST_SUBSAMPLE,
            colsample=C.BOOST_COLSAMPLE,
            minChildWeight=C.BOOST_MIN_CHILD_WEIGHT,
            regLambda=C.BOOST_LAMBDA,
            patience=C.BOOST_PATIENCE,
            maxBins=C.BOOST_MAX_BINS,
            seed=C.SEED,
            signs=list(C.MONOTONE_SIGNS),
            names=list(C.MODEL_FEATURES),
            featuresCol="features",
            labelCol="churn",
        )
        self._set(**params)

    def _cells(self, dataset: DataFrame) -> tuple[DataFrame, list[np.ndarray]]:
        """Binned rows merged into weighted cells, and the cut points per feature."""
        o = self.getOrDefault
        n, bins = len(o(self.names)), o(self.maxBins)
        if bins > 256:
            raise ValueError("maxBins is at most 256: bins are kept in one byte")
        held = F.col(o(self.validationCol)) if self.isSet(self.validationCol) else F.lit(False)
        rows = dataset.select(
            *[F.get(o(self.featuresCol), F.lit(i)).alias(f"f{i}") for i in range(n)],
            F.col(o(self.labelCol)).cast("int").alias("y"),
            held.alias("held"),
        )
        grid = [i / bins for i in range(1, bins)]
        picked = rows.where(~F.col("held")).agg(
            *[F.percentile_approx(f"f{i}", grid, 20 * bins).alias(f"f{i}") for i in range(n)]
        ).first()
        if picked[0] is None:
            raise ValueError("no training rows")
        cuts = [np.unique(np.array(picked[i], dtype=float)) for i in range(n)]
        binner = Bucketizer(
            splitsArray=[[-math.inf, *c, math.inf] for c in cuts],
            inputCols=[f"f{i}" for i in range(n)],
            outputCols=[f"b{i}" for i in range(n)],
        )
        y, held_out = F.col("y"), F.col("held")

        def count(cond):
            return F.count_if(cond)

        cells = (
            binner.transform(rows)
            .groupBy(*[F.col(f"b{i}").cast("short").alias(f"b{i}") for i in range(n)])
            .agg(
                count(~held_out & (y == 0)).alias("neg"),
                count(~held_out & (y == 1)).alias("pos"),
                count(held_out & (y == 0)).alias("v_neg"),
                count(held_out & (y == 1)).alias("v_pos"),
            )
        )
        return cells, cuts

    def _fit(self, dataset: DataFrame) -> "MonotoneGBTModel":
        o = self.getOrDefault
        if not 1 <= o(self.depth) <= 4:
            raise ValueError("depth must be 1..4")
        names, depth, eta = o(self.names), o(self.depth), o(self.eta)
        n_features = len(names)
        signs = np.array(o(self.signs))
        ensure_checkpoint_dir(dataset.sparkSession)
        cells, cuts = self._cells(dataset)
        cells = cells.persist(STORAGE)
        summary = cells.agg(F.count(F.lit(1)).alias("cells"), F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).first()
        if not summary.neg or not summary.pos:
            cells.unpersist()
            raise ValueError("training needs both classes")
        base = math.log(summary.pos / summary.neg)
        parts = max(1, math.ceil(summary.cells / CELLS_PER_PARTITION))
        keys = [f"b{i}" for i in range(n_features)]
        counts = ["neg", "pos", "v_neg", "v_pos"]

        def pack(batches):
            # Sorted input makes blocks, and with them the row sampling, repeatable.
            for pdf in batches:
                for s in range(0, len(pdf), CELLS_PER_BLOCK):
                    part = pdf.iloc[s : s + CELLS_PER_BLOCK]
                    yield pd.DataFrame(
                        {
                            "key": [part[keys].iloc[0].astype(int).tolist()],
                            "bins": [part[keys].to_numpy(np.uint8).tobytes()],
                            "counts": [part[counts].to_numpy(np.int64).tobytes()],
                        }
                    )

        packed = (
            cells.repartition(parts, *keys)
            .sortWithinPartitions(*keys)
            .mapInPandas(pack, "key array<int>, bins binary, counts binary")
        )

        def unpack(r):
            x = np.frombuffer(r.bins, np.uint8).reshape(-1, n_features)
            w = np.frombuffer(r.counts, np.int64).reshape(-1, 4)
            return list(r.key), x, w, np.full(len(x), base)

        # Written once: a lost or evicted block is read again, not joined and binned again. Blocks stay whole and are
        # dealt out over the cores, so a pass is as long as the share of one core.
        tasks = min(dataset.sparkSession.sparkContext.defaultParallelism, math.ceil(summary.cells / CELLS_PER_TASK))
        written = materialize(packed)
        written = written.repartition(tasks) if tasks > parts else written.coalesce(parts)
        state = written.rdd.map(unpack).persist(STORAGE)
        state.count()
        cells.unpersist()
        try:
            trees, losses = self._boost(state, cuts, signs, depth, eta)
        finally:
            state.unpersist()
        best = int(np.argmin(losses)) if losses else len(trees)
        kept = trees[:best] if losses else trees
        return MonotoneGBTModel(json.dumps([t.to_dict() for t in kept]), base, names, depth, losses)

    def _boost(self, state, cuts, signs, depth, eta):
        """Trees, and validation loss after 0, 1, 2, ... trees (empty without held rows)."""
        o = self.getOrDefault
        n_features = len(signs)
        n_bins = max(len(c) for c in cuts) + 1
        rng = np.random.default_rng(o(self.seed))
        n_used = max(1, int(o(self.colsample) * n_features))
        trees: list[Tree] = []
        pending: list[tuple] = []
        losses: list[float] = []
        current = state

        def sums(tree, level, rnd, slots):
            waiting, shape = list(pending), (tree.feature.copy(), tree.bin.copy())
            sub, seed = o(self.subsample), (o(self.seed), rnd)
            return sum_partitions(
                current, lambda it: _histogram(it, waiting, shape, level, slots, n_features, n_bins, sub, seed)
            )

        def histograms(tree, level, rnd, nodes, above):
            """Histograms of open nodes by node, and the vector. Of two siblings the lighter is summed, the other is the rest of the parent."""
            first = 2**level - 1
            chosen = [i for i in nodes if level == 0 or not self.siblings or _lighter(tree, i)]
            slots = np.full(2**level, -1)
            slots[[i - first for i in chosen]] = np.arange(len(chosen))
            vector = sums(tree, level, rnd, slots)
            table = vector[:-2].reshape(2, len(chosen), n_features, n_bins)
            out = {i: table[:, k] for k, i in enumerate(chosen)}
            for i in nodes:
                if i not in out:
                    out[i] = above[(i - 1) // 2] - out[i + 1 if i % 2 else i - 1]
            return out, vector

        def note_loss(vector) -> bool:
            if vector[-1] > 0:
                losses.append(vector[-2] / vector[-1])
            return bool(losses) and len(losses) - 1 - int(np.argmin(losses)) >= o(self.patience)

        for rnd in range(o(self.rounds)):
            tree = Tree.empty(depth)
            allowed = np.zeros(n_features, bool)
            allowed[rng.choice(n_features, n_used, replace=False)] = True
            lo, hi = {0: -np.inf}, {0: np.inf}
            open_nodes, above = [0], {}
            stop = False
            for level in range(depth):
                above, vector = histograms(tree, level, rnd, open_nodes, above)
                if level == 0 and note_loss(vector):
                    stop = True
                    break
                hist = np.stack([above[i] for i in open_nodes], axis=1)
                gain, f, b, wl, wr, hl, hr, h_all = best_splits(
                    hist,
                    np.array([lo[i] for i in open_nodes]),
                    np.array([hi[i] for i in open_nodes]),
                    signs,
                    allowed,
                    o(self.regLambda),
                    o(self.minChildWeight),
                )
                if level == 0:
                    tree.cover[0] = h_all[0]
                    g0 = hist[0][0, 0].sum()
                    tree.value[0] = eta * -g0 / (h_all[0] + o(self.regLambda))
                grown = []
                for k, node in enumerate(open_nodes):
                    if not gain[k] > MIN_GAIN:
                        continue
                    left, right = 2 * node + 1, 2 * node + 2
                    tree.feature[node], tree.bin[node] = f[k], b[k] + 1
                    tree.threshold[node] = cuts[f[k]][b[k]]
                    tree.value[left], tree.value[right] = eta * wl[k], eta * wr[k]
                    tree.cover[left], tree.cover[right] = hl[k], hr[k]
                    middle, sign = (wl[k] + wr[k]) / 2, signs[f[k]]
                    lo[left], hi[left] = lo[node], hi[node]
                    lo[right], hi[right] = lo[node], hi[node]
                    if sign > 0:
                        hi[left], lo[right] = middle, middle
                    elif sign < 0:
                        lo[left], hi[right] = middle, middle
                    grown += [left, right]
                open_nodes = grown
                if not open_nodes:
                    break
            if stop:
                return trees, losses
            trees.append(tree)
            pending.append((tree.feature, tree.bin, tree.value, depth))
            if len(pending) >= REFRESH_EVERY:
                applied = list(pending)
                fresh = current.map(lambda block: add_trees(block, applied)).persist(STORAGE)
                if len(trees) % CHECKPOINT_EVERY == 0:
                    fresh.checkpoint()
                fresh.count()
                if current is not state:
                    current.unpersist()
                current, pending = fresh, []
        note_loss(sums(Tree.empty(depth), 0, o(self.rounds), np.zeros(1, dtype=int)))
        if current is not state:
            current.unpersist()
        return trees, losses


class MonotoneGBTModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``margin``, ``churn_probability`` and ``contributions`` (log-odds per feature)."""

    trees = Param(Params._dummy(), "trees", "trees as JSON", TypeConverters.toString)
    base = Param(Params._dummy(), "base", "initial log-odds", TypeConverters.toFloat)
    names = Param(Params._dummy(), "names", "feature names", TypeConverters.toListString)
    depth = Param(Params._dummy(), "depth", "tree depth", TypeConverters.toInt)
    losses = Param(Params._dummy(), "losses", "validation loss per number of trees", TypeConverters.toListFloat)
    featuresCol = Param(Params._dummy(), "featuresCol", "array<double> column", TypeConverters.toString)

    def __init__(self, trees=None, base=None, names=None, depth=None, losses=None):
        super().__init__()
        self._scorers: dict = {}
        self._setDefault(featuresCol="features")
        if trees is not None:
            self._set(trees=trees, base=base, names=list(names), depth=depth, losses=[float(x) for x in losses])

    def tree_list(self) -> list[dict]:
        return json.loads(self.getOrDefault(self.trees))

    @property
    def n_trees(self) -> int:
        return len(self.tree_list())

    def scorer(self, spark: SparkSession, explain: bool = False):
        """Pandas UDF from the array<double> features to the score struct; made once for a session and kept until close()."""
        return self._scorer(spark, explain).udf

    def scorer_along(self, spark: SparkSession, moves):
        """Pandas UDF from the features to a struct of the margins after each move (feature number, value)."""
        return self._scorer(spark, False).along(moves)

    def _scorer(self, spark: SparkSession, explain: bool) -> Scorer:
        key = (spark.sparkContext.applicationId, explain)
        if key not in self._scorers:
            o = self.getOrDefault
            self._scorers[key] = Scorer(spark, self.tree_list(), o(self.base), len(o(self.names)), o(self.depth), explain)
        return self._scorers[key]

    def close(self) -> None:
        """Take what scoring has broadcast off the executors; a later score makes it anew."""
        while self._scorers:
            self._scorers.popitem()[1].close()

    def score(self, dataset: DataFrame, explain: bool = False) -> DataFrame:
        scores = self.scorer(dataset.sparkSession, explain)
        out = dataset.withColumn("_s", scores(F.col(self.getOrDefault(self.featuresCol))))
        out = out.withColumn("margin", F.col("_s.margin")).withColumn("churn_probability", sigmoid(F.col("margin")))
        if explain:
            n = len(self.getOrDefault(self.names))
            out = out.withColumn("base_value", F.col("_s.base_value")).withColumn(
                "contributions", F.array(*[F.col(f"_s.c{i}") for i in range(n)])
            )
        return out.drop("_s")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.score(dataset, explain=True)
