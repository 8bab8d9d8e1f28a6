"""Investor segments: population scaler, k-means with restarts, cluster profiles.

Fitted parts are ``pyspark.ml`` models whose parameters are a few numbers, so
assignment is a plain column expression and persistence is the ML writer.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portrisk import config as C
from portrisk.functions.arrays import one_hot, total
from portrisk.functions.scalar import lookup
from portrisk.operators.blocks import matrix_blocks, sum_partitions



def scaler_stats(clients: DataFrame, features=C.CLUSTER_FEATURES) -> DataFrame:
    """(feature, mean, std): population deviation, zero replaced by one."""
    wide = clients.agg(
        *[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.col(f"m_{f}").alias("mean"),
                F.when(F.col(f"s_{f}") == 0, 1.0).otherwise(F.col(f"s_{f}")).alias("std"),
            )
            for f in features
        ]
    )
    return wide.select(F.explode(cells).alias("x")).select("x.*")


def scaled(means, stds, features=C.CLUSTER_FEATURES) -> list[Column]:
    return [(F.col(f) - float(m)) / float(s) for f, m, s in zip(features, means, stds)]


def nearest(xs: list[Column], centers) -> Column:
    """Index of the nearest centre; the first wins a tie."""
    squares = [total([(x - float(c)) * (x - float(c)) for x, c in zip(xs, row)]) for row in centers]
    options = F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(squares)])
    return F.array_min(options)["i"]


def _plus_plus(blocks, dims: int, k: int, restarts: int, seed: int) -> np.ndarray:
    """Starting points of every restart by k-means++ over all rows: one pass for each of the k points.

    A row is drawn with its squared distance as weight by the largest of log(u) / weight, so partitions
    need to return their best row only.
    """
    centers = np.zeros((restarts, k, dims))
    for j in range(k):
        known = centers[:, :j].copy()

        def best(index, matrices, j=j, known=known):
            rng = np.random.default_rng((seed, j, index))
            out = np.full((restarts, 1 + dims), -np.inf)
            for x in matrices:
                for r in range(restarts):
                    weight = ((x[:, None, :] - known[r][None]) ** 2).sum(2).min(1) if j else np.ones(len(x))
                    with np.errstate(divide="ignore"):
                        key = np.where(weight > 0, np.log(rng.random(len(x))) / np.where(weight > 0, weight, 1.0), -np.inf)
                    i = int(key.argmax())
                    if key[i] > out[r, 0]:
                        out[r, 0], out[r, 1:] = key[i], x[i]
            return [out]

        found = blocks.mapPartitionsWithIndex(best).treeReduce(lambda a, b: np.where(a[:, :1] >= b[:, :1], a, b))
        if not j and not np.isfinite(found[:, 0]).all():
            raise ValueError("cannot cluster an empty table")
        # Fewer distinct rows than clusters: a point repeats.
        centers[:, j] = np.where(np.isfinite(found[:, :1]), found[:, 1:], centers[:, 0])
    return centers


def _assign(blocks, centers: np.ndarray, k: int, dims: int) -> np.ndarray:
    """By restart and cluster: rows, squared distances, and sums of the columns."""
    def partial(matrices):
        acc = np.zeros((len(centers), k, 2 + dims))
        for x in matrices:
            for r, c in enumerate(centers):
                d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(2)
                at = d.argmin(1)
                acc[r, :, 0] += np.bincount(at, minlength=k)
                acc[r, :, 1] += np.bincount(at, weights=d.min(1), minlength=k)
                for i in range(dims):
                    acc[r, :, 2 + i] += np.bincount(at, weights=x[:, i], minlength=k)
        return acc

    return sum_partitions(blocks, partial)


def fit_kmeans(
    points: DataFrame,
    columns: list[str],
    k: int = C.N_CLUSTERS,
    restarts: int = C.KMEANS_RESTARTS,
    max_iter: int = C.KMEANS_MAX_ITER,
    tol: float = 1e-4,
    seed: int = C.SEED,
) -> tuple[np.ndarray, float]:
    """Best centres of all restarts and their inertia.

    All restarts move together, so each iteration is one pass over the data however
    many restarts there are; a task returns restarts * k partial sums; a restart that has settled drops out.
    Starting points are drawn from all rows.
    """
    dims = len(columns)
    blocks = matrix_blocks(points.select(*columns), points.count()).persist()
    moving = np.arange(restarts)
    try:
        centers = _plus_plus(blocks, dims, k, restarts, seed)
        for _ in range(max_iter):
            now = centers[moving].copy()
            acc = _assign(blocks, now, k, dims)
            n = acc[:, :, :1]
            centers[moving] = np.where(n > 0, acc[:, :, 2:] / np.maximum(n, 1), now)
            moving = moving[((centers[moving] - now) ** 2).sum((1, 2)) > tol]
            if not len(moving):
                break
        inertia = _assign(blocks, centers, k, dims)[:, :, 1].sum(1)
    finally:
        blocks.unpersist()
    best = int(np.argmin(inertia))
    return centers[best], float(inertia[best])


def cluster_holding(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster_id").agg(F.avg("avg_holding_days").alias("mean_holding_days"))


def profile_map(holding: DataFrame, names=C.PROFILES_BY_HOLDING) -> DataFrame:
    """(cluster_id, mean_holding_days, profile): profiles by ascending holding time.

    Fails unless there are exactly as many clusters as profiles.
    """
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy("mean_holding_days", "cluster_id")
    count = F.count(F.lit(1)).over(everything)
    message = F.concat(F.lit(f"expected exactly {len(names)} clusters, got "), F.col("_n").cast("string"))
    return (
        holding.withColumn("_rank", F.row_number().over(order))
        .withColumn("_n", count)
        .where(F.coalesce(F.assert_true(F.col("_n") == len(names), message).cast("boolean"), F.lit(True)))
        .select(
            "cluster_id",
            "mean_holding_days",
            F.get(F.array(*[F.lit(x) for x in names]), F.col("_rank") - 1).alias("profile"),
        )
    )


class SegmentEncoder(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fit the scaler and k-means on the behaviour features."""

    k = Param(Params._dummy(), "k", "number of clusters", TypeConverters.toInt)
    restarts = Param(Params._dummy(), "restarts", "k-means restarts", TypeConverters.toInt)
    maxIter = Param(Params._dummy(), "maxIter", "iterations per restart", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)

    def __init__(self, k=C.N_CLUSTERS, restarts=C.KMEANS_RESTARTS, maxIter=C.KMEANS_MAX_ITER, seed=C.SEED):
        super().__init__()
        self._set(k=k, restarts=restarts, maxIter=maxIter, seed=seed)

    def _fit(self, dataset: DataFrame) -> "SegmentEncoderModel":
        stats = {r.feature: r for r in scaler_stats(dataset).collect()}
        means = [stats[f].mean for f in C.CLUSTER_FEATURES]
        stds = [stats[f].std for f in C.CLUSTER_FEATURES]
        names = [f"x{i}" for i in range(len(means))]
        points = dataset.select(*[x.alias(n) for x, n in zip(scaled(means, stds), names)])
        o = self.getOrDefault
        centers, cost = fit_kmeans(points, names, o(self.k), o(self.restarts), o(self.maxIter), seed=o(self.seed))
        return SegmentEncoderModel(means, stds, centers.ravel().tolist(), cost)


class SegmentEncoderModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``cluster_id`` and the model matrix ``features`` (churn features, one-hot)."""

    means = Param(Params._dummy(), "means", "feature means", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "feature deviations", TypeConverters.toListFloat)
    centers = Param(Params._dummy(), "centers", "row-major centres", TypeConverters.toListFloat)
    cost = Param(Params._dummy(), "cost", "inertia", TypeConverters.toFloat)

    def __init__(self, means=None, stds=None, centers=None, cost=None):
        super().__init__()
        if means is not None:
            self._set(means=means, stds=stds, centers=centers)
            if cost is not None:
                self._set(cost=cost)

    @property
    def n_clusters(self) -> int:
        return len(self.getOrDefault(self.centers)) // len(self.getOrDefault(self.means))

    def cluster(self) -> Column:
        dims = len(self.getOrDefault(self.means))
        flat = self.getOrDefault(self.centers)
        rows = [flat[i : i + dims] for i in range(0, len(flat), dims)]
        return nearest(scaled(self.getOrDefault(self.means), self.getOrDefault(self.stds)), rows)

    def feature_names(self) -> list[str]:
        return [*C.CHURN_FEATURES, *[f"cluster_{i}" for i in range(self.n_clusters)]]

    def predict_cluster(self, clients: DataFrame) -> DataFrame:
        return clients.withColumn("cluster_id", self.cluster())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        hot = one_hot(F.col("cluster_id"), self.n_clusters)
        base = F.array(*[F.col(f).cast("double") for f in C.CHURN_FEATURES])
        return self.predict_cluster(dataset).withColumn("features", F.concat(base, hot))


class ProfileResolver(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Name clusters by their mean holding time."""

    def _fit(self, dataset: DataFrame) -> "ProfileResolverModel":
        rows = cluster_holding(dataset).limit(len(C.PROFILES_BY_HOLDING) + 1).collect()
        if len(rows) != len(C.PROFILES_BY_HOLDING):
            n = cluster_holding(dataset).count()
            raise ValueError(f"expected exactly {len(C.PROFILES_BY_HOLDING)} clusters, got {n}")
        order = sorted(rows, key=lambda r: (r.mean_holding_days, r.cluster_id))
        return ProfileResolverModel([r.cluster_id for r in order])


class ProfileResolverModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``profile``; a cluster that was never named is balanced."""

    clusters = Param(Params._dummy(), "clusters", "cluster ids by ascending holding time", TypeConverters.toListInt)

    def __init__(self, clusters=None):
        super().__init__()
        if clusters is not None:
            self._set(clusters=clusters)

    def mapping(self) -> dict[int, str]:
        if not self.isSet(self.clusters):
            raise RuntimeError("the profile resolver must be fitted before it is used")
        return dict(zip(self.getOrDefault(self.clusters), C.PROFILES_BY_HOLDING))

    def profile(self, cluster: Column | str = "cluster_id") -> Column:
        return lookup(self.mapping(), cluster, C.DEFAULT_PROFILE)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn("profile", self.profile())
