"""Market snapshot: returns, annualised means, Ledoit-Wolf covariance, PD repair.

All steps are keyed by ``as_of``; one shuffle places each snapshot's window (at
most ``days`` dates) in one task group, and panel, forward fill, returns, moments
and shrinkage all run on that partitioning.  The universe is a small constant, so
the panel is wide (a column per asset) and every covariance entry is an
aggregate of one pass; no asset pairs are ever emitted as rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portrisk import config as C
from portrisk.functions.arrays import total
from portrisk.sources.prices import asset_prices

INF = float("inf")


def price_panel(windowed: DataFrame, universe=C.UNIVERSE) -> DataFrame:
    """(as_of, date, p_i, present_i): closes forward-filled over the union of dates.

    ``present_i`` says whether asset i has price rows in the window at all; an
    asset with rows but only null closes is present.
    """
    p = range(len(universe))
    long = asset_prices(windowed, universe).repartition("as_of")
    by_date = long.groupBy("as_of", "date").agg(
        *[F.max(F.when(F.col("ord") == i, F.col("close"))).alias(f"p_{i}") for i in p],
        *[F.max(F.col("ord") == i).alias(f"here_{i}") for i in p],
    )
    fill = Window.partitionBy("as_of").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("as_of")
    return by_date.select(
        "as_of",
        "date",
        *[F.last(f"p_{i}", ignorenulls=True).over(fill).alias(f"p_{i}") for i in p],
        *[F.max(f"here_{i}").over(whole).alias(f"present_{i}") for i in p],
    )


def return_panel(windowed: DataFrame, universe=C.UNIVERSE) -> DataFrame:
    """Add r_i (percent change) and ``complete``: every present asset has a return.

    A zero previous price gives an infinite return, as a plain division would;
    the snapshot step then reports the window as unusable.
    """
    p = range(len(universe))
    w = Window.partitionBy("as_of").orderBy("date")

    def pct(i: int) -> Column:
        now, before = F.col(f"p_{i}"), F.lag(f"p_{i}").over(w)
        return F.when(before == 0, F.when(now.isNotNull(), INF)).otherwise(now / F.nullif(before, F.lit(0.0)) - 1)

    panel = price_panel(windowed, universe)
    panel = panel.select("*", *[pct(i).alias(f"r_{i}") for i in p])
    ok = [~F.col(f"present_{i}") | F.col(f"r_{i}").isNotNull() for i in p]
    complete = ok[0]
    for c in ok[1:]:
        complete = complete & c
    anyone = F.coalesce(*[F.when(F.col(f"present_{i}"), True) for i in p], F.lit(False))
    return panel.withColumn("complete", complete & anyone)


def returns_long(windowed: DataFrame, universe=C.UNIVERSE) -> DataFrame:
    """(as_of, date, asset, ret) of complete dates only."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(a.asset).alias("asset"), F.col(f"r_{a.ord}").alias("ret")) for a in universe])
    )
    return (
        return_panel(windowed, universe)
        .where("complete")
        .select("as_of", "date", cells.alias("x"))
        .select("as_of", "date", "x.asset", "x.ret")
        .where(F.col("ret").isNotNull())
    )


def prices_filled(windowed: DataFrame, universe=C.UNIVERSE) -> DataFrame:
    """(as_of, date, asset, close) after the forward fill, nulls before the first price."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(a.asset).alias("asset"), F.col(f"p_{a.ord}").alias("close")) for a in universe])
    )
    return (
        price_panel(windowed, universe)
        .select("as_of", "date", cells.alias("x"))
        .select("as_of", "date", "x.asset", "x.close")
    )


def history_check(windowed: DataFrame, universe=C.UNIVERSE, minimum: int = C.MIN_HISTORY_DATES) -> DataFrame:
    """Number of dates per as_of and whether it suffices."""
    dates = asset_prices(windowed, universe).groupBy("as_of", "date").agg(F.lit(1).alias("one"))
    n = dates.groupBy("as_of").agg(F.count("one").alias("n_dates"))
    return n.withColumn("enough_history", F.col("n_dates") >= minimum)


def _pair(i: int, j: int) -> str:
    return f"s_{min(i, j)}_{max(i, j)}"


def return_moments(windowed: DataFrame, universe=C.UNIVERSE) -> DataFrame:
    """One row per as_of: n, mean_i, s_i_j (population covariance), q4 = sum_k |x_k|^4."""
    p = range(len(universe))
    whole = Window.partitionBy("as_of")
    panel = return_panel(windowed, universe)
    used = panel.select(
        "as_of",
        "date",
        "complete",
        *[F.col(f"present_{i}") for i in p],
        *[F.when(F.col("complete"), F.col(f"r_{i}")).alias(f"r_{i}") for i in p],
    )
    centred = used.select("*", *[(F.col(f"r_{i}") - F.avg(f"r_{i}").over(whole)).alias(f"x_{i}") for i in p])
    square = total([F.coalesce(F.col(f"x_{i}") * F.col(f"x_{i}"), F.lit(0.0)) for i in p])
    return centred.groupBy("as_of").agg(
        F.count("date").alias("n_dates"),
        F.count_if("complete").alias("n_days"),
        F.max(F.coalesce(*[F.when(F.abs(f"r_{i}") == INF, True) for i in p], F.lit(False))).alias("infinite"),
        F.sum(square * square).alias("q4"),
        *[F.max(f"present_{i}").alias(f"present_{i}") for i in p],
        *[F.avg(f"r_{i}").alias(f"mean_{i}") for i in p],
        *[
            F.avg(F.col(f"x_{i}") * F.col(f"x_{j}")).alias(_pair(i, j))
            for i in p
            for j in p
            if i <= j
        ],
    )


def shrink_covariance(cov: np.ndarray, q4: float, n: int) -> tuple[float, np.ndarray]:
    """Ledoit-Wolf (2004) intensity toward m*I, and the shrunk matrix."""
    p = len(cov)
    m = np.trace(cov) / p
    squares = (cov * cov).sum()
    distance = (squares - p * m * m) / p
    noise = min((q4 / n - squares) / (p * n), distance)
    s = 0.0 if p == 1 or noise == 0 or distance == 0 else noise / distance
    return s, (1 - s) * cov + s * m * np.eye(p)


def market_snapshots(
    windowed: DataFrame,
    universe=C.UNIVERSE,
    trading_days: int = C.TRADING_DAYS,
    minimum: int = C.MIN_HISTORY_DATES,
) -> DataFrame:
    """(as_of, status, n_dates, n_days, shrinkage, mu, sigma), one row per as_of.

    Absent assets get mean 0 and a zero covariance row.  ``status`` is ``ok`` or the
    reason the refresh fails; failed rows carry null mu and sigma.  Only the moment
    rows, one per snapshot, reach Python.
    """
    k = len(universe)
    p = range(k)
    status = (
        F.when(F.col("n_dates") < minimum, "insufficient_history")
        .when(F.col("n_days") == 0, "no_complete_date")
        .when(F.col("infinite"), "infinite_return")
        .otherwise("ok")
    )
    rows = return_moments(windowed, universe).select(
        "as_of",
        status.alias("status"),
        "n_dates",
        "n_days",
        "q4",
        F.array(*[F.col(f"present_{i}") for i in p]).alias("present"),
        F.array(*[F.col(f"mean_{i}") for i in p]).alias("mean"),
        F.array(*[F.col(_pair(i, j)) for i in p for j in p]).alias("cov"),
    )

    @F.pandas_udf("shrinkage double, mu array<double>, sigma array<array<double>>")
    def finish(status: pd.Series, n: pd.Series, q4: pd.Series, present: pd.Series, mean: pd.Series, cov: pd.Series) -> pd.DataFrame:
        out = []
        for st, days, fourth, here, means, flat in zip(status, n, q4, present, mean, cov):
            if st != "ok":
                out.append((None, None, None))
                continue
            at = np.flatnonzero(np.asarray(here, dtype=bool))
            full = np.asarray(flat, dtype=float).reshape(k, k)
            s, shrunk = shrink_covariance(full[np.ix_(at, at)], fourth, days)
            sigma, mu = np.zeros((k, k)), np.zeros(k)
            sigma[np.ix_(at, at)] = trading_days * shrunk
            mu[at] = trading_days * np.asarray(means, dtype=float)[at]
            out.append((s, mu.tolist(), sigma.tolist()))
        return pd.DataFrame(out, columns=["shrinkage", "mu", "sigma"])

    done = rows.withColumn("_f", finish("status", "n_days", "q4", "present", "mean", "cov"))
    return done.select(
        "as_of",
        "status",
        "n_dates",
        "n_days",
        F.col("_f.shrinkage").alias("shrinkage"),
        F.col("_f.mu").alias("mu"),
        F.col("_f.sigma").alias("sigma"),
    )


def market_mu(snapshots: DataFrame, universe=C.UNIVERSE) -> DataFrame:
    names = F.array(*[F.lit(a.asset) for a in universe])
    return snapshots.where("status = 'ok'").select("as_of", F.posexplode("mu").alias("i", "mu")).select(
        "as_of", F.get(names, F.col("i")).alias("asset"), "mu"
    )


def market_cov(snapshots: DataFrame, universe=C.UNIVERSE) -> DataFrame:
    names = F.array(*[F.lit(a.asset) for a in universe])
    rows = snapshots.where("status = 'ok'").select("as_of", F.posexplode("sigma").alias("i", "row"))
    cells = rows.select("as_of", "i", F.posexplode("row").alias("j", "cov"))
    return cells.select(
        "as_of", F.get(names, F.col("i")).alias("asset_i"), F.get(names, F.col("j")).alias("asset_j"), "cov"
    )


def sample_cov(windowed: DataFrame, universe=C.UNIVERSE) -> DataFrame:
    """Population covariance of daily returns, one row per ordered asset pair."""
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(a.asset).alias("asset_i"),
                    F.lit(b.asset).alias("asset_j"),
                    F.col(_pair(a.ord, b.ord)).alias("cov"),
                )
                for a in universe
                for b in universe
            ]
        )
    )
    return return_moments(windowed, universe).select("as_of", cells.alias("x")).select("as_of", "x.*").where("cov is not null")


def repair_matrix(matrix: np.ndarray, jitter: float, tries: int) -> tuple[np.ndarray | None, float]:
    """Add growing diagonal jitter until a Cholesky factorisation succeeds."""
    added = 0.0
    eye = np.eye(len(matrix))
    if not np.isfinite(matrix).all():
        return None, added
    for attempt in range(tries):
        try:
            np.linalg.cholesky(matrix + added * eye)
            return matrix + added * eye, added
        except np.linalg.LinAlgError:
            added += jitter * 10.0**attempt
    return None, added


def pd_repair(snapshots: DataFrame, jitter: float = C.SIGMA_JITTER, tries: int = C.JITTER_TRIES) -> DataFrame:
    """Replace ``sigma`` by a positive definite one and add ``jitter_used``.

    A matrix that stays singular turns the row's status into ``not_repairable``.
    """

    @F.pandas_udf("sigma array<array<double>>, jitter double")
    def repaired(col: pd.Series) -> pd.DataFrame:
        out = []
        for value in col:
            if value is None:
                out.append((None, None))
                continue
            fixed, used = repair_matrix(np.array([np.asarray(r, float) for r in value]), jitter, tries)
            out.append((None if fixed is None else fixed.tolist(), used))
        return pd.DataFrame(out, columns=["sigma", "jitter"])

    rows = snapshots.withColumn("_r", repaired("sigma"))
    broken = (F.col("status") == "ok") & F.col("_r.sigma").isNull()
    return rows.select(
        "as_of",
        F.when(broken, "not_repairable").otherwise(F.col("status")).alias("status"),
        "n_dates",
        "n_days",
        "shrinkage",
        "mu",
        F.col("_r.sigma").alias("sigma"),
        F.col("_r.jitter").alias("jitter_used"),
    )


@dataclass(frozen=True)
class Snapshot:
    """One market snapshot on the driver: p means and a p x p matrix."""

    as_of: object
    mu: tuple[float, ...]
    sigma: tuple[tuple[float, ...], ...]
    shrinkage: float
    n_days: int


def latest_snapshot(snapshots: DataFrame) -> Snapshot:
    """Newest successful snapshot, repaired; a failed refresh leaves the older one in use."""
    good = pd_repair(snapshots.where("status = 'ok'")).where("status = 'ok'")
    rows = good.agg(F.max_by(F.struct(*good.columns), "as_of").alias("r")).where("r IS NOT NULL").select("r.*").collect()
    if not rows:
        raise RuntimeError("no successful market snapshot is available")
    r = rows[0]
    return Snapshot(r.as_of, tuple(r.mu), tuple(map(tuple, r.sigma)), r.shrinkage, r.n_days)
