"""Churn-aware mean-variance allocation: risk aversion, bounds, batch solve, checks.

Everything but the solve is a column expression over one client row; the universe
is a constant, so asset vectors are array columns and no client row is multiplied
unless a long result is asked for.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portrisk import config as C
from portrisk.functions.arrays import items, total
from portrisk.functions.scalar import action_required, dollar_text, lookup, percent_text
from portrisk.operators.market import Snapshot


def risk_aversion(profile: Column | str, p: Column | str, scale: float = C.GAMMA_CHURN_SCALE) -> Column:
    """Base aversion of the profile, raised exponentially above the churn threshold."""
    p = F.col(p) if isinstance(p, str) else p
    base = lookup(C.RISK_AVERSION, profile, C.DEFAULT_RISK_AVERSION)
    excess = (p - C.CHURN_THRESHOLD) / (1.0 - C.CHURN_THRESHOLD)
    return F.when(p <= C.CHURN_THRESHOLD, base).otherwise(base * F.exp(excess * scale))


def min_weight(profile: Column | str, n: int = len(C.UNIVERSE)) -> Column:
    w = lookup(C.MIN_WEIGHT, profile, C.DEFAULT_MIN_WEIGHT)
    return F.when(w * n > 1.0, F.lit(1.0 / n)).otherwise(w)


def with_bounds(clients: DataFrame, profile: str = "profile", universe=C.UNIVERSE, cap: float = C.WEIGHT_MAX) -> DataFrame:
    """Add ``lb`` (one number) and ``ub`` (array over the universe).

    Upper bounds come from the client's crypto and tech shares, are clamped, and if
    they cannot reach a full portfolio the gap is shared out by headroom.
    """
    n = len(universe)
    n_kind = {k: max(sum(a.kind == k for a in universe), 1) for k in ("crypto", "tech")}
    raw = {
        "crypto": F.col("crypto_ratio") / n_kind["crypto"],
        "tech": F.col("tech_stocks_ratio") / n_kind["tech"],
    }
    wanted = F.array(*[raw.get(a.kind, F.lit(cap)) for a in universe])
    # Array functions name each intermediate once, which keeps the plan small.
    rows = clients.withColumn("lb", min_weight(profile, n))
    rows = rows.withColumn("_c", F.transform(wanted, lambda x: F.greatest(F.col("lb"), F.least(F.lit(cap), x))))
    rows = rows.withColumn("_sum", F.aggregate("_c", F.lit(0.0), lambda a, x: a + x))
    room = n * cap - F.col("_sum")
    share = F.when(F.col("_sum") >= 1.0 - 1e-9, 0.0).when(room > 1e-12, (1.0 - F.col("_sum")) / room)
    # A null share means no headroom at all: everything goes to the cap.
    rows = rows.withColumn("_share", share)
    ub = F.transform("_c", lambda x: F.least(F.lit(cap), F.coalesce(x + (cap - x) * F.col("_share"), F.lit(cap))))
    return rows.withColumn("ub", ub).drop("_c", "_sum", "_share")


def bounds_long(bounded: DataFrame, keep=("client_id",), universe=C.UNIVERSE) -> DataFrame:
    names = F.array(*[F.lit(a.asset) for a in universe])
    rows = bounded.select(*keep, "lb", F.posexplode("ub").alias("i", "ub"))
    return rows.select(*keep, F.get(names, F.col("i")).alias("asset"), "lb", "ub")


def start_weights(n: int = len(C.UNIVERSE)) -> Column:
    """Equal weights clipped into the box and rescaled to one; also the fallback point."""
    clipped = F.transform("ub", lambda u: F.greatest(F.col("lb"), F.least(F.lit(1.0 / n), u)))
    size = F.aggregate(clipped, F.lit(0.0), lambda a, x: a + x)
    usable = F.when(size > 0, clipped).otherwise(F.array_repeat(F.col("lb"), n))
    norm = F.aggregate(usable, F.lit(0.0), lambda a, x: a + x)
    return F.transform(usable, lambda x: x / norm)


def project(y: np.ndarray, lb: np.ndarray, ub: np.ndarray) -> np.ndarray:
    """Rows of ``y`` projected onto {lb <= w <= ub, sum w = 1}.

    sum clip(y - t) falls piecewise linearly in t, with kinks at y - lb and y - ub, so
    the right piece gives t exactly.
    """
    kinks = np.sort(np.concatenate([y - lb, y - ub], axis=1), axis=1)
    sums = np.clip(y[:, None, :] - kinks[:, :, None], lb[:, None, :], ub[:, None, :]).sum(2)
    # sums falls along axis 1: last kink whose sum is still >= 1
    at = np.clip((sums >= 1.0).sum(1) - 1, 0, kinks.shape[1] - 2)
    rows = np.arange(len(y))
    s0, s1, t0, t1 = sums[rows, at], sums[rows, at + 1], kinks[rows, at], kinks[rows, at + 1]
    fall = s0 - s1
    t = t0 + np.where(fall > 0, (s0 - 1.0) / np.where(fall > 0, fall, 1.0), 0.0) * (t1 - t0)
    return np.clip(y - t[:, None], lb, ub)


def solve_batch(
    gamma: np.ndarray,
    lb: np.ndarray,
    ub: np.ndarray,
    mu: np.ndarray,
    sigma: np.ndarray,
    lam: float = C.DIVERSIFICATION_LAMBDA,
    tol: float = C.SOLVER_TOL,
    max_iter: int = C.SOLVER_MAX_ITER,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and convergence flags of a whole batch of clients.

    Minimises -mu'w + gamma/2 w'Sigma w + lam |w - w0|^2 over the box and the budget
    by accelerated projected gradient; the problem is strictly convex and each
    client uses its own curvature bounds.
    """
    rows, n = ub.shape
    w0 = 1.0 / n
    top = float(np.linalg.eigvalsh(sigma)[-1])
    low = max(float(np.linalg.eigvalsh(sigma)[0]), 0.0)
    big, small = gamma * top + 2 * lam, gamma * low + 2 * lam
    step = (1.0 / big)[:, None]
    ratio = np.sqrt(small / big)
    beta = ((1 - ratio) / (1 + ratio))[:, None]
    w = project(np.full((rows, n), w0), lb, ub)
    done = np.zeros(rows, bool)
    left = np.arange(rows)  # rows still moving, with their own iterates below
    now, y = w.copy(), w.copy()
    for i in range(max_iter):
        grad = -mu + gamma[left, None] * (y @ sigma) + 2 * lam * (y - w0)
        fresh = project(y - step[left] * grad, lb[left], ub[left])
        settled = (np.abs(fresh - now).max(1) < tol) & (np.abs(fresh - y).max(1) < tol)
        y = fresh + beta[left] * (fresh - now)
        now = fresh
        if settled.any() and (settled.all() or i % 8 == 7):
            w[left[settled]], done[left[settled]] = now[settled], True
            left, now, y = left[~settled], now[~settled], y[~settled]
        if not len(left):
            break
    w[left] = now
    return w, done


def final_weights(gamma, lb, ub, mu, sigma) -> tuple[np.ndarray, np.ndarray]:
    """Solved weights clipped into the box and scaled to one; the start point where the solve failed."""
    if not len(ub):
        return ub, np.zeros(0, bool)
    w, ok = solve_batch(gamma, lb, ub, mu, sigma)
    w = np.clip(w, lb, ub)
    size = w.sum(1, keepdims=True)
    start = np.clip(1.0 / ub.shape[1], lb, ub)
    start = np.where(start.sum(1, keepdims=True) > 0, start, lb)
    use = ok[:, None] & (size > 0)
    return np.where(use, w / np.where(size > 0, size, 1.0), start / start.sum(1, keepdims=True)), ok


def optimize_portfolios(
    clients: DataFrame, snapshot: Snapshot, probability: str = "churn_probability", flagged_only: bool = True
) -> DataFrame:
    """Add ``gamma``, ``lb``, ``ub``, ``weights`` and ``converged``.

    The action gate is applied before the solve (Spark does not move filters below a
    Python operator).  The snapshot is p + p*p numbers, fixed by the universe.
    """
    n = len(snapshot.mu)
    mu, sigma = np.array(snapshot.mu), np.array(snapshot.sigma)
    gated = clients.where(action_required(F.col(probability))) if flagged_only else clients
    rows = with_bounds(gated).withColumn("gamma", risk_aversion("profile", probability))

    @F.pandas_udf(", ".join([*[f"w{i} double" for i in range(n)], "ok boolean"]))
    def solved(gamma: pd.Series, lb: pd.Series, ub: pd.Series) -> pd.DataFrame:
        high = np.array(ub.tolist(), dtype=float).reshape(-1, n)
        low = np.repeat(lb.to_numpy(dtype=float)[:, None], n, axis=1)
        w, ok = final_weights(gamma.to_numpy(dtype=float), low, high, mu, sigma)
        table = {f"w{i}": w[:, i] for i in range(n)}
        table["ok"] = ok
        return pd.DataFrame(table)

    return (
        rows.withColumn("_s", solved.asNondeterministic()("gamma", "lb", "ub"))
        .withColumn("converged", F.col("_s.ok"))
        .withColumn("weights", F.array(*[F.col(f"_s.w{i}") for i in range(n)]))
        .drop("_s")
    )


def gradient(weights: Column, snapshot: Snapshot, lam: float = C.DIVERSIFICATION_LAMBDA) -> Column:
    """-mu + gamma Sigma w + 2 lam (w - w0) as an array expression."""
    n = len(snapshot.mu)
    w = items(weights, n)
    return F.array(
        *[
            F.col("gamma") * total([w[j] * snapshot.sigma[i][j] for j in range(n)])
            + 2 * lam * (w[i] - 1.0 / n)
            - snapshot.mu[i]
            for i in range(n)
        ]
    )


def with_kkt_residual(rows: DataFrame, snapshot: Snapshot, weights: str = "weights", tol: float = 1e-9) -> DataFrame:
    """Add ``kkt_residual`` and ``free_spread``.

    The residual is the best first-order gain of moving weight between two assets
    that may still fall and rise; at the optimum it is zero.  ``free_spread`` is the
    gradient range over assets strictly inside their bounds.
    """
    n = len(snapshot.mu)
    g, w, u = (items(F.col(c), n) for c in ("_g", weights, "ub"))
    lb = F.col("lb")
    falls = F.array_max(F.array(*[F.when(w[i] > lb + tol, g[i]) for i in range(n)]))
    rises = F.array_min(F.array(*[F.when(w[i] < u[i] - tol, g[i]) for i in range(n)]))
    free = F.array(*[F.when((w[i] > lb + tol) & (w[i] < u[i] - tol), g[i]) for i in range(n)])
    return (
        rows.withColumn("_g", gradient(F.col(weights), snapshot))
        .withColumn("kkt_residual", F.greatest(F.lit(0.0), F.coalesce(falls - rises, F.lit(0.0))))
        .withColumn("free_spread", F.coalesce(F.array_max(free) - F.array_min(free), F.lit(0.0)))
        .drop("_g")
    )


def with_utility(
    rows: DataFrame, snapshot: Snapshot, weights: str = "weights", lam: float = C.DIVERSIFICATION_LAMBDA
) -> DataFrame:
    """Add portfolio return, variance, diversification penalty and utility of given weights."""
    n = len(snapshot.mu)
    w = items(F.col(weights), n)
    ret = total([w[i] * snapshot.mu[i] for i in range(n)])
    var = total([w[i] * total([w[j] * snapshot.sigma[i][j] for j in range(n)]) for i in range(n)])
    pen = lam * total([(x - 1.0 / n) * (x - 1.0 / n) for x in w])
    return (
        rows.withColumn("portfolio_return", ret)
        .withColumn("portfolio_variance", var)
        .withColumn("penalty", pen)
        .withColumn(
            "utility",
            F.col("portfolio_return") - 0.5 * F.col("gamma") * F.col("portfolio_variance") - F.col("penalty"),
        )
    )


def allocation_breakdown(
    rows: DataFrame, weights: str = "weights", keep=("client_id",), dust: float = C.DUST_WEIGHT, universe=C.UNIVERSE
) -> DataFrame:
    """Long table of the weights above the dust limit, with display texts."""
    names = F.array(*[F.lit(a.asset) for a in universe])
    cells = rows.select(*keep, "account_balance", F.posexplode(weights).alias("i", "weight")).where(F.col("weight") > dust)
    amount = F.col("account_balance") * F.col("weight")
    return cells.select(
        *keep,
        F.get(names, F.col("i")).alias("asset"),
        "weight",
        (F.col("weight") * 100).alias("weight_pct"),
        amount.alias("capital"),
        percent_text(F.col("weight")).alias("weight_text"),
        dollar_text(amount).alias("capital_text"),
    )
