import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from portrisk.operators import portfolio
from portrisk.operators.market import Snapshot

RNG = np.random.default_rng(0)
A = RNG.normal(size=(7, 7)) * 0.2
SNAP = Snapshot(None, tuple(RNG.normal(size=7) * 0.2), tuple(map(tuple, A @ A.T)), 0.1, 300)

BOUNDS = [
    ("aggressive", 0.75, 0.20, 0.02, [0.05, 0.05, 0.40, 0.05, 0.05, 0.375, 0.375]),
    ("conservative", 0.0, 0.15, 0.08, [0.10, 0.10, 0.40, 0.10, 0.10, 0.10, 0.10]),
    ("balanced", 0.25, 0.35, 0.05, [0.0875, 0.0875, 0.40, 0.0875, 0.0875, 0.125, 0.125]),
    ("aggressive", 0.50, 0.40, 0.02, [0.10, 0.10, 0.40, 0.10, 0.10, 0.25, 0.25]),
    ("conservative", 0.05, 0.10, 0.08, [0.10, 0.10, 0.40, 0.10, 0.10, 0.10, 0.10]),
    ("balanced", 0.15, 0.45, 0.05, [0.1125, 0.1125, 0.40, 0.1125, 0.1125, 0.075, 0.075]),
    ("aggressive", 0.80, 0.10, 0.02, [0.025, 0.025, 0.40, 0.025, 0.025, 0.40, 0.40]),
]


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(i, p, c, t, 0.8, 1000.0) for i, (p, c, t, _, _) in enumerate(BOUNDS)]
    return spark.createDataFrame(
        rows, "client_id int, profile string, crypto_ratio double, tech_stocks_ratio double, churn_probability double, account_balance double"
    )


def test_bounds_golden(golden):
    for r in portfolio.with_bounds(golden).collect():
        _, _, _, lb, ub = BOUNDS[r.client_id]
        assert r.lb == lb and np.allclose(r.ub, ub)


def test_tight_budget_forces_upper_bounds(golden):
    for r in portfolio.optimize_portfolios(golden, SNAP).collect():
        ub = BOUNDS[r.client_id][4]
        if abs(sum(ub) - 1) < 1e-9:
            assert np.allclose(r.weights, ub, atol=1e-9)


def test_gamma_golden(spark):
    df = spark.createDataFrame([(p, x) for x in ("aggressive", "balanced", "conservative", "other") for p in (0.5, 0.75, 1.0)], "p double, profile string")
    got = [r[0] for r in df.select(portfolio.risk_aversion("profile", "p")).collect()]
    want = [1.5, 2.473082, 4.077423, 4.0, 6.594885, 10.873127, 8.0, 13.189770, 21.746255, 4.0, 6.594885, 10.873127]
    assert np.allclose(got, want, atol=1e-6)


def test_only_flagged_clients(golden):
    assert portfolio.optimize_portfolios(golden.withColumn("churn_probability", F.lit(0.5)), SNAP).count() == 0


def test_solver_is_optimal():
    n = 4000
    gamma, ub = RNG.uniform(1.5, 21, n), np.clip(RNG.uniform(0, 0.4, (n, 7)), 0.02, 0.4)
    ub[:, 2] = 0.4
    keep = ub.sum(1) >= 1
    gamma, ub = gamma[keep], ub[keep]
    lb = np.full_like(ub, 0.02)
    mu, sigma = np.array(SNAP.mu), np.array(SNAP.sigma)
    w, ok = portfolio.solve_batch(gamma, lb, ub, mu, sigma)
    assert ok.all() and np.abs(w.sum(1) - 1).max() < 1e-9 and (w >= lb - 1e-12).all() and (w <= ub + 1e-12).all()
    g = -mu + gamma[:, None] * (w @ sigma) + 0.4 * (w - 1 / 7)
    falls = np.where(w > lb + 1e-9, g, -np.inf).max(1)
    rises = np.where(w < ub - 1e-9, g, np.inf).min(1)
    assert (falls - rises).max() < 1e-7


def test_projection():
    y = RNG.normal(size=(500, 7))
    lb, ub = np.full((500, 7), 0.02), np.full((500, 7), 0.4)
    w = portfolio.project(y, lb, ub)
    assert np.allclose(w.sum(1), 1) and (w >= 0.02 - 1e-12).all() and (w <= 0.4 + 1e-12).all()
    t = np.where((w > 0.02 + 1e-9) & (w < 0.4 - 1e-9), y - w, np.nan)
    assert np.nanmax(np.nanmax(t, 1) - np.nanmin(t, 1)) < 1e-9


def test_fallback_when_not_converged():
    lb, ub = np.full((1, 7), 0.02), np.full((1, 7), 0.4)
    w, ok = portfolio.solve_batch(np.array([5.0]), lb, ub, np.array(SNAP.mu), np.array(SNAP.sigma), max_iter=1)
    assert not ok[0] and math.isclose(w.sum(), 1, abs_tol=1e-9)


def test_breakdown_drops_dust(spark):
    df = spark.createDataFrame([(1, 1234567.0, [0.005, 0.0051, 0.2, 0.2, 0.2, 0.2, 0.1899])], "client_id int, account_balance double, weights array<double>")
    rows = {r.asset: r for r in portfolio.allocation_breakdown(df).collect()}
    assert "AAPL" not in rows and rows["KO"].weight_text == "20.00%" and rows["KO"].capital_text == "$246,913.40"
