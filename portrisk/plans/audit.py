"""Check of the monotone contract on a fitted classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portrisk import config as C
from portrisk.functions.arrays import total
from portrisk.sources.artifacts import ChurnModel

# --- fixed values: grid per constrained feature ----------------------------------
GRID = {
    "account_balance": (1000.0, 20000.0, 50000.0, 100000.0, 200000.0),
    "balance_velocity": (0.0, 0.4, 0.8, 1.5, 5.0),
    "market_pain_index": (0.0, 0.25, 0.5, 0.75, 1.0),
    "login_freq_drop": (0.0, 0.3, 0.6, 1.0, 5.0),
}


def monotonicity_audit(clients: DataFrame, model: ChurnModel, grid=GRID, signs=C.MONOTONE_SIGNS) -> DataFrame:
    """(feature, n_pairs, n_violations): each client's score along a grid of one feature.

    All grid points of a client are scored side by side in its own row, in one
    Python pass that evaluates each split once, so neighbours are compared without a shuffle.
    """
    rows = model.segments.transform(clients).select("features")
    points = [(f, i, v) for f, values in grid.items() for i, v in enumerate(values)]
    scores = model.classifier.scorer_along(rows.sparkSession, [(C.MODEL_FEATURES.index(f), v) for f, _, v in points])
    at = {(f, i): F.col(f"margins.m{j}") for j, (f, i, _) in enumerate(points)}
    scored = rows.select(scores("features").alias("margins"))
    counts, cells = [], []
    for f, values in grid.items():
        sign = signs[C.MODEL_FEATURES.index(f)]
        steps = [at[f, i + 1] - at[f, i] for i in range(len(values) - 1)]
        bad = total([F.when(sign * d < -1e-12, 1).otherwise(0) for d in steps])
        counts += [F.sum(F.lit(len(steps))).alias(f"n_{f}"), F.sum(bad).alias(f"bad_{f}")]
        cells.append(
            F.struct(F.lit(f).alias("feature"), F.col(f"n_{f}").alias("n_pairs"), F.col(f"bad_{f}").alias("n_violations"))
        )
    return scored.agg(*counts).select(F.explode(F.array(*cells)).alias("x")).select("x.*")
