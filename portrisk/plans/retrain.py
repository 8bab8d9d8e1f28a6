"""Drift-gated retraining job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from portrisk import config as C
from portrisk.operators.drift import drift_results, retrain_decision
from portrisk.plans.training import TrainingResult, run_training
from portrisk.sources import artifacts


@dataclass(frozen=True)
class RetrainResult:
    drift: DataFrame
    retrained: bool
    training: TrainingResult | None = None


def check_and_retrain(current: DataFrame, labelled: DataFrame, root: str, features=C.MONITORED_FEATURES, **boosting) -> RetrainResult:
    """Compare ``current`` with the stored reference; retrain on ``labelled`` if it drifted.

    Training writes the new model and the new reference sample.
    """
    reference = artifacts.load_or_create_reference(current.sparkSession, root, labelled)
    rows = drift_results(reference, current, features).collect()  # one row per feature
    drift = current.sparkSession.createDataFrame(rows, drift_results(reference, current, features).schema)
    if not retrain_decision(drift).first().retrain:
        return RetrainResult(drift, False)
    return RetrainResult(drift, True, run_training(labelled, root, **boosting))
