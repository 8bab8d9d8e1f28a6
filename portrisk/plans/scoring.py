"""Client scoring plans: profile and probability, explanation, allocation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portrisk import config as C
from portrisk.functions.scalar import action_required, action_status, risk_band
from portrisk.operators.explain import driver_texts, risk_drivers
from portrisk.operators.market import Snapshot
from portrisk.operators.portfolio import allocation_breakdown, optimize_portfolios
from portrisk.sources.artifacts import ChurnModel


def predict_clients(clients: DataFrame, model: ChurnModel) -> DataFrame:
    """Valid client rows plus ``cluster_id``, ``profile`` and ``churn_probability``."""
    encoded = model.profiles.transform(model.segments.transform(clients))
    return model.classifier.score(encoded).drop("features", "margin")


def predict_and_explain(clients: DataFrame, model: ChurnModel, digits: int = 4) -> DataFrame:
    """(client_id, churn_probability, risk_drivers, model_version) per client."""
    scored = model.classifier.score(model.segments.transform(clients), explain=True)
    drivers = risk_drivers(F.col("contributions"), model.segments.feature_names())
    keep = [c for c in clients.columns if c not in (*C.ALL_FEATURES, "description")]
    return scored.select(
        *keep,
        F.round("churn_probability", digits).alias("churn_probability"),
        driver_texts(drivers).alias("risk_drivers"),
        F.lit(model.version).alias("model_version"),
    )


def risk_view(scored: DataFrame, probability: str = "churn_probability") -> DataFrame:
    """What an adviser sees per client: band, message, action flag and status."""
    p = F.col(probability)
    colour, message = risk_band(p)
    return (
        scored.withColumn("band", colour)
        .withColumn("band_message", message)
        .withColumn("action_required", action_required(p))
        .withColumn("status", action_status(p))
        .withColumn("risk_text", F.format_string("%.2f%%", p * 100))
    )


def allocate_clients(clients: DataFrame, model: ChurnModel, snapshot: Snapshot) -> DataFrame:
    """Weights for every client above the action threshold; no shuffle."""
    return optimize_portfolios(predict_clients(clients, model), snapshot)


def allocation_report(clients: DataFrame, model: ChurnModel, snapshot: Snapshot) -> DataFrame:
    return allocation_breakdown(allocate_clients(clients, model, snapshot), keep=("client_id", "profile"))
