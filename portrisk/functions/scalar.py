"""Column expressions shared by the operators.  All stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from portrisk import config as C


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(mapping: dict, key: Column | str, default) -> Column:
    """Constant dictionary lookup with a default for unknown or null keys."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(key)), F.lit(default))


def clip(c: Column, low, high) -> Column:
    """Clip a non-null value; a null stays null (greatest/least would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def churn_logit() -> Column:
    """Latent churn log-odds of a client row."""
    # fixed values: coefficients of the latent score
    return (
        -4.0 * (F.col("balance_velocity") - 0.70)
        + 4.5 * (F.col("market_pain_index") - 0.50)
        + 3.0 * (F.col("login_freq_drop") - 0.60)
        - 0.5 * (F.col("account_balance") / 50000.0 - 1.5)
    )


def latent_churn() -> Column:
    return sigmoid(churn_logit())


def md5_uniform(key: Column | str, salt: str = "") -> Column:
    """Deterministic uniform in [0, 1) from an id: the first 32 bits of its md5."""
    text = F.concat(F.lit(salt), col(key).cast("string")) if salt else col(key).cast("string")
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def churn_label(probability: Column, u: Column, noise: Column | None = None) -> Column:
    p = probability if noise is None else clip(probability + noise, 0.0, 1.0)
    return F.when(u < p, 1).otherwise(0)


def risk_band(p: Column) -> tuple[Column, Column]:
    """Colour and message of a churn probability."""
    colour = message = None
    for limit, c, m in C.RISK_BANDS[:-1]:
        colour = F.when(p < limit, c) if colour is None else colour.when(p < limit, c)
        message = F.when(p < limit, m) if message is None else message.when(p < limit, m)
    _, c, m = C.RISK_BANDS[-1]
    return colour.otherwise(c), message.otherwise(m)


def action_required(p: Column, threshold: float = C.CHURN_THRESHOLD) -> Column:
    return p > threshold


def predicted_label(p: Column, threshold: float = C.CHURN_THRESHOLD) -> Column:
    return F.when(p >= threshold, 1).otherwise(0)


def action_status(p: Column) -> Column:
    return F.when(action_required(p), C.STATUS_TRIGGERED).otherwise(C.STATUS_STABLE)


def percent_text(weight: Column) -> Column:
    return F.format_string("%.2f%%", weight * 100)


def dollar_text(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, 2))


def client_title(client_id: Column, description: Column) -> Column:
    return F.concat(F.lit("Client #"), client_id.cast("string"), F.lit(" — "), description)


def model_version(trained_at: str | None, name: str = C.MODEL_NAME) -> str:
    return f"{name} (trained {(trained_at or 'unknown')[:10]})"
