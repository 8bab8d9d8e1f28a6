"""Client record contract: rules as columns, valid and rejected rows as two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portrisk import config as C

# --- fixed values: (lowest, highest, lowest is exclusive) per feature -------------
BOUNDS = {
    "avg_holding_days": (1.0, 3650.0, False),
    "crypto_ratio": (0.0, 1.0, False),
    "tech_stocks_ratio": (0.0, 1.0, False),
    "account_balance": (0.0, None, True),
    "balance_velocity": (0.0, 5.0, False),
    "market_pain_index": (0.0, 1.0, False),
    "login_freq_drop": (0.0, 5.0, False),
}
INTEGER_FEATURES = ("avg_holding_days",)
CROSS_RULE = "exposure:above_one"


def _number(name: str) -> Column:
    return F.col(name).try_cast("double")


def _client_id() -> Column:
    """The optional id as a whole number, null if it is none."""
    x = F.col("client_id").cast("string").try_cast("double")
    return F.coalesce(F.col("client_id").cast("string").try_cast("bigint"), F.when(x == F.floor(x), x.try_cast("bigint")))


def _field_violation(name: str) -> Column:
    """First broken rule of one feature, null when it is fine.

    Spark orders NaN above every number, so NaN and infinity are ruled out
    before the bounds are compared.
    """
    low, high, exclusive = BOUNDS[name]
    x = _number(name)
    infinite = F.abs(x) == F.lit(float("inf"))
    rule = (
        F.when(F.col(name).isNull(), f"{name}:missing")
        .when(x.isNull(), f"{name}:not_numeric")
        .when(F.isnan(x) | infinite, f"{name}:not_finite")
    )
    if name in INTEGER_FEATURES:
        rule = rule.when(x != F.floor(x), f"{name}:not_integer")
    rule = rule.when(x <= low if exclusive else x < low, f"{name}:below_min")
    if high is not None:
        rule = rule.when(x > high, f"{name}:above_max")
    return rule


def with_violations(clients: DataFrame) -> DataFrame:
    """Add ``violations`` (array of codes) and ``message`` (cross-field rule text).

    The cross-field rule runs only for rows whose single fields are all fine.
    """
    rules = [_field_violation(f) for f in C.ALL_FEATURES]
    if "client_id" in clients.columns:
        rules.append(F.when(F.col("client_id").isNotNull() & _client_id().isNull(), "client_id:not_integer"))
    fields = F.array_compact(F.array(*rules))
    crypto, tech = _number("crypto_ratio"), _number("tech_stocks_ratio")
    over = (F.size("_fields") == 0) & (crypto + tech > 1.0)
    text = F.format_string(
        "crypto_ratio (%.2f) + tech_stocks_ratio (%.2f) = %.2f > 1.0", crypto, tech, crypto + tech
    )
    return (
        clients.withColumn("_fields", fields)
        .withColumn("violations", F.when(over, F.array(F.lit(CROSS_RULE))).otherwise(F.col("_fields")))
        .withColumn("message", F.when(over, text))
        .drop("_fields")
    )


def _typed(clients: DataFrame) -> list[Column]:
    optional_id = _client_id() if "client_id" in clients.columns else F.lit(None)
    optional_text = F.col("description") if "description" in clients.columns else F.lit(None)
    numbers = [
        (_number(f).cast("int") if f in INTEGER_FEATURES else _number(f)).alias(f)
        for f in C.ALL_FEATURES
    ]
    known = {"client_id", "description", "violations", "message", *C.ALL_FEATURES}
    extra = [F.col(c) for c in clients.columns if c not in known]
    return [
        optional_id.cast("bigint").alias("client_id"),
        F.coalesce(optional_text.cast("string"), F.lit("")).alias("description"),
        *numbers,
        *extra,
    ]


def valid_clients(clients: DataFrame) -> DataFrame:
    """Rows that keep the contract, with contract types; other columns pass through."""
    checked = clients if "violations" in clients.columns else with_violations(clients)
    return checked.where(F.size("violations") == 0).select(*_typed(checked))


def rejected_clients(clients: DataFrame) -> DataFrame:
    """Rows that break it, unchanged, with the reasons."""
    checked = clients if "violations" in clients.columns else with_violations(clients)
    return checked.where(F.size("violations") > 0)
