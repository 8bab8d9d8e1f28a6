"""Client features and price history derived from order, line and part tables.

Client table: ``lineitem`` is reduced to one row per order before it meets
``orders``; the reduced rows and ``orders`` then share one hash partitioning on
the order key, and a single pass over customers yields order and line figures
together.  Parts meet lines in a shuffled join, never through the driver, and
adaptive execution splits a skewed part or order key.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portrisk import config as C
from portrisk.functions.scalar import churn_label, latent_churn, md5_uniform
from portrisk.operators.contracts import valid_clients
from portrisk.session import read_table

# fixed values of the bridge definition
CUT = "1998-04-16 00:00:00"
CRYPTO_TYPES = ("PROMO", "ECONOMY")
TECH_TYPES = ("ECONOMY", "STANDARD", "LARGE")
BRANDS = tuple(f"Brand#{i}" for i in range(1, 8))
BRIDGE_UNIVERSE = tuple(replace(a, ticker=BRANDS[a.ord]) for a in C.UNIVERSE)


def client_raw(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"
    )
    lines = read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_extendedprice", "l_returnflag"
    )
    parts = read_table(spark, folder, "part").select("p_partkey", "p_type")
    customers = read_table(spark, folder, "customer").select("c_custkey", "c_acctbal")

    price = F.col("l_extendedprice")
    # The part table grows with the lines; Spark would go by its compressed file size and gather it in the driver.
    parts = parts.hint("shuffle_hash")

    def share(cond):
        return F.sum(F.when(cond, price).otherwise(0.0))

    per_order = (
        lines.join(parts, F.col("p_partkey") == F.col("l_partkey"))
        .groupBy("l_orderkey")
        .agg(
            F.sum(price).alias("t"),
            share(F.col("p_type").isin(*CRYPTO_TYPES)).alias("cr"),
            share(F.col("p_type").isin(*TECH_TYPES)).alias("te"),
            share(F.col("l_returnflag") == "R").alias("rt"),
        )
    )
    recent = F.col("o_orderdate") >= F.lit(CUT).cast("timestamp_ntz")
    per_client = (
        orders.join(per_order, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .groupBy("o_custkey")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("span"),
            F.sum(F.when(recent, F.col("o_totalprice"))).alias("va"),
            F.sum(F.when(~recent, F.col("o_totalprice"))).alias("vb"),
            F.sum(F.when(recent, 1).otherwise(0)).alias("ca"),
            F.sum(F.when(~recent, 1).otherwise(0)).alias("cb"),
            *[F.sum(c).alias(c) for c in ("t", "cr", "te", "rt")],
        )
    )
    per_total = F.nullif(F.col("t"), F.lit(0.0))
    drop = 1 - F.col("ca") / F.nullif(F.col("cb"), F.lit(0))
    return customers.join(per_client, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("c_custkey").alias("client_id"),
        F.floor(F.col("span") / F.nullif(F.col("n") - 1, F.lit(0))).cast("int").alias("avg_holding_days"),
        F.round(F.col("cr") / per_total, 6).alias("crypto_ratio"),
        F.round(F.col("te") / per_total, 6).alias("tech_stocks_ratio"),
        F.round(F.col("c_acctbal") * 15, 2).alias("account_balance"),
        F.round(F.coalesce("va", F.lit(0.0)) / F.nullif(F.col("vb"), F.lit(0.0)), 6).alias("balance_velocity"),
        F.round(F.col("rt") / per_total, 6).alias("market_pain_index"),
        F.round(1.5 * F.greatest(F.lit(0.0), drop), 6).alias("login_freq_drop"),
    )


def clients(spark: SparkSession, folder: str) -> DataFrame:
    return valid_clients(client_raw(spark, folder))


def labelled_clients(spark: SparkSession, folder: str) -> DataFrame:
    """Valid clients with the Bernoulli churn label drawn from the latent score."""
    return clients(spark, folder).withColumn(
        "churn", churn_label(latent_churn(), md5_uniform("client_id"))
    )


def prices(spark: SparkSession, folder: str) -> DataFrame:
    """Daily close per brand: one scan to (date, brand) sums, the rest is small."""
    lines = read_table(spark, folder, "lineitem").select(
        "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity"
    )
    parts = read_table(spark, folder, "part").select("p_partkey", "p_brand")
    log_price = F.ln(F.col("l_extendedprice") / F.col("l_quantity"))
    daily = (
        lines.join(parts, F.col("p_partkey") == F.col("l_partkey"))
        .groupBy(F.col("l_shipdate").cast("date").alias("date"), F.col("p_brand").alias("ticker"))
        .agg(F.sum(log_price).alias("s"), F.count(log_price).alias("n"))
    )
    market = daily.groupBy("date").agg((F.sum("s") / F.sum("n")).alias("mkt"))
    return (
        daily.where(F.col("ticker").isin(*BRANDS))
        .join(market, "date")
        .select(
            "date",
            "ticker",
            F.round(100 + 0.5 * F.col("s") / F.col("n") + 4 * F.col("mkt"), 4).alias("close"),
        )
    )
