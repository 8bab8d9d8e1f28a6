"""Registered queries: (spark, folder) -> DataFrame over the whole given tables.

Queries with a SQL counterpart use fixed segment centres and the latent churn
score or a given small ensemble, so that their results do not depend on a random fit;
cluster_sizes, shap_additivity, monotonicity_audit and training_report train on the
same tables.  Doubles are rounded at the very end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portrisk import config as C
from portrisk.catalog.fixed_model import CENTERS, MEANS, STDS, fixed_model
from portrisk.functions import scalar as S
from portrisk.operators import asof, contracts, drift, explain, history, market, metrics, portfolio, segments, split
from portrisk.plans import audit, scoring
from portrisk.plans.training import run_training
from portrisk.sources import bridge, prices
from portrisk.sources.bridge import BRIDGE_UNIVERSE
from portrisk.sources.clients import feature_columns
from portrisk.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(
        *[
            F.round(c, digits).alias(c) if t == "double" else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )


# --- shared inputs ----------------------------------------------------------------
def scored(spark: SparkSession, d: str) -> DataFrame:
    """Labelled clients with the latent churn score."""
    return bridge.labelled_clients(spark, d).withColumn("churn_probability", S.latent_churn())


def assigned(rows: DataFrame) -> DataFrame:
    return rows.withColumn("cluster_id", segments.nearest(segments.scaled(MEANS, STDS), CENTERS))


def profiled(spark: SparkSession, d: str) -> DataFrame:
    rows = assigned(scored(spark, d))
    names = segments.profile_map(segments.cluster_holding(rows)).select("cluster_id", "profile")
    # profile_map fails unless it has exactly three rows
    return rows.join(F.broadcast(names), "cluster_id", "left").withColumn(
        "profile", F.coalesce("profile", F.lit(C.DEFAULT_PROFILE))
    )


def flagged(spark: SparkSession, d: str) -> DataFrame:
    rows = profiled(spark, d).where(S.action_required(F.col("churn_probability")))
    return portfolio.with_bounds(rows).withColumn(
        "gamma", portfolio.risk_aversion("profile", "churn_probability")
    )


def year_window(spark: SparkSession, d: str) -> DataFrame:
    return asof.latest_window(bridge.prices(spark, d))


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    return market.market_snapshots(year_window(spark, d), BRIDGE_UNIVERSE)


def snapshot_history(spark: SparkSession, d: str) -> DataFrame:
    """One snapshot per quarter of the price history."""
    px = bridge.prices(spark, d)
    as_ofs = px.groupBy(F.trunc("date", "quarter").alias("q")).agg(F.max("date").alias("as_of"))
    return history.market_history(px, as_ofs, BRIDGE_UNIVERSE)


_SNAPSHOTS: dict = {}
_MODELS: dict = {}


def _per_session(store: dict, spark: SparkSession, d: str, make):
    key = (spark.sparkContext.applicationId, d)
    if key not in store:
        store[key] = make()
    return store[key]


def snapshot(spark: SparkSession, d: str) -> market.Snapshot:
    return _per_session(_SNAPSHOTS, spark, d, lambda: market.latest_snapshot(snapshots(spark, d)))


def trained(spark: SparkSession, d: str):
    """The full training job on the given tables, once per session and folder."""
    return _per_session(_MODELS, spark, d, lambda: run_training(bridge.labelled_clients(spark, d)))


# --- sources and contract ---------------------------------------------------------
def client_features(spark, d):
    return rounded(feature_columns(bridge.clients(spark, d)))


def validate_clients(spark, d):
    return rounded(bridge.clients(spark, d).select("client_id", "description", *C.ALL_FEATURES))


def rejected_clients(spark, d):
    bad = contracts.rejected_clients(bridge.client_raw(spark, d))
    return bad.select("client_id", F.array_join("violations", "|").alias("violations"), "message")


def validate_text_clients(spark, d):
    """The contract on rows whose fields are all text, some of them lax numbers and some none."""
    raw = bridge.client_raw(spark, d)
    k = F.col("client_id")
    given = F.when(k % 11 == 0, F.concat(F.lit("c"), k.cast("string"))).when(k % 7 == 0, F.concat(k.cast("string"), F.lit(".0"))).otherwise(k.cast("string"))
    text = raw.select(
        given.alias("client_id"),
        *[F.when(k % 5 == 0, F.concat(F.lit(" "), F.col(c).cast("string"))).when(k % 13 == 0, F.lit("n/a") if c == "crypto_ratio" else F.col(c).cast("string")).otherwise(F.col(c).cast("string")).alias(c) for c in C.ALL_FEATURES],
    )
    return rounded(contracts.valid_clients(text).select("client_id", "description", *C.ALL_FEATURES))


def prices_window(spark, d):
    return year_window(spark, d).select("date", "ticker", F.round("close", 4).alias("close"))


def prices_unpivot(spark, d):
    px = bridge.prices(spark, d)
    wide = px.groupBy("date").agg(
        *[F.max(F.when(F.col("ticker") == b, F.col("close"))).alias(f"Close_{b}") for b in bridge.BRANDS],
        *[F.max(F.when(F.col("ticker") == b, F.col("close") + 1)).alias(f"Open_{b}") for b in bridge.BRANDS],
    )
    return rounded(prices.unpivot_closes(wide), 4)


# --- client scores and flags ------------------------------------------------------
def latent_churn_score(spark, d):
    rows = bridge.clients(spark, d)
    return rounded(rows.select("client_id", S.churn_logit().alias("z"), S.latent_churn().alias("churn_probability")), 9)


def churn_label(spark, d):
    rows = bridge.clients(spark, d)
    u, v = S.md5_uniform("client_id"), S.md5_uniform("client_id", "noise:")
    p = S.latent_churn()
    noisy = S.clip(p + (v - 0.5) * 0.24, 0.0, 1.0)
    return rounded(
        rows.select(
            "client_id", u.alias("u"), noisy.alias("noisy_probability"),
            S.churn_label(p, u).alias("churn"), S.churn_label(p, u, (v - 0.5) * 0.24).alias("noisy_churn"),
        )
    )


def churn_rate(spark, d):
    return rounded(bridge.labelled_clients(spark, d).agg(F.avg("churn").alias("churn_rate"), F.count(F.lit(1)).alias("n")))


def predicted_label(spark, d):
    return scored(spark, d).select(
        "client_id", "churn", S.predicted_label(F.col("churn_probability")).alias("predicted")
    )


def risk_bands(spark, d):
    rows = scoring.risk_view(scored(spark, d))
    return rows.select("client_id", "band", "band_message", "action_required", "status", "risk_text")


def client_titles(spark, d):
    rows = profiled(spark, d)
    return rows.select(
        "client_id",
        S.client_title(F.col("client_id"), F.upper("profile")).alias("title"),
        S.dollar_text(F.col("account_balance")).alias("balance_text"),
    )


# --- market -----------------------------------------------------------------------
def asset_prices(spark, d):
    return rounded(prices.asset_prices(bridge.prices(spark, d), BRIDGE_UNIVERSE).select("date", "ord", "asset", "close"), 4)


def missing_assets(spark, d):
    universe = [*BRIDGE_UNIVERSE, C.Asset(7, "GOLD", "Brand#none", "other")]
    return prices.missing_assets(bridge.prices(spark, d), universe).select("ord", "asset", "ticker", "class")


def price_history_check(spark, d):
    px = bridge.prices(spark, d)
    as_ofs = px.groupBy(F.trunc("date", "quarter").alias("q")).agg(F.max("date").alias("as_of"))
    return market.history_check(asof.window_by_as_of(px, as_ofs), BRIDGE_UNIVERSE)


def prices_ffill(spark, d):
    return rounded(market.prices_filled(year_window(spark, d), BRIDGE_UNIVERSE).drop("as_of"), 4)


def asset_returns(spark, d):
    return rounded(market.returns_long(year_window(spark, d), BRIDGE_UNIVERSE).drop("as_of"), 8)


def sample_cov(spark, d):
    return rounded(market.sample_cov(year_window(spark, d), BRIDGE_UNIVERSE).drop("as_of"), 10)


def lw_shrinkage(spark, d):
    return rounded(snapshots(spark, d).select("as_of", "status", "n_dates", "n_days", "shrinkage"), 8)


def market_mu(spark, d):
    return rounded(market.market_mu(snapshots(spark, d), BRIDGE_UNIVERSE), 8)


def market_cov(spark, d):
    return rounded(market.market_cov(snapshots(spark, d), BRIDGE_UNIVERSE), 8)


def pd_repair(spark, d):
    rows = market.pd_repair(snapshot_history(spark, d)).where("status = 'ok'")
    return rounded(rows.select("as_of", "n_days", "jitter_used", "shrinkage"), 8)


def pd_repair_missing_asset(spark, d):
    """The repaired matrix of a universe with an asset that has no price: its row is zero, and jitter makes it definite."""
    universe = [*BRIDGE_UNIVERSE, C.Asset(7, "GOLD", "Brand#none", "other")]
    rows = market.pd_repair(market.market_snapshots(year_window(spark, d), universe)).where("status = 'ok'")
    cells = market.market_cov(rows.withColumn("jitter", F.col("jitter_used")), universe)
    return rounded(cells.join(rows.select("as_of", "jitter_used"), "as_of"), 8)


def daily_closes(spark, d):
    """The batch form of the market stream's first step: the last tick of each ticker and day."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_partkey", "l_shipdate", "l_linenumber", "l_extendedprice", "l_quantity")
    parts = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_brand").where(F.col("p_brand").isin(*bridge.BRANDS))
    ticks = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(hours=F.col("l_linenumber").cast("int"))).alias("ts"),
        F.col("p_brand").alias("ticker"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    return rounded(jobs.daily_closes(ticks), 8)


def drift_windows(spark, d):
    """The batch form of the drift watch: orders by month against the orders of all months, many samples of one reference."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    values = orders.select(F.date_trunc("month", "o_orderdate").cast("date").alias("window_start"), F.lit("o_totalprice").alias("feature"), F.col("o_totalprice").alias("value"))
    reference = values.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n_ref"))
    current = values.groupBy("window_start", "feature", "value").agg(F.count(F.lit(1)).alias("n_cur"))
    stats = drift.ks_against(reference, current, ["window_start"])
    return rounded(drift.finish_drift(stats, ["window_start"], C.DRIFT_P_VALUE, C.MIN_DRIFT_SAMPLE, "series"), 8)


def asof_market_snapshot(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("order_date")
    )
    snaps = snapshot_history(spark, d).where("status = 'ok'").select(
        "as_of", F.get("mu", F.lit(0)).alias("mu_first"), F.get("mu", F.lit(6)).alias("mu_last")
    )
    return rounded(asof.asof_join(orders, "order_date", snaps, "as_of"))


# --- segments ---------------------------------------------------------------------
def scaler_stats(spark, d):
    return rounded(segments.scaler_stats(bridge.clients(spark, d)))


def assign_cluster(spark, d):
    return assigned(bridge.clients(spark, d)).select("client_id", "cluster_id")


def cluster_holding(spark, d):
    return rounded(segments.cluster_holding(assigned(bridge.clients(spark, d))))


def profile_map(spark, d):
    return rounded(segments.profile_map(segments.cluster_holding(assigned(bridge.clients(spark, d)))))


def client_profiles(spark, d):
    return profiled(spark, d).select("client_id", "cluster_id", "profile")


def cross_features(spark, d):
    model = segments.SegmentEncoderModel(list(MEANS), list(STDS), [x for c in CENTERS for x in c])
    rows = model.transform(bridge.clients(spark, d))
    return rounded(
        rows.select("client_id", *[F.get("features", F.lit(i)).alias(n) for i, n in enumerate(model.feature_names())])
    )


def cluster_sizes(spark, d):
    model = trained(spark, d).model
    rows = model.profiles.transform(model.segments.predict_cluster(bridge.clients(spark, d)))
    return rounded(
        rows.groupBy("cluster_id", "profile").agg(
            F.count(F.lit(1)).alias("n"), F.avg("avg_holding_days").alias("mean_holding_days")
        )
    )


# --- metrics and split ------------------------------------------------------------
def roc_auc(spark, d):
    return rounded(metrics.roc_auc(scored(spark, d)), 8)


def log_loss(spark, d):
    return rounded(metrics.log_loss(scored(spark, d)), 8)


def classification_report(spark, d):
    return rounded(metrics.classification_report(scored(spark, d)), 8)


def stratified_split(spark, d):
    return split.stratified_split(bridge.labelled_clients(spark, d)).select("client_id", "churn", "is_test")


# --- drift ------------------------------------------------------------------------
def _samples(spark, d, factor: float = 1.0):
    rows = bridge.clients(spark, d).select("client_id", *C.MONITORED_FEATURES)
    ref, cur = rows.where("client_id % 2 = 0"), rows.where("client_id % 2 = 1")
    return ref, cur.withColumn("account_balance", F.col("account_balance") * factor)


def drift_ks(spark, d):
    results = drift.drift_results(*_samples(spark, d), p_value="series")
    return rounded(results, 8)


def drift_ks_by_cluster(spark, d):
    """The same test per investor segment, with a shifted balance."""
    rows = assigned(bridge.clients(spark, d))
    ref, cur = rows.where("client_id % 2 = 0"), rows.where("client_id % 2 = 1")
    cur = cur.withColumn("account_balance", F.col("account_balance") * 1.5)
    return rounded(drift.drift_results(ref, cur, keys=["cluster_id"], p_value="series"), 8)


def drift_ks_exact(spark, d):
    return rounded(drift.drift_results(*_samples(spark, d), p_value="exact"), 8)


def drift_ks_asymptotic(spark, d):
    """The default method, with a shifted balance."""
    return rounded(drift.drift_results(*_samples(spark, d, 1.5)), 8)


def retrain_decision(spark, d):
    plain = drift.drift_results(*_samples(spark, d), p_value="series").withColumn("sample", F.lit("plain"))
    moved = drift.drift_results(*_samples(spark, d, 1.5), p_value="series").withColumn("sample", F.lit("shifted"))
    return drift.retrain_decision(plain.unionByName(moved), ["sample"])


# --- portfolio --------------------------------------------------------------------
def profile_params(spark, d):
    rows = profiled(spark, d)
    return rows.select(
        "client_id",
        "profile",
        S.lookup(C.RISK_AVERSION, "profile", C.DEFAULT_RISK_AVERSION).alias("base_aversion"),
        portfolio.min_weight("profile").alias("min_weight"),
        S.lookup(C.REASONS, F.concat(F.lit("cluster_"), F.col("cluster_id").cast("string")), "none").alias("reason"),
    )


def risk_aversion(spark, d):
    rows = profiled(spark, d)
    return rounded(rows.select("client_id", "profile", portfolio.risk_aversion("profile", "churn_probability").alias("gamma")))


def asset_bounds(spark, d):
    rows = flagged(spark, d)
    return rounded(portfolio.bounds_long(rows, ("client_id", "profile")), 9)


def equal_weight_start(spark, d):
    rows = flagged(spark, d).withColumn("w", portfolio.start_weights())
    names = F.array(*[F.lit(a) for a in C.ASSETS])
    long = rows.select("client_id", F.posexplode("w").alias("i", "weight"))
    return rounded(long.select("client_id", F.get(names, F.col("i")).alias("asset"), "weight"), 9)


def _solved(spark, d):
    snap = snapshot(spark, d)
    rows = profiled(spark, d)
    return portfolio.optimize_portfolios(rows, snap), snap


def weight_digits(weight) -> Column:
    """Six digits of a weight. A weight at a bound has 7 or 8 digits, so ties are real and are broken on decimals."""
    return F.round(F.round(weight, 10).cast("decimal(18,10)"), 6).cast("double")


def optimize_portfolios(spark, d):
    rows, _ = _solved(spark, d)
    return rows.select("client_id", *[weight_digits(F.get("weights", F.lit(i))).alias(f"w_{a}") for i, a in enumerate(C.ASSETS)])


def portfolio_optimality(spark, d):
    """Properties every solved client must have."""
    rows, snap = _solved(spark, d)
    rows = portfolio.with_kkt_residual(rows, snap)
    rows = portfolio.with_utility(rows, snap).withColumnRenamed("utility", "best")
    # A feasible point to beat: from the lower bounds as far toward the upper ones as the budget goes.
    n = len(C.ASSETS)
    reach = (1 - n * F.col("lb")) / F.nullif(F.aggregate("ub", F.lit(0.0), lambda a, x: a + x) - n * F.col("lb"), F.lit(0.0))
    rows = rows.withColumn("reach", reach).withColumn(
        "mix", F.transform("ub", lambda u: F.col("lb") + F.col("reach") * (u - F.col("lb")))
    )
    rows = portfolio.with_utility(rows, snap, "mix")
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    boxed = F.forall(
        F.arrays_zip(F.col("weights").alias("w"), F.col("ub").alias("u")),
        lambda s: (s["w"] >= F.col("lb") - 1e-9) & (s["w"] <= s["u"] + 1e-9),
    )
    return rows.select(
        "client_id",
        "converged",
        (F.abs(total - 1) < 1e-9).alias("sums_to_one"),
        boxed.alias("in_box"),
        (F.col("kkt_residual") < 1e-6).alias("stationary"),
        (F.col("best") >= F.col("utility") - 1e-9).alias("beats_feasible_point"),
    )


def portfolio_utility(spark, d):
    rows = flagged(spark, d).withColumn("weights", portfolio.start_weights())
    out = portfolio.with_utility(rows, snapshot(spark, d))
    return rounded(out.select("client_id", "portfolio_return", "portfolio_variance", "penalty", "utility"), 8)


def kkt_residual(spark, d):
    rows = flagged(spark, d).withColumn("weights", portfolio.start_weights())
    out = portfolio.with_kkt_residual(rows, snapshot(spark, d))
    return rounded(out.select("client_id", "kkt_residual", "free_spread"), 7)


def allocation_breakdown(spark, d):
    """Display table of given weights (squares of the upper bounds, scaled to one)."""
    squares = F.transform("ub", lambda u: u * u)
    size = F.aggregate(squares, F.lit(0.0), lambda a, x: a + x)
    rows = flagged(spark, d).withColumn("weights", F.transform(squares, lambda x: x / size))
    out = portfolio.allocation_breakdown(rows)
    return out.select(
        "client_id",
        "asset",
        F.round("weight_pct", 5).alias("weight_pct"),
        F.round("capital", 3).alias("capital"),
        "weight_text",
        "capital_text",
    )


# --- classifier and explanation ---------------------------------------------------
def risk_drivers(spark, d):
    """Drivers of the latent score, whose contributions are its four linear terms."""
    parts = F.array(
        -0.5 * (F.col("account_balance") / 50000.0 - 1.5),
        -4.0 * (F.col("balance_velocity") - 0.70),
        4.5 * (F.col("market_pain_index") - 0.50),
        3.0 * (F.col("login_freq_drop") - 0.60),
    )
    names = explain.risk_drivers(F.transform(parts, lambda x: F.round(x, 9)), C.CHURN_FEATURES)
    rows = bridge.clients(spark, d).withColumn("names", names).withColumn("texts", explain.driver_texts(F.col("names")))
    return rows.select(
        "client_id",
        *[F.get("names", F.lit(i)).alias(f"driver_{i + 1}") for i in (0, 1)],
        *[F.get("texts", F.lit(i)).alias(f"text_{i + 1}") for i in (0, 1)],
    )


def churn_scores(spark, d):
    model = fixed_model()
    out = scoring.predict_clients(bridge.clients(spark, d), model)
    return rounded(out.select("client_id", "churn_probability"))


def shap_values(spark, d):
    model = fixed_model()
    rows = model.classifier.score(model.segments.transform(bridge.clients(spark, d)), explain=True)
    return rounded(
        rows.select(
            "client_id", "base_value", "margin",
            *[F.get("contributions", F.lit(i)).alias(n) for i, n in enumerate(C.MODEL_FEATURES)],
        )
    )


def shap_additivity(spark, d):
    """Contributions plus base equal the margin, for every client."""
    model = trained(spark, d).model
    rows = model.classifier.score(model.segments.transform(bridge.clients(spark, d)), explain=True)
    total = F.aggregate("contributions", F.col("base_value"), lambda a, x: a + x)
    return rows.select("client_id", (F.abs(total - F.col("margin")) < 1e-9).alias("additive"))


def predict_and_explain(spark, d):
    model = fixed_model()
    out = scoring.predict_and_explain(bridge.clients(spark, d), model)
    return out.select(
        "client_id",
        "churn_probability",
        F.array_join("risk_drivers", " | ").alias("risk_drivers"),
        "model_version",
    )


def predict_clients(spark, d):
    model = fixed_model()
    out = scoring.predict_clients(bridge.clients(spark, d), model)
    return rounded(out.select("client_id", "cluster_id", "profile", "churn_probability"))


def client_allocations(spark, d):
    """Model scores to allocations of all flagged clients; texts of weights to ten digits, see weight_digits."""
    rows = scoring.allocate_clients(bridge.clients(spark, d), fixed_model(), snapshot(spark, d))
    rows = rows.withColumn("weights", F.transform("weights", lambda w: F.round(w, 10)))
    out = portfolio.allocation_breakdown(rows, keep=("client_id", "profile"))
    return out.select("client_id", "profile", "asset", weight_digits("weight").alias("weight"), "weight_text", "capital_text")


def monotonicity_audit(spark, d):
    return audit.monotonicity_audit(bridge.clients(spark, d), trained(spark, d).model)


def training_report(spark, d):
    return rounded(trained(spark, d).report)


ALL: dict[str, Query] = {
    f.__name__: f
    for f in (
        client_features, validate_clients, validate_text_clients, rejected_clients, prices_window, prices_unpivot,
        latent_churn_score, churn_label, churn_rate, predicted_label, risk_bands, client_titles,
        asset_prices, missing_assets, price_history_check, prices_ffill, asset_returns, sample_cov,
        lw_shrinkage, market_mu, market_cov, pd_repair, pd_repair_missing_asset, daily_closes, asof_market_snapshot,
        scaler_stats, assign_cluster, cluster_holding, profile_map, client_profiles, cross_features, cluster_sizes,
        roc_auc, log_loss, classification_report, stratified_split,
        drift_ks, drift_ks_by_cluster, drift_ks_exact, drift_ks_asymptotic, drift_windows, retrain_decision,
        profile_params, risk_aversion, asset_bounds, equal_weight_start,
        optimize_portfolios, portfolio_optimality, portfolio_utility, kkt_residual, allocation_breakdown,
        risk_drivers, churn_scores, shap_values, shap_additivity, predict_and_explain, predict_clients,
        client_allocations, monotonicity_audit, training_report,
    )
}
