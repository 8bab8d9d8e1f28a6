"""Constants of the risk model.  Every operator takes them as default arguments."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: feature names and their order --------------------------------
CLUSTER_FEATURES = ("avg_holding_days", "crypto_ratio", "tech_stocks_ratio")
CHURN_FEATURES = ("account_balance", "balance_velocity", "market_pain_index", "login_freq_drop")
ALL_FEATURES = CLUSTER_FEATURES + CHURN_FEATURES
N_CLUSTERS = 3
MODEL_FEATURES = CHURN_FEATURES + tuple(f"cluster_{i}" for i in range(N_CLUSTERS))
MONOTONE_SIGNS = (-1, -1, 1, 1, 0, 0, 0)


# --- fixed values: asset universe ------------------------------------------------
@dataclass(frozen=True)
class Asset:
    ord: int
    asset: str
    ticker: str
    kind: str


UNIVERSE = (
    Asset(0, "AAPL", "AAPL", "tech"),
    Asset(1, "MSFT", "MSFT", "tech"),
    Asset(2, "KO", "KO", "other"),
    Asset(3, "NVDA", "NVDA", "tech"),
    Asset(4, "TSLA", "TSLA", "tech"),
    Asset(5, "BTC", "BTC-USD", "crypto"),
    Asset(6, "ETH", "ETH-USD", "crypto"),
)
ASSETS = tuple(a.asset for a in UNIVERSE)

# --- fixed values: investor profiles ---------------------------------------------
PROFILES_BY_HOLDING = ("aggressive", "balanced", "conservative")
DEFAULT_PROFILE = "balanced"
RISK_AVERSION = {"conservative": 8.0, "balanced": 4.0, "aggressive": 1.5}
DEFAULT_RISK_AVERSION = 4.0
MIN_WEIGHT = {"aggressive": 0.02, "balanced": 0.05, "conservative": 0.08}
DEFAULT_MIN_WEIGHT = 0.02

# --- fixed values: portfolio and market ------------------------------------------
WEIGHT_MAX = 0.40
CHURN_THRESHOLD = 0.50
DIVERSIFICATION_LAMBDA = 0.20
GAMMA_CHURN_SCALE = 1.0
SIGMA_JITTER = 1e-8
JITTER_TRIES = 20
SOLVER_MAX_ITER = 2000
SOLVER_TOL = 1e-12
DUST_WEIGHT = 0.005
TRADING_DAYS = 252
HISTORY_DAYS = 365
MIN_HISTORY_DATES = 50
SNAPSHOT_TTL = "1 hour"

# --- fixed values: drift ---------------------------------------------------------
MONITORED_FEATURES = CHURN_FEATURES
DRIFT_P_VALUE = 0.05
DRIFTED_FEATURES_FOR_RETRAIN = 1
MIN_DRIFT_SAMPLE = 5

# --- fixed values: churn classifier ----------------------------------------------
BOOST_DEPTH = 4
BOOST_ETA = 0.02
BOOST_ROUNDS = 300
BOOST_SUBSAMPLE = 0.85
BOOST_COLSAMPLE = 0.85
BOOST_MIN_CHILD_WEIGHT = 5.0
BOOST_LAMBDA = 1.5
BOOST_PATIENCE = 30
BOOST_MAX_BINS = 256
KMEANS_RESTARTS = 15
KMEANS_MAX_ITER = 500
TEST_FRACTION = 0.20
SEED = 42

# --- fixed values: texts shown for a risk driver ---------------------------------
REASONS = {
    "avg_holding_days": "Short average holding period (high turnover)",
    "crypto_ratio": "High crypto exposure (elevated volatility risk)",
    "tech_stocks_ratio": "High tech concentration (sector drawdown sensitivity)",
    "account_balance": "Low account balance (limited loss cushion)",
    "balance_velocity": "Negative balance velocity (net outflows detected)",
    "market_pain_index": "Elevated market pain index (drawdown stress)",
    "login_freq_drop": "Sudden drop in login frequency (disengagement signal)",
    "cluster_0": "Cluster 0 membership (investor segmentation signal)",
    "cluster_1": "Cluster 1 membership (investor segmentation signal)",
    "cluster_2": "Cluster 2 membership (investor segmentation signal)",
}

# --- fixed values: risk bands (upper limit, colour, message) ---------------------
RISK_BANDS = (
    (0.4, "green", "Low risk — no immediate action required"),
    (0.7, "orange", "Elevated risk — consider monitoring"),
    (None, "red", "High risk — retention action recommended"),
)
STATUS_TRIGGERED = "Retention intervention triggered"
STATUS_STABLE = "Client is currently stable"

MODEL_NAME = "portrisk_churn_v1"
