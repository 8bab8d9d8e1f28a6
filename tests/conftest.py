from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from portrisk.session import local_session

    s = local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def folder():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def labelled(spark):
    """Labelled clients at sf0.01: the smallest scale has too few rows for a split of the classifier."""
    from portrisk.sources import bridge

    df = bridge.labelled_clients(spark, "/root/testdata/sf0.01").coalesce(2).persist()
    df.count()
    return df


DEMO = [
    (9001, 6, 0.75, 0.20, 42000.0, 0.62, 0.65, 0.45),
    (9002, 185, 0.00, 0.15, 450000.0, 1.20, 0.05, 1.40),
    (9003, 55, 0.25, 0.35, 18000.0, 0.42, 0.88, 0.28),
    (9004, 15, 0.50, 0.40, 85000.0, 0.58, 0.55, 0.75),
    (9005, 145, 0.05, 0.10, 110000.0, 0.22, 0.40, 0.80),
    (9006, 45, 0.15, 0.45, 35000.0, 0.98, 0.35, 1.05),
    (9007, 4, 0.80, 0.10, 50000.0, 0.05, 0.98, 0.02),
]


@pytest.fixture(scope="session")
def demo(spark):
    return spark.createDataFrame(
        DEMO,
        "client_id long, avg_holding_days int, crypto_ratio double, tech_stocks_ratio double, account_balance double, "
        "balance_velocity double, market_pain_index double, login_freq_drop double",
    )
