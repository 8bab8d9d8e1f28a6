import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from portrisk import config as C
from portrisk.operators import asof, history, market
from portrisk.sources import bridge, prices

TICKERS = [a.ticker for a in C.UNIVERSE]


def panel(spark, n=60, skip=(), null=(), gap=None, zero=None, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for t in TICKERS:
        p = 100.0
        for i in range(n):
            p *= 1 + rng.normal(0.0005, 0.01)
            if t in skip or (gap and (t, i) in gap):
                continue
            value = None if t in null else 0.0 if (t, i) == zero else p
            rows.append((dt.date(2024, 1, 1) + dt.timedelta(days=i), t, value))
    return spark.createDataFrame(rows, "date date, ticker string, close double")


def snap(df):
    return market.market_snapshots(asof.latest_window(df)).first()


def reference(df):
    wide = df.toPandas().pivot(index="date", columns="ticker", values="close").astype(float)
    wide = wide[[t for t in TICKERS if t in wide.columns]].ffill()
    ret = (wide / wide.shift(1) - 1).dropna()
    x = ret.to_numpy() - ret.to_numpy().mean(0)
    n, p = x.shape
    s = x.T @ x / n
    m = np.trace(s) / p
    d = ((s - m * np.eye(p)) ** 2).sum() / p
    b = sum(((np.outer(r, r) - s) ** 2).sum() for r in x) / (p * n * n)
    k = min(b, d) / d
    return ret.mean().to_numpy() * 252, 252 * ((1 - k) * s + k * m * np.eye(p)), k, n


def test_matches_definition(spark):
    df = panel(spark, gap={("KO", 5), ("KO", 6), ("BTC-USD", 0)})
    mu, cov, k, n = reference(df)
    r = snap(df)
    assert r.status == "ok" and r.n_days == n
    assert np.allclose(r.mu, mu) and np.allclose(np.array([list(x) for x in r.sigma]), cov) and abs(r.shrinkage - k) < 1e-12


def test_missing_asset_is_zero(spark):
    df = panel(spark, skip=("KO",))
    r = snap(df)
    i = TICKERS.index("KO")
    assert r.status == "ok" and r.mu[i] == 0 and not any(r.sigma[i])
    _, cov, k, _ = reference(df)
    keep = [j for j in range(7) if j != i]
    assert np.allclose(np.array([list(x) for x in r.sigma])[np.ix_(keep, keep)], cov) and abs(r.shrinkage - k) < 1e-12
    fixed = market.pd_repair(market.market_snapshots(asof.latest_window(df))).first()
    assert fixed.jitter_used > 0 and np.linalg.eigvalsh(np.array([list(x) for x in fixed.sigma]))[0] > 0
    assert [a.asset for a in prices.missing_assets(df).collect()] == ["KO"]


@pytest.mark.parametrize("n, status", [(49, "insufficient_history"), (50, "ok")])
def test_history_guard(spark, n, status):
    assert snap(panel(spark, n)).status == status


def test_failed_refreshes(spark):
    assert snap(panel(spark, null=("KO",))).status == "no_complete_date"
    assert snap(panel(spark, zero=("KO", 20))).status == "infinite_return"
    with pytest.raises(RuntimeError):
        market.latest_snapshot(market.market_snapshots(asof.latest_window(panel(spark, 20))))


@pytest.mark.parametrize(
    "columns, expected",
    [
        (["Close_A", "Open_A", "Close_B", "Open_B"], {"A", "B"}),
        (["A_Close", "A_Open", "B_Close"], {"A", "B"}),
        (["A", "B"], {"A", "B"}),
        (["Close", "Open"], {"Close"}),
    ],
)
def test_unpivot_layouts(spark, columns, expected):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), *map(float, range(len(columns))))], ["date", *columns])
    long = prices.unpivot_closes(df)
    assert {r.ticker for r in long.collect()} == expected


def test_unpivot_without_close(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0)], ["date", "Open_A"])
    with pytest.raises(ValueError):
        prices.unpivot_closes(df)


def test_golden_values(spark):
    d = "/root/testdata/sf0.001"
    r = market.market_snapshots(asof.latest_window(bridge.prices(spark, d)), bridge.BRIDGE_UNIVERSE).first()
    assert r.n_days == 155 and abs(r.shrinkage - 0.670019284) < 1e-8
    assert abs(r.mu[0] - 0.031838) < 1e-6 and abs(r.sigma[0][0] - 0.052374) < 1e-6 and abs(r.sigma[0][1] - 0.000350) < 1e-6


def test_repair_cases():
    fixed, used = market.repair_matrix(np.eye(3), 1e-8, 20)
    assert used == 0 and np.array_equal(fixed, np.eye(3))
    fixed, used = market.repair_matrix(-1e60 * np.eye(3), 1e-8, 20)
    assert fixed is None


def test_asof_join_matches_scan(spark):
    rng = np.random.default_rng(0)
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=int(k))
    left = [(i, day(k)) for i, k in enumerate(rng.integers(0, 900, 300))]
    right = [(day(k), float(k)) for k in sorted(set(rng.integers(100, 700, 12).tolist()))]
    l, r = spark.createDataFrame(left, "id int, ts date"), spark.createDataFrame(right, "as_of date, v double")
    for per_bucket in (1 << 20, 40, 1):
        got = {x.id: x.v for x in asof.asof_join(l, "ts", r, "as_of", per_bucket).collect()}
        want = {i: max(((a, v) for a, v in right if a <= t), default=(None, None))[1] for i, t in left}
        assert got == want


def test_asof_join_with_a_hot_time_and_edges(spark):
    t = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=int(k))
    times = [500] * 400 + list(range(0, 1000, 7)) + [None] * 5
    left = spark.createDataFrame([(i, None if k is None else t(k), "x") for i, k in enumerate(times)], "id int, ts timestamp, r string")
    right = spark.createDataFrame([(t(k), float(k)) for k in (100, 499, 500, 501, 900)] + [(None, -1.0)], "at timestamp, v double")
    for per_bucket in (1 << 20, 50, 1):
        got = sorted((x.id, x.v) for x in asof.asof_join(left, "ts", right, "at", per_bucket).collect())
        want = [(i, None if k is None else max((float(v) for v in (100, 499, 500, 501, 900) if v <= k), default=None)) for i, k in enumerate(times)]
        assert got == want
    plan = asof.asof_join(left, "ts", right, "at", 1)
    assert plan.columns == ["id", "ts", "r", "at", "v"]
    assert [x.v for x in asof.asof_join(left, "ts", right.limit(0), "at").collect()] == [None] * len(times)
    assert asof.asof_join(left.limit(0), "ts", right, "at").collect() == []


def test_a_hot_time_is_dealt_over_buckets(spark):
    from portrisk.operators import prefix

    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 5000).otherwise(F.col("id")).cast("double").alias("t"))
    cuts = rows.agg(prefix.sketch("t").alias("s")).select(prefix.boundaries(F.col("s"), 1000)).first()[0]
    assert sum(c == 5000.0 for c in cuts) >= 5  # as many buckets share its rows


def same_snapshots(a, b):
    assert [r.as_of for r in a] == [r.as_of for r in b] and a
    for x, y in zip(a, b):
        assert (x.status, x.n_dates) == (y.status, y.n_dates)
        if x.status == "ok":
            assert x.n_days == y.n_days and abs(x.shrinkage - y.shrinkage) < 1e-9
            assert np.allclose(x.mu, y.mu, atol=1e-10) and np.allclose([list(r) for r in x.sigma], [list(r) for r in y.sigma], atol=1e-11)


def test_history_equals_single_windows(spark):
    """Gaps, late and early ends, an asset without prices, a zero price: the same as from copies of each window."""
    df = panel(spark, 160, gap={("KO", i) for i in range(40, 95)} | {("BTC-USD", i) for i in range(0, 70)} | {("NVDA", i) for i in range(100, 160)})
    df = df.where("NOT (ticker = 'TSLA' AND date > '2024-04-20')").union(
        spark.createDataFrame([(dt.date(2024, 2, 10), "TSLA", None), (dt.date(2024, 5, 30), "TSLA", None), (dt.date(2023, 1, 5), "KO", 3.0)], df.schema))
    as_ofs = spark.createDataFrame([(dt.date(2023, 12, 1) + dt.timedelta(days=6 * k),) for k in range(36)] + [(dt.date(2020, 1, 1),), (None,)], "as_of date")
    for days in (40, 75, 365):
        for rows in (df, panel(spark, 160, zero=("KO", 80), skip=("MSFT",), null=("ETH-USD",))):
            want = market.market_snapshots(asof.window_by_as_of(rows, as_ofs.where("as_of IS NOT NULL"), days), minimum=20).orderBy("as_of").collect()
            got = history.market_history(rows, as_ofs, days=days, minimum=20).orderBy("as_of").collect()
            same_snapshots(got, want)


def test_history_of_a_wide_universe(spark):
    rng = np.random.default_rng(2)
    p, n = 200, 300
    universe = [C.Asset(i, f"A{i}", f"T{i}", "other") for i in range(p)]
    ret = rng.normal(0, 0.01, (n, p))
    close = 100 * np.cumprod(1 + ret, axis=0)
    rows = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=k), f"T{i}", float(close[k, i])) for k in range(n) for i in range(p)], "date date, ticker string, close double").persist()
    rows.count()
    start = time.perf_counter()
    r = history.market_history(rows, history.latest_as_of(rows), universe).first()
    assert time.perf_counter() - start < 60
    x = ret[1:] - ret[1:].mean(0)
    s = x.T @ x / len(x)
    k, shrunk = market.shrink_covariance(s, float(((x * x).sum(1) ** 2).sum()), len(x))
    assert r.status == "ok" and abs(r.shrinkage - k) < 1e-9 and np.allclose([list(v) for v in r.sigma], 252 * shrunk, atol=1e-10)
    rows.unpersist()
